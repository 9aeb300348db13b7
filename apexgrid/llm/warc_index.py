"""WARC archives with an index written first, and reads of byte ranges by that index.

Method: every task writes its records to an archive of its own, one gzip member per record, and its index rows (archive,
offset, length, URL, digest, ...) are the output. A file is named after the task attempt; the index, kept as a table, lists
only archives of attempts that succeeded, so a lost executor leaves at most an unlisted file. Readers never scan archives: they
select index rows, range-partition and sort them by (archive, offset), into tasks of about ``TASK_BYTES`` of the archives, and fetch neighbouring records with one
read as long as gaps are at most ``GAP`` and a read is at most ``READ`` bytes (a longer record alone may exceed it).

Records with equal payloads of at least ``REVISIT_FROM`` bytes: the largest page id's is the response, the others are revisits
without payload. Equality is that of length and SHA-256; the groups that occur more than once are a table of their own,
joined by digest, so that a group of any size is spread by adaptive execution.

Files go through ``pyarrow.fs``, which opens local, HDFS and object stores by URI.

Cases: null html is an empty payload; a null page id is written as ``null`` and read back so, it is never the largest of a group with
ids, and a group without ids is all responses; rows that share the largest id of their group are all responses; control characters in a URL are percent-encoded, a
null URL is empty; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexgrid.llm.columns import prepare, text_or_empty
from apexgrid.session import materialised, shared_folder

REVISIT_FROM = 1000
READ = 8 << 20
GAP = 64 << 10
#: bytes of records that a task reads
TASK_BYTES = 32 << 20

_INDEX = "archive string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string, payload_bytes bigint"
_RECORDS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _name(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(name: str) -> int | None:
    number = name[len("<urn:page:") : -1]
    return None if number == "null" else int(number)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit keeps the payload's size and digest in its header, the payload is that of the record it refers to."""
    block = b"" if refers_to is not None else _HTTP % len(payload) + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[-2:-2] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_name(refers_to)}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("a byte range does not start with a record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a byte range does not end with its record")
    refers_to = fields.get("WARC-Refers-To")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None
    size = int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload and digest differ")
    page = _page(fields["WARC-Record-ID"])
    return page, fields["WARC-Target-URI"], fields["WARC-Type"], size, digest, refers_to and _page(refers_to), payload


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        store, path = _store(name)
        offset, out = 0, None
        names = [f.split()[0] for f in _INDEX.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        try:
            for b in batches:
                rows = []
                for page, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                    payload = html or b""
                    digest = hashlib.sha1(payload).hexdigest()
                    member = gzip.compress(record(page, url, payload, digest, refers_to), compresslevel=1, mtime=0)
                    if out is None:
                        out = store.open_output_stream(path, compression=None)
                    out.write(member)
                    kind = "response" if refers_to is None else "revisit"
                    rows.append((name, offset, len(member), url, digest, page, kind, len(payload)))
                    offset += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Write one record per row of ``pages`` below ``folder`` and give the index, a stored table."""
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    payload = text_or_empty(html).cast("binary")
    known = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")
    ).withColumns({"size": F.octet_length("payload"), "sha": F.sha2("payload", 256)})
    long = known.filter(F.col("size") >= REVISIT_FROM)
    groups = long.groupBy("size", "sha").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    repeated = materialised(groups.filter("n > 1 AND response IS NOT NULL").select("size", "sha", "response"))
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("response"))
    decided = known.join(repeated, ["size", "sha"], "left").select(
        "page_id", "url", "payload", F.when(other, F.col("response")).alias("refers_to")
    )
    return materialised(decided.mapInArrow(_write(folder), _INDEX))


def _ranges(rows: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (archive, offset, length) as reads (archive, from, to, records)."""
    archive, low, high, parts = None, 0, 0, []
    for name, offset, length in rows:
        if parts and (name != archive or offset - high > GAP or offset + length - low > READ):
            yield archive, low, high, parts
            parts = []
        if not parts:
            archive, low, high = name, offset, offset
        parts.append((offset, length))
        high = max(high, offset + length)
    if parts:
        yield archive, low, high, parts


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    opened, file = None, None
    asked = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for archive, low, high, parts in _ranges(asked):
        if archive != opened:
            if file is not None:
                file.close()
            store, path = _store(archive)
            file, opened = store.open_input_file(path), archive
        data = file.read_at(high - low, low)
        rows = [parsed(zlib.decompress(data[o - low : o - low + n], wbits=31)) for o, n in parts]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    if file is not None:
        file.close()


def read_records(index: DataFrame) -> DataFrame:
    """The records that the rows of ``index`` point to; ``payload`` is null for revisits."""
    prepare(index.sparkSession)
    order = ["archive", "offset"]
    asked = index.select("archive", "offset", "length")
    size = asked.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # an explicit number, which adaptive execution leaves alone: index rows are small, what they stand for is not
    dealt = asked.repartitionByRange(max(-(-size // TASK_BYTES), 1), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(_read, _RECORDS)
