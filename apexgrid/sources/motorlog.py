"""``spark.read.format("motorlog")``: directories of binary logs as tables.

:func:`read_logs` is the way for many files: Spark lists them, small ones come with their content, and shares of large ones are planned and
read in tasks. The data source reads single channels or ranges of a few files:

``option("table", ...)`` selects ``sessions``, ``channels`` (strings as stored), ``samples`` or ``bad_files``. The driver
only lists files and sizes; it opens none. Small files are packed together and large ones split by share of their
samples, so that tasks are of similar size whatever the mix. With ``option("pushfilters", "true")``, which needs
``spark.sql.python.filterPushdown.enabled``, filters on channel and sample index are applied before decoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from apexgrid import schema
from apexgrid.chunking import join_by_chunk, spread_join
from apexgrid.operators.catalog import clean_names, with_series_names
from apexgrid.session import ship_package
from apexgrid.sources.logfile import BadLog, Channel, LogFile

TARGET_BYTES = 64 << 20
BATCH_ROWS = 1 << 16

TABLES = {
    "sessions": schema.SESSIONS,
    "channels": schema.RAW_CHANNELS,
    "samples": schema.SAMPLES,
    "bad_files": schema.BAD_FILES,
}
EXTENSION = ".ld"


@dataclass(frozen=True)
class LogPart(InputPartition):
    """Some files, or share ``part`` of ``parts`` of one file's samples."""

    files: tuple[tuple[str, int], ...]
    part: int = 0
    parts: int = 1


@dataclass(frozen=True)
class Wanted:
    """What pushed filters leave of a samples table: channel names and a sample range."""

    channels: frozenset[str] | None = None
    start: int = 0
    end: int = 2**63 - 1

    def narrowed(self, f: Filter) -> Wanted | None:
        """The combination with one more filter, or None if Spark has to apply it."""
        match f:
            case EqualTo(("channel",), str(name)):
                return self._named({name})
            case In(("channel",), names):
                return self._named(names)
            case EqualTo(("sample_idx",), int(v)):
                return replace(self, start=max(self.start, v), end=min(self.end, v + 1))
            case GreaterThan(("sample_idx",), int(v)):
                return replace(self, start=max(self.start, v + 1))
            case GreaterThanOrEqual(("sample_idx",), int(v)):
                return replace(self, start=max(self.start, v))
            case LessThan(("sample_idx",), int(v)):
                return replace(self, end=min(self.end, v))
            case LessThanOrEqual(("sample_idx",), int(v)):
                return replace(self, end=min(self.end, v + 1))
        return None

    def _named(self, names) -> Wanted:
        names = frozenset(names)
        return replace(self, channels=names if self.channels is None else self.channels & names)


class MotorLog(DataSource):
    """Python data source over files of any file system that pyarrow can open."""

    @classmethod
    def name(cls) -> str:
        return "motorlog"

    def schema(self) -> StructType:
        return TABLES[self._table()]

    def reader(self, schema: StructType) -> DataSourceReader:
        push = self.options.get("pushfilters", "false") == "true"
        make = FilteringReader if push else MotorLogReader
        return make(self.options["path"], self._table(), int(self.options.get("targetbytes", TARGET_BYTES)))

    def _table(self) -> str:
        table = self.options.get("table", "samples")
        if table not in TABLES:
            raise ValueError(f"no table '{table}', choose from {sorted(TABLES)}")
        return table


class MotorLogReader(DataSourceReader):
    def __init__(self, path: str, table: str, target_bytes: int):
        self.path, self.table, self.target_bytes = path, table, target_bytes
        self.wanted = Wanted()

    def partitions(self) -> Sequence[InputPartition]:
        files = list_logs(self.path)
        split = self.table == "samples"
        parts: list[LogPart] = []
        batch, size = [], 0
        for f in files:
            if split and f[1] > self.target_bytes:
                n = -(-f[1] // self.target_bytes)
                parts += [LogPart((f,), k, n) for k in range(n)]
                continue
            # a table without samples reads little of each file
            cost = f[1] if split else min(f[1], self.target_bytes // 64)
            if batch and size + cost > self.target_bytes:
                parts.append(LogPart(tuple(batch)))
                batch, size = [], 0
            batch.append(f)
            size += cost
        if batch:
            parts.append(LogPart(tuple(batch)))
        return parts or [LogPart(())]

    def read(self, partition: LogPart) -> Iterator[pa.RecordBatch]:
        for path, size in partition.files:
            try:
                with open_log(path) as source:

                    def fetch(at: int, n: int) -> bytes:
                        source.seek(at)
                        return source.read(n)

                    log = LogFile(size, fetch)
                    yield from self._rows(path, log, partition)
            except BadLog as error:
                # an error of the store is not the file's fault: it fails the task, and Spark tries again
                if self.table == "bad_files":
                    yield _batch(schema.BAD_FILES, [{"path": path, "reason": str(error)}])

    def _rows(self, path: str, log: LogFile, partition: LogPart) -> Iterator[pa.RecordBatch]:
        session_id = session_of(path, self.path)
        if self.table == "sessions":
            yield _batch(schema.SESSIONS, [{"session_id": session_id} | log.session()])
        elif self.table == "channels":
            yield channel_batch(session_id, log.channels())
        elif self.table == "samples":
            yield from sample_batches(session_id, log, self.wanted, partition.part, partition.parts)


class FilteringReader(MotorLogReader):
    """Spark refuses a reader that takes filters unless filter pushdown is enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            narrowed = self.wanted.narrowed(f) if self.table == "samples" else None
            if narrowed is None:
                yield f
            else:
                self.wanted = narrowed


def channel_batch(session_id: str, channels: list[Channel]) -> pa.RecordBatch:
    fields = [f for f in schema.RAW_CHANNELS.names if f not in ("session_id", "channel_index")]
    rows = [
        {"session_id": session_id, "channel_index": c.index} | {f: getattr(c, f) for f in fields} for c in channels
    ]
    return _batch(schema.RAW_CHANNELS, rows)


def series_names(channels: list[Channel]) -> list[str]:
    """Names that tell the channels apart; the Column form is :func:`apexgrid.operators.catalog.with_series_names`."""
    seen: set[str] = set()
    return [f"{c.name}#{c.index}" if c.name in seen else seen.add(c.name) or c.name for c in channels]


def sample_batches(
    session_id: str, log: LogFile, wanted: Wanted = Wanted(), part: int = 0, parts: int = 1
) -> Iterator[pa.RecordBatch]:
    """Decoded samples of one share of the file; shares cut the samples of all channels, laid end to end."""
    channels = log.channels()
    counts = [log.available(c) for c in channels]
    total = sum(counts)
    lo, hi = total * part // parts, total * (part + 1) // parts
    before = 0
    for c, name, n in zip(channels, series_names(channels), counts):
        start, end = max(lo - before, wanted.start, 0), min(hi - before, wanted.end, n)
        before += n
        if wanted.channels is not None and name not in wanted.channels:
            continue
        for at in range(start, end, BATCH_ROWS):
            yield _sample_batch(session_id, c, name, at, log.samples(c, at, min(at + BATCH_ROWS, end)))


def _sample_batch(session_id: str, c: Channel, name: str, start: int, values: np.ndarray) -> pa.RecordBatch:
    n = len(values)
    columns = [
        pa.array([session_id]).take(pa.array(np.zeros(n, "i4"))),
        pa.array(np.full(n, c.index, "i4")),
        pa.array([name]).take(pa.array(np.zeros(n, "i4"))),
        pa.array(np.full(n, c.freq, "i4")),
        pa.array(np.arange(start, start + n, dtype="i8")),
        pa.array(values),
    ]
    return pa.RecordBatch.from_arrays(columns, names=schema.SAMPLES.names)


def _batch(layout: StructType, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(layout))


def _resolve(path: str) -> tuple[fs.FileSystem, str]:
    path = _plain(path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_logs(path: str) -> list[tuple[str, int]]:
    """Log files below a directory, or the file itself, with sizes."""
    system, root = _resolve(path)
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(
        (prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(EXTENSION)
    )


def open_log(path: str):
    system, inner = _resolve(path)
    return system.open_input_file(inner)


def session_of(path: str, root: str = "") -> str:
    """Session key of a file: its path below the directory read, else its whole path, without extension."""
    path, root = _plain(path), _plain(root)
    base = root.rstrip("/") + "/"
    if path == root:
        inner = path.rpartition("/")[2]
    else:
        inner = path[len(base) :] if root and path.startswith(base) else path
    folder, slash, name = inner.rpartition("/")
    return folder + slash + name.rsplit(".", 1)[0]


def _plain(path: str) -> str:
    """Local files without their scheme, which is written in several ways."""
    return re.sub("^file:(//)?(?=/)", "", path)


# Spark side


def read_table(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(MotorLog)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("motorlog").option("table", table).option("pushfilters", push)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def read_logs(spark: SparkSession, path: str, table: str = "samples", target_bytes: int = TARGET_BYTES) -> DataFrame:
    """A table of all logs below ``path``, without listing them in Python.

    Spark's own file scan lists the directory and packs files of up to ``target_bytes`` into tasks, which read and decode them. A larger
    file is one row for each share of its samples; tasks open it and fetch the bytes of their share. Only the total size of
    the large files reaches the driver.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{EXTENSION}").option("recursiveFileLookup", "true").load(path)
    if table != "samples":
        return _large_logs(files.select("path", "length"), table, path, target_bytes)
    small = decode_logs(files.filter(F.col("length") <= target_bytes), table, path)
    return small.unionAll(_large_logs(files.filter(F.col("length") > target_bytes).select("path", "length"), table, path, target_bytes))


def _large_logs(files: DataFrame, table: str, root: str, target_bytes: int) -> DataFrame:
    """Logs ``(path, length)`` by ranged reads, the samples by shares."""
    shares = F.ceil(F.col("length") / target_bytes) if table == "samples" else F.lit(1)
    # a table without samples reads little of each file
    cost = F.col("length") if table == "samples" else F.least(F.col("length"), F.lit(target_bytes // 64))
    total = files.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0]
    parts = files.withColumn("parts", shares.cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # an explicit number: rows are a few bytes, what they stand for is not
    dealt = parts.repartition(max(-(-total // target_bytes), 1), "path", "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                share = LogPart(((row["path"], row["length"]),), row["part"], row["parts"])
                yield from MotorLogReader(root, table, target_bytes).read(share)

    return dealt.select("path", "length", "part", "parts").mapInArrow(read, TABLES[table])


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue with clean names and units; ``channel`` is the name that the samples carry, ``name`` may be that of several channels."""
    return with_series_names(clean_names(read_logs(spark, path, "channels")), "name", "channel").select(
        "session_id",
        "channel_index",
        "channel",
        "name",
        "short_name",
        "unit",
        "freq",
        "n_data",
        "data_type",
        "shift",
        "mul",
        "scale",
        "dec_places",
    )


def ingest(spark: SparkSession, path: str, target: str) -> None:
    """Write ``sessions``, ``channels``, ``samples`` and ``bad_files`` as Parquet below ``target``.

    Tasks hold whole runs of a channel, so sorting inside each task is enough for row groups that channel and index
    filters can skip; no sample is shuffled.
    """
    for table in ("sessions", "bad_files"):
        read_logs(spark, path, table).write.mode("overwrite").parquet(f"{target}/{table}")
    read_channels(spark, path).write.mode("overwrite").parquet(f"{target}/channels")
    (
        read_logs(spark, path, "samples")
        .sortWithinPartitions("session_id", "channel", "sample_idx")
        .write.mode("overwrite")
        .parquet(f"{target}/samples")
    )


def decode_logs(files: DataFrame, table: str = "samples", root: str = "") -> DataFrame:
    """Decode a frame ``(path STRING, content BINARY)`` such as ``spark.read.format("binaryFile")`` gives.

    A session is keyed by its path below ``root``, so equal file names in two folders are two sessions.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    log = LogFile.of_bytes(content.as_py())
                except BadLog as error:
                    if table == "bad_files":
                        yield _batch(schema.BAD_FILES, [{"path": path, "reason": str(error)}])
                    continue
                if table == "sessions":
                    yield _batch(schema.SESSIONS, [{"session_id": session_of(path, root)} | log.session()])
                elif table == "channels":
                    yield channel_batch(session_of(path, root), log.channels())
                elif table == "samples":
                    yield from sample_batches(session_of(path, root), log)

    ship_package(files.sparkSession)
    return files.select("path", "content").mapInArrow(decode, TABLES[table])


def scale_samples(raw: DataFrame, channels: DataFrame, keys: Sequence[str] = schema.SERIES) -> DataFrame:
    """Engineering units for raw values: ``((v / scale) * 10^-dec + shift) * mul``; a scale of 0 leaves them.

    ``channels`` brings ``shift, mul, scale, dec_places`` per key, and meets the samples chunk by chunk; with its ``n_data`` it is known
    without a look at the samples which chunks there are. Logs are scaled when they are read: this is for raw values from elsewhere.
    """
    v, scale = F.col("value"), F.col("scale").cast("double")
    ten = F.pow(F.lit(10.0), -F.col("dec_places").cast("double"))
    unit = (F.try_divide(v, scale) * ten + F.col("shift")) * F.col("mul")
    factors = channels.select(*keys, "shift", "mul", "scale", "dec_places", *(c for c in ("n_data",) if c in channels.columns))
    join = join_by_chunk if "n_data" in factors.columns else spread_join
    joined = join(raw, factors, keys, "sample_idx")
    return joined.withColumn("value", F.when(scale == 0, v).otherwise(unit)).select(*raw.columns)
