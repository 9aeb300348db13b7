"""Removal of passages that an earlier document has already, by seed and extend.

Method: a passage is ``WINDOW`` consecutive words. Each window's seed (anchor) is its smallest ``SEED``-word hash, so the
distinct seeds of a text are a winnowing of it, and equal windows have equal seeds wherever they lie.

1. One pass gives the distinct anchors of every document. Grouping them with map-side minima and maxima leaves the anchors
   that two documents share; a join gives each document those of its own.
2. Extension: around each shared anchor the windows to its left and right that hang on it are tried as wholes. All
   occurrences of one window are matched at once through their smallest document id, again with map-side minima, so a
   group of copies or a common passage costs as many rows as it has occurrences, never pairs. Windows without a shared
   anchor cannot repeat and are not looked at.
3. Matching windows next to each other merge into maximal repeats, and their words are cut out of the later documents.

Every window of 13 words has an anchor, so no repeat of the threshold length or more is missed. Hot anchors and
windows meet only partial aggregates and joins between stored tables, which adaptive execution splits.

Cases: null text has no words; texts shorter than a window are kept; a null id matches nothing and loses nothing; rows that
share an id do not count as earlier than each other, and each keeps the cuts of its own text; an empty table gives no rows;
other columns are ignored.

Two windows are held equal by a 64-bit hash of their words; words are not compared. Among n different windows at most
n^2 / 2^65 false equalities are expected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexgrid.llm import words
from apexgrid.llm.columns import prepare, text_or_empty
from apexgrid.session import materialised

WINDOW = 13
SEED = 5

#: a row with its text: ``part`` is empty for ids that occur once, else a digest of the text
KEYS = ["doc_id", "part"]
_KEYS = "doc_id bigint, part string"


def window_anchors(hashes: np.ndarray, window: int = WINDOW, seed: int = SEED) -> np.ndarray:
    """Anchor of every window: the smallest of the ``window - seed + 1`` seed hashes in it."""
    out = words.run_hashes(hashes, seed)
    have, want = 1, window - seed + 1
    while have < want:
        step = min(have, want - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def _per_text(column: pa.Array, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Anchors and window hashes of every text, window by window."""
    for _, hashes, borders in words.word_hashes(column):
        anchors = window_anchors(hashes, window)
        whole = words.run_hashes(hashes, window, seed=13)
        for low, high in zip(borders[:-1].tolist(), borders[1:].tolist()):
            n = max(high - low - window + 1, 0)
            yield anchors[low : low + n], whole[low : low + n]


def _lists(keys: list[pa.Array], columns: list[list[np.ndarray]], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    offsets = pa.array(np.cumsum([0, *map(len, columns[0])]), pa.int32())
    flat = [pa.array(np.concatenate(c) if c else np.zeros(0), t) for c, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays([*keys, *(pa.ListArray.from_arrays(offsets, f) for f in flat)], names=[*KEYS, *names])


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.unique(a).view(np.int64) for a, _ in _per_text(b.column(2), window)]
            yield _lists(b.columns[:2], [lists], [pa.int64()], ["anchors"])

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(3)
            starts, hashes, low, held = [], [], 0, 0
            for i, (anchors, whole) in enumerate(_per_text(b.column(2), window)):
                mine = np.asarray(asked[i].values.to_numpy(zero_copy_only=False)).view(np.uint64)
                at = np.flatnonzero(np.isin(anchors, mine)).astype(np.int32)
                starts.append(at)
                hashes.append(whole[at].view(np.int64))
                held += len(at)
                if held > 1 << 20:
                    keys = [c.slice(low, len(starts)) for c in b.columns[:2]]
                    yield _lists(keys, [starts, hashes], [pa.int32(), pa.int64()], ["starts", "windows"])
                    low, starts, hashes, held = i + 1, [], [], 0
            if starts:
                yield _lists([c.slice(low) for c in b.columns[:2]], [starts, hashes], [pa.int32(), pa.int64()], ["starts", "windows"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, repeats = b.column(1), b.column(2)
            n_words, n_removed, kept, low, held = [], [], [], 0, 0

            def batch(low: int) -> pa.RecordBatch:
                columns = [b.column(0).slice(low, len(kept)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_text"])

            for i in range(len(texts)):
                found = (texts[i].as_buffer() or b"") if texts[i].is_valid else b""
                found = bytes(found).split()
                n = len(found)
                if repeats[i].is_valid:
                    depth = np.zeros(n + 1, np.int32)
                    starts = np.unique(repeats[i].values.to_numpy(zero_copy_only=False))
                    depth[starts] = 1
                    depth[starts + window] -= 1
                    covered = np.cumsum(depth[:n]) > 0
                    found = [found[j] for j in np.flatnonzero(~covered).tolist()]
                n_words.append(n)
                n_removed.append(n - len(found))
                kept.append(b" ".join(found))
                held += len(kept[-1])
                if held > 8 << 20:
                    yield batch(low)
                    low, held = i + 1, 0
                    n_words, n_removed, kept = [], [], []
            if kept:
                yield batch(low)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` as ``(doc_id, part, text)``. Only ids are read where none is repeated."""
    known = docs.filter("doc_id IS NOT NULL")
    reused = materialised(known.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_reused")))
    if reused.isEmpty():
        return docs.select("doc_id", F.lit("").alias("part"), "text")
    digest = F.md5(text_or_empty("text").cast("binary"))
    marked = docs.join(reused, F.col("doc_id") == F.col("_reused"), "left")
    return marked.select("doc_id", F.when(F.col("_reused").isNull(), "").otherwise(digest).alias("part"), "text")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, part, starts)`` for ``keyed`` documents: first words of the windows that a document with a smaller id has too."""
    known = docs.filter("doc_id IS NOT NULL")
    anchors = materialised(known.select(*KEYS, "text").mapInArrow(_anchors(window), f"{_KEYS}, anchors array<bigint>"))
    entries = anchors.select(*KEYS, F.explode("anchors").alias("anchor"))
    spread = entries.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = materialised(spread.filter("low < high").select("anchor"))
    seeds = materialised(entries.join(shared, "anchor").groupBy(*KEYS).agg(F.collect_list("anchor").alias("anchors")))
    near = known.join(seeds, KEYS).select(*KEYS, "text", "anchors")
    windows = materialised(near.mapInArrow(_windows(window), f"{_KEYS}, starts array<int>, windows array<bigint>"))
    each = windows.select(*KEYS, F.explode(F.arrays_zip("starts", "windows")).alias("w"))
    each = each.select(*KEYS, F.col("w.starts").alias("start"), F.col("w.windows").alias("window"))
    spread = each.groupBy("window").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    first = materialised(spread.filter("low < high").select("window", "low"))
    later = each.join(first, "window").filter("doc_id > low")
    return later.groupBy(*KEYS).agg(F.collect_list("start").alias("starts"))


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_words, n_removed, kept_text`` (kept words joined by one space)."""
    prepare(df.sparkSession)
    docs = keyed(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    found = materialised(repeated_windows(docs, window))
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"
    return docs.join(found, KEYS, "left").select("doc_id", "text", "starts").mapInArrow(_cut(window), schema)
