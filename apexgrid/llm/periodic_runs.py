"""Periodic runs of words, found as maximal pairs of a document's suffix order.

A run is a stretch of words with smallest period q, at least ``max(min_length, times * q)`` long, that no neighbouring word
extends with that period.

Method, for each document: a maximal pair is two equal factors of l words at i < j whose left words differ and whose right words
differ. The stretch from i to j + l then has period j - i and cannot be extended, and every run is such a pair, that of its first two periods'
starts: with q = j - i <= l / 2 and q + l >= min_length, a pair *is* a run and needs no extension. The tree of LCP intervals
is walked bottom-up over the sorted suffixes. Two starts in different children of an interval of depth l have exactly l words in common,
so their right words differ; a merge hands the smaller child's positions to the larger one's, and looks for partners with another left word.

Left-word classes: an interval keeps its positions in order, each with its left word. Starts of one factor of l words within l / 2 of each other form
a progression by the factor's period, and all but the first of it have one left word. So of the positions up to l / 2 before i only the
farthest can be of another class than i, and after i there is at most one in another child. Both are one bisection away, and no class
is walked through: a word repeated n times costs n steps, not n^2. A pair at k periods names the same stretch as that at one; the smallest distance stays.

Before that, documents in which no factor of the shortest useful l repeats are set aside by hashes of their factors. Equal
factors have equal hashes, so this drops no run; a false equality costs time only. In the others words are told apart by their bytes.

A document is worked on in one task, without a shuffle: about 200 bytes for each of its words if some factor repeats, otherwise a few
times its text. Other texts of the batch are not held with it.

Cases: a null or empty text has no runs and an empty rest; a very long text is one document as any other; rows with null or repeated
ids are rows of their own; among pairs of one stretch the smallest period stays, and runs are ordered by start, then period; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexgrid.llm import words
from apexgrid.llm.columns import prepare

MIN_LENGTH = 24
TIMES = 3
#: bytes of texts in one batch handed back
RETURNED = 4 << 20

_SCHEMA = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept_text string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def sorted_suffixes(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes in order, and for each the number of words it shares with the one before (0 for the first).

    Prefix doubling; the ranks of each length are kept, and the shared length is put together from them, longest first.
    """
    n = len(ranks)
    rank, levels, width = ranks.astype(np.int32), [], 1
    while True:
        levels.append(rank)
        key = rank.astype(np.int64) * (n + 1)
        if width < n:
            key[: n - width] += rank[width:] + 1
        order = np.argsort(key)
        key = key[order]
        fresh = np.zeros(n, np.int32)
        np.cumsum(key[1:] != key[:-1], out=fresh[1:])
        rank = np.empty(n, np.int32)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        width *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside.copy()
        # a suffix shorter than the width has a rank of its own, so equal ranks are equal words
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = np.where(same, 1 << k, 0)
        shared[1:] += step
        a, b = a + step, b + step
    return order, shared


def runs_of(ids: list[int], min_length: int = MIN_LENGTH, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a sequence of word numbers."""
    if times < 3:
        raise ValueError("a run has three periods at least")
    n, least = len(ids), shortest_factor(min_length, times)
    if n <= least:
        return []
    order, shared = sorted_suffixes(np.unique(np.array(ids, np.int64), return_inverse=True)[1])
    found: dict[tuple[int, int], int] = {}

    def pair(i: int, j: int, l: int) -> None:
        q = j - i
        if q * (times - 1) <= l and q + l >= min_length and (i == 0 or ids[i - 1] != ids[j - 1]):
            stretch = (i, q + l)
            if found.get(stretch, n) > q:
                found[stretch] = q

    def merged(l: int, x: list[int], y: list[int]) -> list[int]:
        few, many = (x, y) if len(x) < len(y) else (y, x)
        away = l // (times - 1)
        for i in few:
            k = bisect_left(many, i - away)
            if k < len(many) and many[k] < i:
                pair(many[k], i, l)
            k = bisect_right(many, i, k)
            if k < len(many) and many[k] - i <= away:
                pair(i, many[k], l)
        for i in few:
            insort(many, i)
        return many

    # only neighbours that share enough: intervals under that depth are never built
    for low, high in _stretches(shared >= least):
        starts, depths = order[low - 1 : high].tolist(), shared[low:high].tolist()
        depths.append(0)
        open_: list[tuple[int, list[int]]] = []
        for start, depth in zip(starts, depths):
            done = [start]
            while open_ and open_[-1][0] > depth:
                l, positions = open_.pop()
                done = merged(l, positions, done)
            if open_ and open_[-1][0] == depth:
                open_[-1] = (depth, merged(depth, open_[-1][1], done))
            elif depth:
                open_.append((depth, done))
    return sorted((i, length, q) for (i, length), q in found.items())


def shortest_factor(min_length: int, times: int) -> int:
    """The smallest l of a pair that is a run, over all periods."""
    return min(max(min_length - q, (times - 1) * q) for q in range(1, min_length + 1))


def _stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    """Ranges in which the mask holds."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def repeating(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each block of texts the number of its first one, and which of them may hold a factor of ``length`` words twice."""
    for low, hashes, borders in words.word_hashes(column):
        n = len(borders) - 1
        factors = words.run_hashes(hashes, length)
        if not len(factors):
            yield low, np.zeros(n, bool)
            continue
        at = np.arange(len(factors))
        text = np.searchsorted(borders, at, "right") - 1
        own = at + length <= borders[text + 1]
        factors, text = factors[own], text[own]
        # one text's factors are told from another's by its number
        keys = factors ^ words.mixed(text.astype(np.uint64) + np.uint64(1))
        ordered = np.sort(keys)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        yield low, np.bincount(text[np.isin(keys, twice)], minlength=n) > 0


def _search(min_length: int, times: int):
    def one(text: bytes, may: bool) -> tuple[list[tuple[int, int, int]], bytes]:
        # bytes are split at the six ASCII white-space characters
        found = text.split()
        if not may:
            return [], b" ".join(found)
        numbers: dict[bytes, int] = {}
        runs = runs_of([numbers.setdefault(w, len(numbers)) for w in found], min_length, times)
        if runs:
            depth = np.zeros(len(found) + 1, np.int64)
            np.add.at(depth, [i + q for i, _, q in runs], 1)
            np.add.at(depth, [i + length for i, length, _ in runs], -1)
            found = [found[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
        return runs, b" ".join(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = shortest_factor(min_length, times)
        for b in batches:
            data, offsets = words.texts_of(b.column(1))
            runs, kept, first, held = [], [], 0, 0

            def out() -> pa.RecordBatch:
                columns = [b.column(0).slice(first, len(kept)), pa.array(runs, pa.list_(_RUN)), pa.array(kept, pa.binary()).cast(pa.string())]
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "kept_text"])

            for low, may in repeating(b.column(1), least):
                for k, m in enumerate(may.tolist(), low):
                    r, text = one(data[offsets[k] : offsets[k + 1]].tobytes(), m)
                    runs.append([{"start": i, "length": length, "period": q} for i, length, q in r])
                    kept.append(text)
                    held += len(text)
                    if held > RETURNED:
                        yield out()
                        first += len(kept)
                        runs, kept, held = [], [], 0
            if kept:
                yield out()

    return run


def find_runs(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, times: int = TIMES
) -> DataFrame:
    """One row per row of ``df``: ``doc_id``, its ``runs`` by start and period, and ``kept_text``, the words that no run holds after its first
    period, joined by one space."""
    prepare(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(_search(min_length, times), _SCHEMA)
