"""Document quality by regularised quadratic discriminant analysis.

Method: every document becomes a vector of transformed statistics (lengths, rates of kinds of characters, repetition). For
each class the counts, sums and products of these are aggregated over all labelled training rows, which gives its mean and
covariance; covariances are shrunk towards the pooled one and towards a multiple of the unit matrix. The score is the
difference of the two classes' log densities (Mahalanobis distances by cached Cholesky factors) plus the log
ratio of the class sizes, divided by ``TEMPERATURE`` (densities multiply statistics that depend on each other and
would otherwise answer 0 or 1 only) and brought to 0..1 by the logistic function.

Texts are read once, in whole; the statistics (``len(NAMES)`` doubles per document) are kept as a table for fitting and
scoring. What reaches the driver are the sums: about ``len(NAMES)^2`` numbers per class, whatever the input. Only the text
enters a score.

Cases: null text is empty and is scored like any text (all rates 0); documents without label, with a null label, or with
another label than 0 or 1 are scored but not learnt from; if one class has no training rows the other class's label is
the score, without training rows 0.5; a null id is not held out; rows with equal ids are scored each by their own text; an empty table
gives no rows; other columns are ignored. A very long text is summed up piece by piece; besides the text itself its word hashes are held, 8 bytes a word.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from apexgrid.llm import words
from apexgrid.llm.columns import prepare
from apexgrid.session import materialised

THRESHOLD = 0.3
TEMPERATURE = 16.0
TO_POOLED = 0.1
TO_UNIT = 0.05
FOLDS = 5
#: labelled rows that the filter learns from
LEARNT_FROM = 50_000

NAMES = (
    "log_bytes",
    "log_words",
    "log_word_length",
    "distinct_words",
    "same_as_previous",
    "repeated_pairs",
    "upper_case",
    "digits",
    "sentence_marks",
    "exclamations",
    "other_marks",
    "mark_words",
    "lines",
    "not_ascii",
)

_UPPER = np.frombuffer(string.ascii_uppercase.encode(), np.uint8)
_LETTERS = np.frombuffer(string.ascii_letters.encode(), np.uint8)


def _flags(members: bytes | np.ndarray) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[np.frombuffer(members, np.uint8) if isinstance(members, bytes) else members] = 1
    return table


_MARKS = string.punctuation.encode()
_CLASSES = {
    "upper": _flags(_UPPER),
    "letter": _flags(_LETTERS),
    "digit": _flags(string.digits.encode()),
    "sentence": _flags(b".,;:?'\"-()"),
    "exclamation": _flags(b"!"),
    "other": _flags(bytes(set(_MARKS) - set(b".,;:?!'\"-()"))),
    "line": _flags(b"\n"),
    "wide": _flags(np.arange(128, 256)),
}
_IS_MARK = _flags(_MARKS).astype(bool)


def _rate(count, total) -> np.ndarray:
    """Log of a rate. Few observations are drawn to a low rate, and rates below about a hundredth together."""
    return np.log((np.asarray(count, float) + 0.2) / (np.asarray(total) + 20) + 0.01)


def _sums(part: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For texts end to end: bytes, words, bytes in words, words of marks only, then the bytes of each class."""
    columns = [np.diff(own)]
    starts, ends = words.spans(part, own)
    at = np.searchsorted(starts, own)
    columns.append(np.diff(at))
    in_words = np.concatenate([[0], np.cumsum(ends - starts)])
    columns.append(in_words[at[1:]] - in_words[at[:-1]])
    # a word without letters or digits: as many marks as bytes
    marks = np.zeros(len(part) + 1, np.int64)
    np.cumsum(_IS_MARK[part], out=marks[1:])
    only_marks = np.concatenate([[0], np.cumsum(marks[ends] - marks[starts] == ends - starts)])
    columns.append(only_marks[at[1:]] - only_marks[at[:-1]])
    for table in _CLASSES.values():
        total = np.zeros(len(part) + 1, np.int64)
        np.cumsum(table[part], out=total[1:])
        columns.append(total[own[1:]] - total[own[:-1]])
    return np.stack(columns, axis=1)


def _distinct(values: np.ndarray) -> int:
    """Number of distinct hashes; many are taken by ranges, so that only a part is copied and sorted at once."""
    if len(values) <= words.BLOCK_BYTES:
        return len(np.unique(values))
    ranges = (values >> np.uint64(60)).astype(np.uint8)
    return sum(len(np.unique(values[ranges == r])) for r in range(16))


def statistics(column: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of rows with one column for each of ``NAMES``."""
    data, offsets = words.texts_of(column)
    for low, hashes, borders in words.word_hashes(column):
        n = len(borders) - 1
        part, own = data[offsets[low] : offsets[low + n]], offsets[low : low + n + 1] - offsets[low]
        if n == 1 and len(part) > words.BLOCK_BYTES:
            # cut at white space, so words and their sums stay whole
            sums = sum(_sums(p, np.array([0, len(p)])) for p in words._pieces(part))
        else:
            sums = _sums(part, own)
        size, n_words, in_words, only_marks = sums[:, :4].T
        count = dict(zip(_CLASSES, sums[:, 4:].T))
        distinct, same, pairs = np.zeros(n), np.zeros(n), np.zeros(n)
        for i in range(n):
            w = hashes[borders[i] : borders[i + 1]]
            distinct[i] = _distinct(w)
            if len(w) > 1:
                same[i] = (w[1:] == w[:-1]).sum()
                pairs[i] = len(w) - 1 - _distinct(w[1:] * np.uint64(3) + w[:-1])
        yield np.stack(
            [
                np.log1p(size),
                np.log1p(n_words),
                np.log1p(in_words / np.maximum(n_words, 1)),
                np.log1p(distinct) / np.log(n_words + 2),
                _rate(same, n_words),
                _rate(pairs, n_words),
                _rate(count["upper"], count["letter"]),
                _rate(count["digit"], size),
                _rate(count["sentence"], size),
                _rate(count["exclamation"], size),
                _rate(count["other"], size),
                _rate(only_marks, n_words),
                _rate(count["line"], n_words),
                _rate(count["wide"], size),
            ],
            axis=1,
        )


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = list(statistics(b.column(1)))
        x = np.concatenate(found) if found else np.zeros((0, len(NAMES)))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "x"])


@dataclass
class Discriminant:
    """Centre, inverse Cholesky factor and log density constant of class 0 and 1, for standardised statistics."""

    shift: np.ndarray
    scale: np.ndarray
    centres: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.shift) / self.scale
        density = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.centres, self.factors, self.constants)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -700, 700)))


def discriminant(n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
    """From counts (2), sums (2, d) and sums of products (2, d, d) of the classes."""
    d = sums.shape[1]
    none = np.zeros(0)
    if (n == 0).any():
        return Discriminant(none, none, none, none, none, 0.5 if not n.any() else float(n[1] > 0))
    means = sums / n[:, None]
    scatter = products - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    shift = means.mean(axis=0)
    pooled = pooled / np.outer(scale, scale)
    centres, factors, constants = (means - shift) / scale, [], []
    for c in (0, 1):
        own = scatter[c] / n[c] / np.outer(scale, scale)
        own = (1 - TO_POOLED) * own + TO_POOLED * pooled
        own = (1 - TO_UNIT) * own + TO_UNIT * max(np.trace(own) / d, 1e-3) * np.eye(d)
        lower = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n[c] / n.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(shift, scale, centres, np.array(factors), np.array(constants))


def fit(examples: DataFrame) -> Discriminant:
    """From all rows of ``examples(x, quality)``; labels other than 0 and 1 are left out."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("x")[i] for i in range(d)]
    sums = examples.filter("quality IN (0, 1)").groupBy("quality").agg(
        F.count("*").alias("n"), *(F.sum(c) for c in x), *(F.sum(x[i] * x[j]) for i, j in pairs)
    )
    n, first, second = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for row in sums.collect():
        c = int(row[0])
        n[c], first[c] = row[1], row[2 : 2 + d]
        for (i, j), v in zip(pairs, row[2 + d :]):
            second[c, i, j] = second[c, j, i] = v
    return discriminant(n, first, second)


def held_out(doc_id: str | Column) -> Column:
    fold = F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == 0, F.lit(False))


def scored(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id, held_out, score, predicted``. Labels of held-out rows are not used."""
    prepare(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    known = materialised(docs.mapInArrow(words.returning_memory(_statistics), "doc_id bigint, x array<double>"))
    training = labels.select(F.col("doc_id").alias("_id"), "quality").filter(~held_out("_id"))
    model = fit(known.join(training, F.col("doc_id") == F.col("_id")))
    d = len(NAMES)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    out = known.mapInArrow(score, "doc_id bigint, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", learnt_from: int = LEARNT_FROM) -> DataFrame:
    """The rows of ``df`` that are not rejected, with all their columns, each judged by its own text whatever its id.

    The model is learnt from about ``learnt_from`` labelled ids, or all where there are no more, picked by a hash of the id (of several labels of one id the
    smaller counts); then
    the texts are scored and filtered in one pass, without a join.
    """
    prepare(df.sparkSession)
    known = labels.select(F.col("doc_id").alias("_id"), "quality").filter("quality IN (0, 1)").filter(~held_out("_id"))
    known = materialised(known.filter("_id IS NOT NULL").groupBy("_id").agg(F.min("quality").alias("quality")))
    share = min(1.0, learnt_from / max(known.count(), 1))
    # bounded by learnt_from, up to chance, so it may be broadcast and the texts stay where they are
    picked = F.broadcast(known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < share * (1 << 20)))
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    examples = docs.join(picked, F.col("doc_id") == F.col("_id")).select("doc_id", "text")
    examples = materialised(examples.mapInArrow(words.returning_memory(_statistics), "doc_id bigint, x array<double>"))
    model = fit(examples.join(picked, F.col("doc_id") == F.col("_id")))

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        found = [model.score(x) for x in statistics(texts)]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return df.filter(score(df[text]) >= THRESHOLD)
