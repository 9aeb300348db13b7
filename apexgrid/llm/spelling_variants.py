"""Spelling variants in a vocabulary: the minimised acceptor, a one-edit transducer and the acceptor again, composed.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of the largest
count (ties: smallest in code-point order), if that is at least ``ratio`` times its own; its root is the last word the forms lead to.

Method: pairs are the paths of the composition acceptor - transducer - acceptor. Before its edit the transducer copies, so both sides read the
same code points; after it they read the same again. With s the length of the shorter word and h = s // 2, a pair shares its first h code points or
its last s - h. So the composition falls apart into independent pieces by the state it is in after those: the initial state of a piece.
Each word enters four of them, for s its length or one less, forwards or backwards (then read from its end). A piece

1. builds the minimal acyclic acceptors of the rests of its words of length s and s + 1, adding sorted words one by one and merging equal states as
   soon as they cannot change any more; every transition carries how many words come before, so a path adds up to the number of its word;
2. walks pairs of states without edit, takes every edit there (two different code points on both sides, or one on the longer side that does
   not also come next on the shorter, so that each pair has one path), and follows the words that both states accept, by explicit stacks. Whether two
   states accept a common word is found once and kept, so no path is followed in vain.

Backward pieces leave out pairs that share the first h code points too: each pair comes from one piece. Pieces of more than ``BLOCK`` words are
dealt as pairs of parts, so a task holds two parts at most and no piece is bounded. Roots are found by jumping: each round
doubles the length of the followed chains, which are short, since counts grow by the ratio with each step.

Cases: null words are left out, an empty word is a word; repeated words are one with their counts added; very long words are as others, in memory and time
linear in their length; texts of any length are cut into words by built-in expressions; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexgrid.llm.columns import prepare
from apexgrid.session import materialised

RATIO = 2
BLOCK = 1 << 15
LETTERS = "[A-Za-zÀ-ÿ]+"
#: pairs handed back at once
RETURNED = 1 << 15

_PIECE = ["back", "short", "half", "one", "other"]
_PAIRS = "word string, near string, near_n bigint"


class Acceptor:
    """Minimal acyclic acceptor of sorted distinct words; ``next[state][symbol]`` is ``(state, words before)``."""

    def __init__(self, words: Sequence[str]):
        self.next: list[dict] = [{}]
        self.final = [False]
        self.accepted = [0]
        self._register: dict[tuple, int] = {}
        path, last = [0], ""
        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            self._close(path, last, same)
            for symbol in word[same:]:
                self.next.append({})
                self.final.append(False)
                self.accepted.append(0)
                self.next[path[-1]][symbol] = len(self.next) - 1
                path.append(len(self.next) - 1)
            self.final[path[-1]] = True
            last = word
        self._close(path, last, 0)
        self._count(0)
        del self._register

    def _close(self, path: list[int], word: str, upto: int) -> None:
        """States of the last word beyond ``upto`` symbols are complete: an equal one takes their place, if there is one."""
        while len(path) > upto + 1:
            state = path.pop()
            key = (self.final[state], *self.next[state].items())
            known = self._register.setdefault(key, state)
            if known == state:
                self._count(state)
            self.next[path[-1]][word[len(path) - 1]] = known

    def _count(self, state: int) -> None:
        before = int(self.final[state])
        for symbol, target in self.next[state].items():
            self.next[state][symbol] = (target, before)
            before += self.accepted[target]
        self.accepted[state] = before


class Composition:
    """Pairs of words of two acceptors that one edit turns into each other, as numbers of the words."""

    def __init__(self, left: Acceptor, right: Acceptor):
        self.left, self.right = left, right
        self._meet: dict[tuple[int, int], bool] = {}

    def _meets(self, p: int, q: int) -> bool:
        """Whether the two states accept a common word."""
        known, left, right = self._meet, self.left, self.right
        todo = [(p, q)]
        while todo:
            at = todo[-1]
            if at not in known:
                verdict, open_ = left.final[at[0]] and right.final[at[1]], None
                if not verdict:
                    other = right.next[at[1]]
                    for symbol, (target, _) in left.next[at[0]].items():
                        if symbol in other:
                            pair = (target, other[symbol][0])
                            met = known.get(pair)
                            if met:
                                verdict = True
                                break
                            if met is None:
                                open_ = pair
                    if not verdict and open_ is not None:
                        todo.append(open_)
                        continue
                known[at] = verdict
            todo.pop()
        return known[p, q]

    def _common(self, p: int, q: int, x: int, y: int, but: str | None = None) -> Iterator[tuple[int, int]]:
        """The words both states accept, the first symbol not being ``but``; x and y count the words before."""
        if not self._meets(p, q):
            return
        todo = [(p, q, x, y, but)]
        while todo:
            p, q, x, y, but = todo.pop()
            if self.left.final[p] and self.right.final[q]:
                yield x, y
            other = self.right.next[q]
            for symbol, (target, before) in self.left.next[p].items():
                if symbol != but and symbol in other:
                    target2, before2 = other[symbol]
                    if self._meets(target, target2):
                        todo.append((target, target2, x + before, y + before2, None))

    def pairs(self, inserted: bool) -> Iterator[tuple[int, int]]:
        """Pairs by a replaced code point, or by one more on the right."""
        todo = [(0, 0, 0, 0)]
        while todo:
            p, q, x, y = todo.pop()
            here, there = self.left.next[p], self.right.next[q]
            for symbol, (target2, before2) in there.items():
                if symbol in here:
                    target, before = here[symbol]
                    todo.append((target, target2, x + before, y + before2))
                if inserted:
                    yield from self._common(p, target2, x, y + before2, symbol)
                else:
                    for symbol1, (target, before) in here.items():
                        if symbol1 != symbol:
                            yield from self._common(target, target2, x + before, y + before2)


def piece_pairs(rows: list[tuple[int, str, int]], back: bool, short: int, one: int, other: int) -> Iterator[tuple[str, str, int]]:
    """``(word, near, near_n)`` in both directions, for rows ``(part, word, n)`` of a piece."""
    half = short // 2
    rest = (lambda w: w[: len(w) - (short - half)][::-1]) if back else (lambda w: w[half:])
    parts = {}
    for part in {one, other}:
        for longer in (False, True):
            own = sorted((rest(w), w, n) for p, w, n in rows if p == part and (len(w) > short) == longer)
            parts[part, longer] = own, Acceptor([r[0] for r in own])

    def found(a: tuple[int, bool], b: tuple[int, bool], inserted: bool) -> Iterator[tuple[tuple, tuple]]:
        (left, first), (right, second) = parts[a], parts[b]
        if left and right:
            for i, j in Composition(first, second).pairs(inserted):
                if not (back and left[i][1][:half] == right[j][1][:half]):
                    yield left[i], right[j]

    if one == other:
        # composed with itself an acceptor gives every pair in both directions
        yield from ((x[1], y[1], y[2]) for x, y in found((one, False), (one, False), False))
        ways = [((one, False), (one, True), True)]
    else:
        ways = [((one, False), (other, False), False), ((one, False), (other, True), True), ((other, False), (one, True), True)]
    for way in ways:
        for x, y in found(*way):
            yield x[1], y[1], y[2]
            yield y[1], x[1], x[2]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held, out = None, [], []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"]
        )
        out.clear()
        return batch

    def settle() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            back, short, _, one, other = key
            for row in piece_pairs(held, back, short, one, other):
                out.append(row)
                if len(out) == RETURNED:
                    yield flush()

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in [*_PIECE, "part", "word", "n"])):
            if row[:5] != key:
                yield from settle()
                key, held = row[:5], []
            held.append(row[5:])
    yield from settle()
    if out:
        yield flush()


def near_pairs(counts: DataFrame) -> DataFrame:
    """``(word, near, near_n)``, every pair of near words of ``counts(word, n)`` in both directions, once."""
    size = F.length("word")

    def piece(back: bool, less: int) -> Column:
        short = size - less
        half = F.floor(short / 2).cast("int")
        shared = F.substring("word", less + half + 1, F.lit(1 << 30)) if back else F.substring("word", F.lit(1), half)
        return F.struct(F.lit(back).alias("back"), short.alias("short"), shared.alias("half"))

    pieces = F.array(*(piece(back, less) for back in (False, True) for less in (0, 1)))
    entries = counts.select("word", "n", F.explode(pieces).alias("p")).select("word", "n", "p.*").filter("short >= 0")
    names = ["back", "short", "half"]
    large = materialised(entries.groupBy(*names).agg(F.count("*").alias("k")).filter(F.col("k") > BLOCK))
    parts = F.coalesce(F.floor(F.col("k") / BLOCK) + 1, F.lit(1)).cast("int")
    known = entries.join(large, names, "left").withColumn("parts", parts)
    known = known.withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    dealt = known.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *names, F.least("part", "o").alias("one"), F.greatest("part", "o").alias("other"), "part", "word", "n"
    )
    dealt = dealt.repartition(*_PIECE).sortWithinPartitions(*_PIECE)
    return dealt.mapInArrow(_near, _PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every word of ``forms(word, form)``, whose chains end."""
    tops = materialised(forms.select("word", F.col("form").alias("root")))
    while True:
        above = tops.select(F.col("word").alias("root"), F.col("root").alias("_above"))
        tops = materialised(tops.join(above, "root", "left").select("word", F.coalesce("_above", "root").alias("root"), "_above"))
        if tops.filter("_above IS NOT NULL").isEmpty():
            return tops.select("word", "root")
        tops = tops.select("word", "root")


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word of ``counts(word, n)``: ``word, form, root, n, n_near, form_n``."""
    prepare(counts.sparkSession)
    known = counts.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    known = materialised(known)
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near")))
    near = near_pairs(known).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    strong = -F.col("best.minus_n") >= F.col("n") * ratio
    with_form = materialised(
        known.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(strong, F.col("best.near")).alias("form"),
            F.when(strong, -F.col("best.minus_n")).alias("form_n"),
        )
    )
    ends = roots(with_form.filter("form IS NOT NULL").select("word", "form"))
    return with_form.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def letter_runs(text: str | Column) -> Column:
    """The maximal runs of Latin letters of a text, with A to Z in lower case; null has none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    whole = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), upper, upper.lower())
    return F.regexp_extract_all(whole, F.lit(LETTERS), F.lit(0))
