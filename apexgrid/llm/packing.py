"""Packing of tokenised documents into fixed-size sequences by the sum-of-squares rule.

Method: every task packs the documents it reads, online. A level array counts the open sequences at each fill level; a
piece goes to the level (or a new sequence) for which the sum of the squared counts comes out smallest. A document
longer than a sequence first gives whole sequences of its own; its remainder is the piece to place. When a task ends,
or when more than ``MAX_OPEN`` sequences are open, the emptiest of them are cut to fill the fullest, so that a task
leaves at most one sequence with padding each time.

There is no shuffle: input rows never leave their task. Memory per task is bounded by ``MAX_OPEN`` sequences, one Arrow
batch and a word cache bounded by ``CACHE_WORDS`` and ``CACHE_BYTES``, which goes when the task ends. Sequence ids are ``(partition << 40) + running number``: unique, and the same when a task
is run again on the same input split. Write the result (or the input) before using it twice if the input's
partitioning is not repeatable.

Cases: null text is empty; a document without words is the end token alone; null and repeated document ids are kept as
they are, each row is a document of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexgrid.llm import words
from apexgrid.llm.columns import prepare

CAPACITY = 2048
END = 1
MAX_OPEN = 4096
#: words, and bytes of words and ids, at which a worker empties its cache
CACHE_WORDS = 200_000
CACHE_BYTES = 24 << 20
TEXT_BLOCK = 8 << 20

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"

# letters that lower-case to one letter and are composed already
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
_LOWERED = re.compile("[a-zß-öø-ÿ]+")
_PUNCTUATION = string.punctuation


def _byte_letters() -> dict[int, str]:
    """The letters by which a byte-level vocabulary writes bytes: printable Latin-1 as itself, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokenizer:
    """Token ids of white-space-delimited words, equal to those of the whole text.

    The vocabulary's rules drop white space and never look across it, so texts are encoded word by word, and words
    met before come from a bounded cache. A word of plain letters with punctuation behind it is two parts, each of
    which goes to the vocabulary's merge model directly; any other word is one part that goes through the tokenizer's
    full ``encode``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.forget()

    def forget(self) -> None:
        """Empty the cache: the code of a part, and the ids of part c at ``first[c]:first[c] + size[c]``. Code 0 is nothing."""
        self.codes: dict[str, int] = {"": 0}
        self.ids, self.size = array("I"), array("I", [0])
        self.held = 0

    def _new(self, part: str) -> int:
        if part.isascii() and (part.isalpha() or not part.strip(_PUNCTUATION)):
            ids = [t.id for t in self.model.tokenize(part)]
        elif _LOWERED.fullmatch(part):
            ids = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        self.ids.extend(ids)
        self.size.append(len(ids))
        self.held += 4 * len(part) + 4 * len(ids)
        code = self.codes[part] = len(self.size) - 1
        return code

    def _coded(self, parts: pa.Array) -> np.ndarray:
        parts = parts.dictionary_encode()
        get = self.codes.get
        codes = [self._new(p) if (c := get(p)) is None else c for p in parts.dictionary.to_pylist()]
        return np.array(codes, np.int64)[parts.indices.to_numpy(zero_copy_only=False)]

    def texts(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a block of non-null strings."""
        lists = pc.ascii_split_whitespace(column)
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return [np.zeros(0, np.uint32)] * len(column)
        if len(self.codes) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.forget()
        words = coded.dictionary
        core = pc.ascii_rtrim(words, characters=_PUNCTUATION)
        plain = pc.match_substring_regex(core, f"^[{_LETTERS}]+$")
        head = self._coded(pc.if_else(plain, pc.utf8_lower(core), words))
        tail = self._coded(pc.if_else(plain, pc.replace_substring_regex(words, f"^[{_LETTERS}]+", ""), ""))
        size = np.frombuffer(self.size, np.uint32).astype(np.int64)
        flat = np.frombuffer(self.ids, np.uint32) if len(self.ids) else np.zeros(0, np.uint32)
        parts = np.stack([head, tail], 1).ravel()
        each = size[parts]
        ends = np.cumsum(each)
        own = flat[np.repeat((np.cumsum(size) - size)[parts] - (ends - each), each) + np.arange(ends[-1])]
        of_word = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends[1::2]]), pa.int32()), pa.array(own))
        ids = of_word.take(coded.indices)
        borders = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        cuts, ids = ids.offsets.to_numpy()[borders], ids.values.to_numpy(zero_copy_only=False)
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text of a batch, in blocks of bounded size; null is empty."""
        column = column.fill_null("")
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        low, n = 0, len(column)
        ends = np.cumsum(sizes)
        while low < n:
            done = ends[low - 1] if low else 0
            high = min(max(int(np.searchsorted(ends, done + TEXT_BLOCK, "right")), low + 1), n)
            if high - low == 1 and sizes[low] > TEXT_BLOCK:
                data, _ = words.texts_of(column.slice(low, 1))
                pieces = [self.texts(pa.array([p.tobytes()], pa.binary()).cast(pa.string()))[0] for p in words._pieces(data)]
                yield np.concatenate(pieces)
            else:
                yield from self.texts(column.slice(low, high - low))
            low = high


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, kept across its tasks; its cache of words is not."""
    return WordTokenizer(path)


class _Window:
    __slots__ = ("fill", "parts")

    def __init__(self):
        self.fill, self.parts = 0, []

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.parts.append((doc, start, ids, total))
        self.fill += len(ids)


class SumOfSquares:
    """Open sequences by fill level. ``place`` gives a sequence when it becomes full."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[_Window]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """Fill level to put a piece on; 0 opens a sequence. Of equally good levels the highest."""
        top = self.capacity - size
        if top == 0:
            return 0
        counts = self.counts
        # change of the sum of squares, less 2, when a sequence moves from level h to level h + size
        change = 2 * (counts[size + 1 : self.capacity + 1] - counts[1 : top + 1])
        # a sequence that becomes full leaves the sum
        change[-1] -= 1
        change[counts[1 : top + 1] == 0] = np.iinfo(np.int64).max
        best = top - int(np.argmin(change[::-1]))
        fresh = 2 * counts[size] - 1
        return best if counts[best] and change[best - 1] <= fresh else 0

    def place(self, doc, start: int, ids: np.ndarray, total: int) -> _Window | None:
        level = self.level_for(len(ids))
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            window = _Window()
        window.add(doc, start, ids, total)
        if window.fill == self.capacity:
            return window
        self.open[window.fill].append(window)
        self.counts[window.fill] += 1
        self.n_open += 1
        return None

    def finish(self) -> Iterator[_Window]:
        """All open sequences; the emptiest are cut to fill the fullest."""
        left = [w for level in self.open for w in level]
        low = 0
        for high in range(len(left) - 1, -1, -1):
            window = left[high]
            while low < high and window.fill < self.capacity:
                donor = left[low]
                doc, start, ids, total = donor.parts.pop()
                room = self.capacity - window.fill
                if len(ids) > room:
                    donor.parts.append((doc, start + room, ids[room:], total))
                    ids = ids[:room]
                donor.fill -= len(ids)
                window.add(doc, start, ids, total)
                if not donor.parts:
                    low += 1
            if window.parts:
                yield window
            if high <= low:
                break
        self.counts[:] = 0
        self.open = [[] for _ in range(self.capacity + 1)]
        self.n_open = 0


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of the documents with their place: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit token ids; the document's last one is ``END``. A sequence is its pieces by
    ``offset``, padded to ``capacity``.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = word_tokenizer(tokenizer_path)
        packer = SumOfSquares(capacity)
        number = TaskContext.get().partitionId() << 40
        schema = pa.schema(
            [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
            + [("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
        )
        rows: list[tuple] = []
        held = 0

        def emit(window: _Window) -> None:
            nonlocal number, held
            offset = 0
            for doc, start, ids, total in window.parts:
                rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, number, offset))
                offset += len(ids)
            held += offset
            number += 1

        def batch() -> pa.RecordBatch:
            nonlocal held
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            held = 0
            return out

        for b in batches:
            docs = b.column(0).to_pylist()
            for doc, ids in zip(docs, tokens.column(b.column(1))):
                ids = np.append(ids, np.uint32(END))
                total = len(ids)
                for start in range(0, total - capacity + 1, capacity):
                    window = _Window()
                    window.add(doc, start, ids[start : start + capacity], total)
                    emit(window)
                start = total - total % capacity
                if start < total:
                    # a copy, so that an open sequence does not keep the whole document
                    full = packer.place(doc, start, ids[start:].copy(), total)
                    if full:
                        emit(full)
                    if packer.n_open > MAX_OPEN:
                        for window in packer.finish():
                            emit(window)
                if held > 1 << 21:
                    yield batch()
        for window in packer.finish():
            emit(window)
            if held > 1 << 21:
                yield batch()
        if rows:
            yield batch()
        tokens.forget()

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(words.returning_memory(run), PIECES)
