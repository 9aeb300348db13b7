"""Near-duplicate documents by min-max hashing, with every link confirmed on the full shingle sets.

Method: a permutation of the shingles gives two signature values, the minimum and the maximum of the hashed set, so
``PERMUTATIONS`` hash evaluations per shingle give twice as many values. Each of the two agrees between two sets with a
probability equal to their Jaccard similarity, and the two estimates vary against each other, which lowers the variance of
their mean. ``2 * PERMUTATIONS / ROWS`` bands of ``ROWS`` values make the candidate buckets: at the threshold of 0.75 a
pair escapes all 48 bands with probability (1 - 0.75^5)^48, about 2 in a million, and above it sooner far less.

1. One pass over the texts: set size, digest of the word sequence, band keys. Texts of equal word sequence are one class from
   here on; its smallest id stands for it. Copies are never paired.
2. Band keys are grouped with a map-side minimum and maximum; a key that more than one class holds is a bucket.
3. In each bucket every class is compared with the bucket's centre (its smallest id), and links that hold on the full sets join
   groups. A large group of near copies falls into one group this way with a number of comparisons linear in its size. While
   the buckets still hold very many pairs of different groups, they get further centres, round by round.
4. What is left, the pairs of different groups in a bucket, is settled too. The entries outside the bucket's largest group are
   held against all entries of the bucket by counts of their shingles in ``CLASSES`` hash classes: two sets cannot share more than the sum
   of the smaller counts. Only pairs that this bound lets through, each in the first bucket it shares, are compared in full. So no
   candidate pair is passed over unless it is one group already or cannot be a link, and pairs are never listed.

Comparison streams: pairs are dealt by (centre, chunk of partners) and sorted, the centre's set comes first, and one
set at a time is held. A centre has a chunk for every ``PARTNERS`` partners, so its set is copied that seldom and a hot centre is spread all the same.

Cases: null text is empty; a text without words has size 0 and is linked with nothing; where an id has several texts, each is linked
by itself: texts are numbered by (id, digest), and of texts that share the smallest id of a group one stays; rows with a null id keep null as their component and are linked with nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from apexgrid.llm import words
from apexgrid.llm.columns import prepare
from apexgrid.session import materialised

SHINGLE = 5
PERMUTATIONS = 120
ROWS = 5
PERCENT = 75
#: partners of a centre that a task compares; the centre's set travels once for each such chunk
PARTNERS = 64
#: rounds with one centre per bucket go on while all pairs would be more than this many times the bucket entries
PAIRS_PER_ENTRY = 4096
MAX_ROUNDS = 6
CLASSES = 1024
#: entries that a task holds against the rest of a bucket at once
TOGETHER = 512

_random = np.random.default_rng(23)
_FACTORS = _random.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)

_SIGNATURES = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"


def shingle_sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, as sorted 64-bit hashes, and the hashes of its words in order."""
    for _, hashes, borders in words.word_hashes(column, lower=True):
        runs = words.run_hashes(hashes, SHINGLE)
        for low, high in zip(borders[:-1].tolist(), borders[1:].tolist()):
            if high - low >= SHINGLE:
                yield np.unique(runs[low : high - SHINGLE + 1]), hashes[low:high]
            elif high > low:
                yield words.run_hashes(hashes[low:high], high - low, seed=100 + high - low), hashes[low:high]
            else:
                yield hashes[:0], hashes[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima under the permutations, then the maxima, so that a band never holds both of one permutation, which in small
    sets depend on each other; the set is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    for start in range(0, len(x), 2048):
        values = _FACTORS[:, None] * x[None, start : start + 2048]
        values += _SHIFTS[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ``ROWS`` values, different for equal values in different bands."""
    bands = values.reshape(-1, ROWS).astype(np.uint64)
    key = words.mixed(np.arange(1, len(bands) + 1, dtype=np.uint64))
    for j in range(ROWS):
        key = words.mixed(key ^ bands[:, j] + np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, digests, keys, offsets = [], [], [], [0]
        for shingles, sequence in shingle_sets(b.column(1)):
            sizes.append(len(shingles))
            digests.append(_sequence_digest(sequence))
            if len(shingles):
                keys.append(band_keys(signature(shingles)))
            offsets.append(offsets[-1] + (len(keys[-1]) if len(shingles) else 0))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
            ],
            names=["doc_id", "n_shingles", "digest", "bands"],
        )


def _sequence_digest(sequence: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(sequence.tobytes(), digest_size=16).digest() if len(sequence) else b""


def word_digest(text: str | Column) -> Column:
    """Digest of the word sequence, as in the signatures."""

    @F.arrow_udf(BinaryType())
    def digest(texts: pa.Array) -> pa.Array:
        return pa.array([_sequence_digest(sequence) for _, sequence in shingle_sets(texts)], pa.binary())

    return digest(text)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, bytes of the sorted shingle hashes); rows leave as soon as a few megabytes are together."""
    for b in batches:
        ids, sets, low, held = b.column(0), [], 0, 0
        for shingles, _ in shingle_sets(b.column(1)):
            sets.append(shingles.tobytes())
            held += len(sets[-1])
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([ids.slice(low, len(sets)), pa.array(sets, pa.binary())], names=["rep", "shingles"])
                low, sets, held = low + len(sets), [], 0
        if sets:
            yield pa.RecordBatch.from_arrays([ids.slice(low), pa.array(sets, pa.binary())], names=["rep", "shingles"])


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _count_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of shingles in each hash class; empty, which bounds nothing, if one exceeds a byte."""
    shift = np.uint64(64 - (CLASSES - 1).bit_length())
    for b in batches:
        out = []
        for i in range(b.num_rows):
            counts = np.bincount((np.frombuffer(b.column(1)[i].as_buffer(), np.uint64) >> shift).astype(np.int64), minlength=CLASSES)
            out.append(counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["rep", "classes"])


def _most_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of the smaller counts, for all rows of x against all rows of y."""
    total = np.zeros((len(x), len(y)), np.float32)
    for level in range(1, int(min(x.max(), y.max())) + 1):
        # classes that reach the level in both
        total += (x >= level).astype(np.float32) @ (y >= level).astype(np.float32).T
    return total


_HELD = ["bucket", "chunk", "turn", "rep", "n", "component", "small", "classes", "bands"]


def _let_through(percent: int):
    """Rows of ``_HELD``, sorted by bucket, chunk and turn: those of turn 0 against those of turn 1."""

    def rows_of(b: pa.RecordBatch, low: int, high: int) -> dict:
        b = b.slice(low, high - low)
        classes = [np.frombuffer(c, np.uint8) if c else np.full(CLASSES, 255, np.uint8) for c in b.column("classes").to_pylist()]
        numbers = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "n", "component", "small")}
        numbers["counted"] = np.array([bool(c) for c in b.column("classes").to_pylist()])
        bands = b.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(high - low, -1)
        return numbers | {"classes": np.stack(classes), "bands": bands}

    def pairs(x: dict, y: dict, bucket: int) -> tuple[list, list]:
        nx, ny = x["n"][:, None], y["n"][None, :]
        fits = (x["component"][:, None] != y["component"]) & (~y["small"][None, :] | (x["rep"][:, None] < y["rep"]))
        fits &= (nx * 100 >= ny * percent) & (ny * 100 >= nx * percent)
        if not fits.any():
            return [], []
        most = np.minimum(_most_common(x["classes"], y["classes"]), np.minimum(nx, ny))
        # 255 stands for any count: with two such sets the sum is no bound
        most = np.where(x["counted"][:, None] | y["counted"][None, :], most, np.minimum(nx, ny))
        fits &= most * 100 >= (nx + ny - most) * percent
        i, j = np.nonzero(fits)
        if len(i):
            same = x["bands"][i] == y["bands"][j]
            here = x["bands"][i, same.argmax(axis=1)] == bucket
            i, j = i[here], j[here]
        return np.minimum(x["rep"][i], y["rep"][j]).tolist(), np.maximum(x["rep"][i], y["rep"][j]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asking = None, []
        for b in batches:
            bucket, chunk, turn = (b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "chunk", "turn"))
            changed = (bucket[1:] != bucket[:-1]) | (chunk[1:] != chunk[:-1]) | (turn[1:] != turn[:-1])
            borders = [0, *(np.flatnonzero(changed) + 1).tolist(), len(bucket)]
            lows, highs = [], []
            for low, high in zip(borders[:-1], borders[1:]):
                if (bucket[low], chunk[low]) != key:
                    key, asking = (bucket[low], chunk[low]), []
                for at in range(low, high, TOGETHER):
                    part = rows_of(b, at, min(at + TOGETHER, high))
                    if turn[low] == 0:
                        asking.append(part)
                    else:
                        for x in asking:
                            a, o = pairs(x, part, int(bucket[low]))
                            lows += a
                            highs += o
            if lows:
                yield pa.RecordBatch.from_arrays([pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], names=["a", "b"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    centre, whole = None, None
    for b in batches:
        centres, others = b.column(0).to_pylist(), b.column(1).to_pylist()
        out = []
        for i, (c, o) in enumerate(zip(centres, others)):
            if o is None:
                # a copy, since the batch goes away
                centre, whole = c, np.frombuffer(b.column(2)[i].as_py(), np.uint64)
            else:
                assert c == centre
                part = np.frombuffer(b.column(2)[i].as_buffer(), np.uint64)
                out.append((c, o, len(whole), len(part), shared(whole, part)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b", "na", "nb", "common"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, na, nb, common)`` of the distinct ``pairs(a, b)``: sizes of their sets in ``sets(rep, shingles)`` and of the
    intersection."""
    chunks = pairs.groupBy("a").agg((F.floor(F.count("*") / PARTNERS) + 1).alias("chunks"))
    dealt = pairs.join(chunks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "chunks").alias("chunk"))
    partners = dealt.join(sets, dealt.b == sets.rep).select("a", "b", "shingles", "chunk")
    centres = dealt.select("a", "chunk").distinct()
    centres = centres.join(sets, centres.a == sets.rep).select("a", F.lit(None).cast("bigint").alias("b"), "shingles", "chunk")
    together = partners.unionByName(centres).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return together.select("a", "b", "shingles").mapInArrow(words.returning_memory(_compare), "a bigint, b bigint, na bigint, nb bigint, common bigint")


def components(links: DataFrame) -> DataFrame:
    """``(rep, component)`` of every node of ``links(a, b)``: its smallest reachable node.

    Alternating rounds of large and small stars: every node sends its neighbours the smallest of them all, with
    map-side minima, until only stars are left. A few rounds are enough, since a round roughly squares the reach.
    """
    edges = links.filter("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    while True:
        edges = materialised(edges)
        # in stars no node has two lower ones, or a lower and a higher one
        ends = edges.select(F.col("high").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            edges.select("low", F.lit(0), F.lit(1))
        )
        ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.filter("up + down > 1 AND up > 0").isEmpty():
            break
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).union(edges.select("high", "low"))
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).filter("low < high")
        edges = small.union(least.select(F.col("u").alias("high"), F.col("m").alias("low"))).select("low", "high").distinct()
    tops = edges.select(F.col("high").alias("rep"), F.col("low").alias("component"))
    return tops.union(edges.select("low", "low").distinct())


def _groups_so_far(links: DataFrame) -> DataFrame:
    """``(rep, component)`` by two steps to the smallest neighbour: parts of components, for what need not be compared any more."""
    least = links.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("component")).filter("component < rep")
    above = least.select(F.col("rep").alias("component"), F.col("component").alias("_top"))
    return least.join(above, "component", "left").select("rep", F.coalesce("_top", "component").alias("component"))


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_shingles, component_id, kept``."""
    prepare(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = materialised(docs.mapInArrow(words.returning_memory(_signatures), _SIGNATURES))
    return _labelled(docs, signed, _reused(signed), percent).drop("digest")


def _reused(signed: DataFrame) -> DataFrame | None:
    """Ids of several rows, or None where there are none."""
    found = materialised(signed.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    return None if found.isEmpty() else found


def _labelled(docs: DataFrame, signed: DataFrame, reused: DataFrame | None, percent: int) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, digest`` of ``docs(doc_id, text)``."""
    if reused is None:
        return _linked(docs, signed, percent)
    # each text of an id becomes a document of its own; numbers in the order of the ids
    pairs = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "digest").distinct()
    # numbered in the sorted tasks, since files are read back in any order
    nodes = materialised(pairs.orderBy("doc_id", "digest").select("doc_id", "digest", F.monotonically_increasing_id().alias("node")))
    known = docs.filter("doc_id IS NOT NULL").withColumn("digest", word_digest("text"))
    numbered = materialised(known.join(nodes, ["doc_id", "digest"]).select(F.col("node").alias("doc_id"), "text"))
    own = materialised(signed.join(nodes, ["doc_id", "digest"]).select(F.col("node").alias("doc_id"), "n_shingles", "digest", "bands"))
    # rows repeated with id and text are one node
    found = _linked(numbered.dropDuplicates(["doc_id"]), own.dropDuplicates(["doc_id"]), percent)
    top = nodes.select(F.col("node").alias("component_id"), F.col("doc_id").alias("_top"))
    found = found.select(F.col("doc_id").alias("node"), "component_id", "kept").join(top, "component_id").select("node", "_top", "kept")
    labels = nodes.join(found, "node").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "_top", "kept")
    same = (F.col("doc_id") == F.col("_id")) & (F.col("digest") == F.col("_digest"))
    component, kept = F.coalesce("_top", "doc_id").alias("component_id"), F.coalesce("kept", F.lit(True)).alias("kept")
    return signed.join(labels, same, "left").select("doc_id", "n_shingles", component, kept, "digest")


def _linked(docs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """As ``_labelled``; ids are unique."""
    linkable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialised(linkable.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    # the representative's row has the bands of its class; joined by id, so a large class is no hot key
    own = linkable.join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi")
    entries = own.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    full = materialised(entries.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("_last")).filter("centre < _last").drop("_last"))
    # rows of the buckets that more than one class holds
    members = materialised(entries.join(full, "bucket").select("bucket", "rep", "n", "centre"))
    reps = members.select("rep").distinct()
    sets = materialised(docs.join(reps, F.col("doc_id") == F.col("rep"), "left_semi").mapInArrow(words.returning_memory(_sets), "rep bigint, shingles binary"))

    def similar(common: str, m: str, n: str) -> Column:
        return F.col(common) * 100 >= (F.col(m) + F.col(n) - F.col(common)) * percent

    tests = materialised(compared(members.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), sets))
    links = tests.filter(similar("common", "na", "nb")).select("a", "b")

    for turn in range(MAX_ROUNDS):
        named = members.join(_groups_so_far(links), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        # entries of buckets that still hold several components
        several = named.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).filter("_low < _high")
        left = materialised(named.join(several.select("bucket"), "bucket").select("bucket", "rep", "n", "centre", "component"))
        per_bucket = left.groupBy("bucket").agg(F.count("*").cast("double").alias("k"))
        pairs, rows = per_bucket.agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0.0))).first()
        if pairs <= PAIRS_PER_ENTRY * rows or turn == MAX_ROUNDS - 1:
            break
        # another centre in each bucket: the entry with the smallest hash for this turn, most likely of its largest group
        pick = F.min(F.struct(F.xxhash64("rep", F.lit(turn)), F.col("rep").alias("a"), F.col("component").alias("ca")))
        picked = left.groupBy("bucket").agg(pick.alias("c")).select("bucket", "c.a", "c.ca")
        asked = left.join(picked, "bucket").filter("component <> ca").select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b"))
        found = materialised(compared(asked.distinct(), sets))
        links = links.union(found.filter(similar("common", "na", "nb")).select("a", "b"))

    if rows:
        open_reps = left.select("rep").distinct()
        counted = sets.join(open_reps, "rep", "left_semi").select("rep", "shingles").mapInArrow(words.returning_memory(_count_classes), "rep bigint, classes binary")
        bands = linkable.join(open_reps, F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("rep"), "bands")
        # of two different groups one at least is not the largest of the bucket
        sizes = left.groupBy("bucket", "component").agg(F.count("*").alias("k"))
        largest = F.max(F.struct("k", "component"))
        chunks = (F.floor((F.sum("k") - largest["k"]) / TOGETHER) + 1).cast("int")
        # blocks of a large bucket: chunks of those that ask by parts of all
        parts = (F.floor(F.sum("k") / TOGETHER) + 1).cast("int")
        facts = materialised(sizes.groupBy("bucket").agg(largest["component"].alias("main"), chunks.alias("chunks"), parts.alias("parts")))
        facts_of = left.select("bucket", "rep", "n", "component").join(facts, "bucket")
        known = facts_of.join(counted, "rep").join(bands, "rep").withColumn("small", F.col("component") != F.col("main"))
        chunk, part = (F.pmod(F.xxhash64("rep", F.lit(n)), F.col(n)).cast("int") for n in ("chunks", "parts"))
        block = lambda c, p, turn: F.struct((c * F.col("parts") + p).alias("chunk"), F.lit(turn).alias("turn"))
        asked = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: block(c, part, 1))
        asking = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: block(chunk, p, 0))
        empty = F.array().cast("array<struct<chunk:int,turn:int>>")
        dealt = known.withColumn("p", F.explode(F.concat(asked, F.when(F.col("small"), asking).otherwise(empty)))).select("*", "p.*").select(*_HELD)
        dealt = dealt.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "turn")
        pairs = materialised(dealt.mapInArrow(words.returning_memory(_let_through(percent)), "a bigint, b bigint"))
        found = materialised(compared(pairs, sets))
        links = links.union(found.filter(similar("common", "na", "nb")).select("a", "b"))
    labels = components(links)

    named = materialised(classes.join(labels, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")))
    found = signed.select("doc_id", "n_shingles", "digest").join(
        named.withColumnRenamed("digest", "_digest"),
        (F.col("digest") == F.col("_digest")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(),
        "left",
    )
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "digest")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its group, with all their columns. Rows with a repeated id go by id
    and words: those equal in both share one fate."""
    prepare(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = materialised(docs.mapInArrow(words.returning_memory(_signatures), _SIGNATURES))
    reused = _reused(signed)
    number = df[doc_id].cast("bigint")
    gone = _labelled(docs, signed, reused, percent).filter(~F.col("kept"))
    if reused is None:
        gone = materialised(gone.select(F.col("doc_id").alias("_gone")).distinct())
        return df.join(gone, number == gone["_gone"], "left_anti")
    gone = materialised(gone.select(F.col("doc_id").alias("_gone"), F.col("digest").alias("_digest")).distinct())
    some = reused.withColumnRenamed("doc_id", "_reused")
    once = gone.join(some, F.col("_gone") == F.col("_reused"), "left_anti").select("_gone")
    plain = df.join(once, number == once["_gone"], "left_anti").join(some, number == some["_reused"], "left_anti")
    odd = df.join(some, number == some["_reused"], "left_semi")
    odd = odd.select(F.struct("*").alias("row"), odd[doc_id].cast("bigint").alias("id"), word_digest(odd[text]).alias("digest"))
    return plain.unionAll(odd.join(gone, (F.col("id") == F.col("_gone")) & (F.col("digest") == F.col("_digest")), "left_anti").select("row.*"))
