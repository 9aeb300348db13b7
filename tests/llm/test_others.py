"""Formatting, packing, classifier, search, mixing, archives, sharding and the pipeline against plain versions."""

import hashlib
import json
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from apexgrid.llm import chat_windows, content_dedup, minmax_dedup, packing, pivot_search, quality_qda, queries, ring_shards, source_mix, warc_index, words

# formatting

TALKS = (
    [(-5, None, "user", "x"), (-5, None, "user", "x"), (-5, 3, None, None), (-5, 4, "assistant", "a\\</s>\\\\<|im_end|>[INST\\]")]
    + [(1, 0, "system", "only")]
    + [(2, 0, "system", "s" * 3000), (2, 1, "assistant", "b " * 5000), (2, 2, "user", ""), (2, 3, "assistant", "")]
    + [(None, i, "assistant" if i % 2 else "user", "w " * (i % 300)) for i in range(700)]
    + [(3, i, "system" if i == 0 else ["user", "assistant"][i % 2], f"t{i} " * (i % 90)) for i in range(400)]
    + [(4, 0, "assistant", "</s>[INST] ok [/INST]"), (4, 1, "tool\n", "\n"), (4, 2, "system", "late")]
)


@pytest.mark.parametrize("budget, history", [(1024, 128), (60, 20), (8, 100)])
def test_chat_windows_read_back(spark, budget, history):
    talks = spark.createDataFrame(TALKS, "conv_id bigint, turn bigint, role string, text string").withColumn("window", F.lit("x"))
    windows = chat_windows.windows(talks, budget, history, whole=budget < 100)
    got = {r.conv_id: r for r in chat_windows.read_back(windows).collect()}
    by = {}
    for r in TALKS:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or ""))
        expected = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        target = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_text, got[conv].loss_text) == (len(turns), expected, target)
    for w in windows.collect():
        turns = w.formatted.count(chat_windows.END)
        assert w.formatted.count(chat_windows.START) == turns == w.formatted.count(chat_windows.SEPARATOR)
        assert "</s>" not in w.formatted and "[INST]" not in w.formatted
        assert w.n_tokens <= budget or w.over_budget and turns - w.new_from <= 2
        if w.conv_id == 3:
            assert w.formatted.startswith("<|im_start|>system")


def test_chat_windows_are_filled(spark):
    """Windows against a loop: greedy by prefix sums inside parts, with history across their borders."""
    rng = random.Random(11)
    talks = [(0, 250 + i, "system" if i == 0 else ["assistant", "user"][i % 2], "w " * rng.randrange(1, 120)) for i in range(300)]
    budget, history = 400, 60
    got = chat_windows.windows(spark.createDataFrame(talks, "conv_id bigint, turn bigint, role string, text string"), budget, history).collect()
    size = lambda r: r[3].count("w") + 1 + chat_windows.MARKERS
    system, turns = size(talks[0]), talks[1:]
    expected = []
    k = 0
    while k < len(turns):
        low = k
        # into the part before only as far as the copies go
        while low and sum(map(size, turns[low - 1 : k])) <= history and turns[low - 1][1] // 256 >= turns[k][1] // 256 - 1:
            low -= 1
        back = sum(map(size, turns[low:k]))
        back = back if back + size(turns[k]) + system <= budget else 0
        total, first = system + back, k
        while k < len(turns) and turns[k][1] // 256 == turns[first][1] // 256 and (k == first or total + size(turns[k]) <= budget):
            total += size(turns[k])
            k += 1
        expected.append((total, (0 if first == 0 else 1) + (first - low if back else 0)))
    assert [(w.n_tokens, w.new_from) for w in sorted(got, key=lambda w: tuple(w.window))] == expected
    assert sum(w.n_tokens for w in got) > 0.8 * budget * len(got)


def test_chat_without_rows(spark):
    talks = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat_windows.read_back(chat_windows.windows(talks)).collect() == []


# packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_word_tokenizer_equals_tokenizer(tokenizer):
    rng = random.Random(4)
    letters = list("aAbéÉßñ'sİΣσµªº.,!?<|>endoftext \n\t\x0b ̸́=12٣中😀_*#-") + ["<|endoftext|>", "'s", "word", "DON'T"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)]
    got = packing.WordTokenizer(queries.tokenizer_path()).column(pa.array(texts))
    for text, ids in zip(texts, got):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pack(odd, empty, tokenizer):
    pieces = packing.pack(odd, queries.tokenizer_path()).collect()
    docs = {}
    for r in pieces:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    expected = sorted(
        ((r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in odd.collect()),
        key=lambda x: (x[0] is None, x[0] or 0, x[1]),
    )
    assert sum(r.length for r in pieces) == sum(len(ids) for _, ids in expected)
    for doc, ids in expected:
        parts = sorted((r for r in docs[doc, len(ids)] if r.ids == np.array(ids[r.start : r.start + r.length], "<u4").tobytes()), key=lambda r: r.start)
        assert {p for r in parts for p in range(r.start, r.start + r.length)} == set(range(len(ids)))
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
    partial = [s for s in sequences.values() if sum(n for _, n in s) < packing.CAPACITY]
    assert len(partial) <= odd.rdd.getNumPartitions()
    assert packing.pack(empty, queries.tokenizer_path()).collect() == []


def test_level_minimises_sum_of_squares():
    rng = random.Random(9)
    packer = packing.SumOfSquares(20)
    for _ in range(400):
        size = rng.randrange(1, 21)

        def total(level):
            counts = packer.counts.copy()
            if level:
                counts[level] -= 1
            counts[level + size] += 1
            return int((counts[1:20] ** 2).sum())

        options = [0, *(h for h in range(1, 21 - size) if packer.counts[h])]
        assert total(packer.level_for(size)) == min(map(total, options))
        packer.place(0, 0, np.zeros(size, np.uint32), size)
    assert packer.n_open == packer.counts.sum()


# quality


def test_quality_held_out(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 > 0
        w = [f"wo{rng.randrange(300)}rd" for _ in range(rng.randrange(20, 150))]
        text = " ".join(w) + "." if good else " ".join(x for x in w for _ in range(9))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    rows += [(None, None), (1000, ""), (1000, None)]
    labels += [(1000, None, None), (None, 1, 0), (7, 5, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("x", F.lit(1))
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = quality_qda.scored(docs, known).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    out = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(out) > 80 and np.mean([r.predicted == (r.doc_id % 4 > 0) for r in out]) > 0.97
    # the labels of held-out rows play no part
    turned = known.withColumn("quality", F.when(quality_qda.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_qda.scored(docs, turned).collect() if r.doc_id}
    assert all(math.isclose(again[r.doc_id], r.score, rel_tol=1e-6, abs_tol=1e-12) for r in got if r.doc_id and r.doc_id < 600)
    kept = quality_qda.keep_good(docs, known)
    assert kept.columns == docs.columns
    # by row: a good text saves no other row of its id, null or not
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 2).when(F.col("doc_id") % 3 == 1, F.col("doc_id")))
    for frame in (docs, odd):
        found = quality_qda.keep_good(frame, known).collect()
        share = np.mean([len(set((r.text or "").split())) < 0.4 * len((r.text or "x").split()) for r in found])
        assert share < 0.02 and len(found) > 400
    few = quality_qda.keep_good(docs, known, learnt_from=150).collect()
    assert abs(len(few) - kept.count()) < 20


@pytest.mark.parametrize("labels, score", [([], 0.5), ([(1, 1, 0)], 1.0), ([(1, 0, 0)], 0.0)])
def test_quality_without_a_class(spark, docs, empty, labels, score):
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality_qda.scored(docs, known).collect()} == {score}
    assert quality_qda.scored(empty, known).collect() == []


def test_statistics_of_long_texts_by_pieces(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("aBé1.!-\n") for _ in range(rng.randrange(1, 9))) for _ in range(4000)), "", "x" * 9000]
    whole = np.concatenate(list(quality_qda.statistics(pa.array(texts))))
    monkeypatch.setattr(words, "BLOCK_BYTES", 700)
    assert np.allclose(np.concatenate(list(quality_qda.statistics(pa.array(texts)))), whole)


def test_word_cache_is_bounded_and_released(monkeypatch):
    tokenizer = packing.word_tokenizer(queries.tokenizer_path())
    texts = pa.array([f"word{i} other{i} x" for i in range(2000)])
    whole = [x.tolist() for x in tokenizer.column(texts)]
    monkeypatch.setattr(packing, "CACHE_BYTES", 100)
    monkeypatch.setattr(packing, "TEXT_BLOCK", 1000)
    assert [x.tolist() for x in tokenizer.column(texts)] == whole
    assert tokenizer.held < 20000
    tokenizer.forget()
    assert len(tokenizer.codes) == 1 and tokenizer.held == 0


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(1)
    x = [rng.normal(0, 1, (500, 3)) @ rng.normal(0, 1, (3, 3)) + c for c in (0, 2)]
    n = np.array([len(v) for v in x])
    model = quality_qda.discriminant(n, np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]))
    z = (x[1][:5] - model.shift) / model.scale
    density = []
    for c in (0, 1):
        precision = model.factors[c].T @ model.factors[c]
        d = z - model.centres[c]
        density.append(0.5 * np.linalg.slogdet(precision)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, precision, d) + np.log(n[c] / n.sum()))
    expected = 1 / (1 + np.exp(-(density[1] - density[0]) / quality_qda.TEMPERATURE))
    assert np.allclose(model.score(x[1][:5]), expected)


# search


@pytest.mark.parametrize("block", [8, 1024])
def test_top_k(spark, block, monkeypatch):
    monkeypatch.setattr(pivot_search, "BLOCK", block)
    monkeypatch.setattr(pivot_search, "QUERIES_PER_COPY", 3)
    rng = np.random.default_rng(8)
    vectors = [rng.normal(c % 3, 0.4, 6).tolist() for c in range(150)] + [[0.5] * 6] * 60 + [[0.25, 0.5]] * 3
    rows = [(i, v, None, 1) for i, v in enumerate(vectors)]
    rows += [(500, None, None, 1), (501, [1.0, None], None, 1), (502, [float("nan")], None, 1), (503, [float("inf")], None, 1), (None, [9.0] * 6, None, 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, pivot int, score int").repartition(3)
    whole = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in enumerate(vectors)}
    expected = set()
    for q in whole:
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)
            expected |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:10])}
    got = [tuple(r) for r in pivot_search.top_k(frame, 10).collect()]
    assert len(got) == len(expected) and set(got) == expected
    few = frame.filter("vec_id < 3")
    assert len(pivot_search.top_k(few, 1).collect()) == 6
    assert pivot_search.top_k(frame.limit(0), 10).collect() == []


# mixing


def water_level(sizes, weights, share=1.5, most=2):
    goal, rest, active = {}, share * sum(sizes.values()), set(sizes)
    while active:
        level = rest / sum(weights[s] for s in active)
        over = {s for s in active if level * weights[s] > most * sizes[s]}
        if not over:
            return goal | {s: level * weights[s] for s in active}
        for s in over:
            goal[s] = most * sizes[s]
            rest -= goal[s]
        active -= over
    return goal


def test_mixed(odd, empty):
    got = source_mix.mixed(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal = water_level({s: sum(r.size for r in by[s]) for s in names}, weights)
    for s in names:
        assert {r.source_size for r in by[s]} == {sum(r.size for r in by[s])}
        assert all(math.isclose(r.target, goal[s], rel_tol=1e-9, abs_tol=1e-9) for r in by[s])
        assert all(r.taken in (0, r.size, 2 * r.size) for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - goal[s]) <= max(r.size for r in by[s]) / 2 + 1e-6
    again = source_mix.mixed(odd.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert source_mix.mixed(empty).collect() == []


def test_mixture_takes_whole_rows(docs):
    taken = source_mix.mixture(docs)
    assert taken.columns == docs.columns
    expected = {r.doc_id: r.copies for r in source_mix.mixed(docs).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    assert got == expected
    assert {r._size for r in taken.collect()} == {"y"}


def test_stages_keep_columns_of_any_name(spark, rows):
    """Columns named like the operators' own are given back as they came."""
    names = ("_id", "_sha", "_gone", "_row", "_copies", "_hash", "x")
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").withColumn("source", F.lit("s"))
    frame = frame.withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id bigint, quality int, toxic int")
    for out in (
        content_dedup.deduplicate(frame),
        minmax_dedup.deduplicate(frame),
        source_mix.mixture(frame),
        quality_qda.keep_good(frame, labels),
    ):
        assert out.columns == frame.columns
        found = out.collect()
        assert found and all(r[n] == f"{n}{r.doc_id}" for r in found for n in names)


# archives


def test_archives(spark, tmp_path):
    long = "é" * 600
    rows = [(1, "http://a/ b", long), (2, "u\r\nX: y", long), (9, None, long), (None, "u", long), (3, "", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short")]
    rows += [(7, "u", "q" * 70000), (8, "v", "q" * 70000 + "r"), (9, None, long)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, size string").repartition(3)
    index = warc_index.write_archives(pages, folder=f"file://{tmp_path}/archives")
    got = warc_index.read_records(index).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next((h or "").encode() for p, _, h in rows if p == r.page_id)
        again = html == long.encode() and r.page_id != 9
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if again else ("response", None))
        assert r.payload == (None if again else html)
    picked = warc_index.read_records(index.filter("page_id IN (5, 7)")).collect()
    assert sorted(r.page_id for r in picked) == [5, 7]
    assert warc_index.read_records(warc_index.write_archives(pages.limit(0))).collect() == []


def test_archives_are_read_by_bytes(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = [(i, f"u{i}", rng.randbytes(1500).hex()) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    index = warc_index.write_archives(pages, folder=f"file://{tmp_path}/archives")
    monkeypatch.setattr(warc_index, "TASK_BYTES", 100_000)
    size = index.agg(F.sum("length")).first()[0]
    read = warc_index.read_records(index)
    assert read.rdd.getNumPartitions() == -(-size // 100_000) > 5
    assert {(r.page_id, r.payload.decode()) for r in read.collect()} == {(i, h) for i, _, h in rows}


def test_ranges_are_coalesced():
    gap, read = warc_index.GAP, warc_index.READ
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 15 + gap, 5), ("a", 30 + 2 * gap, 5), ("b", 0, read + 1), ("b", read + 1, 1)]
    assert [(n, low, high, len(p)) for n, low, high, p in warc_index._ranges(iter(rows))] == [
        ("a", 0, 20 + gap, 3), ("a", 30 + 2 * gap, 35 + 2 * gap, 1), ("b", 0, read + 1, 1), ("b", read + 1, read + 2, 1)
    ]


# sharding


def ring_by_hand(keys, shards, virtual_nodes):
    """Keys in the order in which slices ask, each to the first shard with room clockwise from its slice."""
    nodes = sorted((p, s) for s, ps in enumerate(ring_shards.ring(shards, virtual_nodes)) for p in ps)
    out = {}
    for at in {k[0] for k in keys}:
        ways = sorted((min((p - at) % ring_shards.SLICES for p, s in nodes if s == shard), shard) for shard in range(shards))
        out[at] = [s for _, s in ways]
    return out


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shard_counts_and_slots(docs, odd, rows, shards):
    for frame in (docs, odd):
        got = ring_shards.shard(frame, shards).collect()
        n = frame.count()
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert len(got) == n and len(slots) == min(shards, n)
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    data = {r[0]: (r[1] or "").encode() for r in rows}
    for r in ring_shards.shard(docs, shards).collect():
        assert (r.size, r.text_crc32) == (len(data[r.doc_id]) + 1, zlib.crc32(data[r.doc_id]))


def test_shard_prefers_the_ring_and_moves_little(spark, empty):
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "size", "text_crc32"), 64 - ring_shards.SLICE_BITS)
    placed = {s: ring_shards.shard(frame, s, slack=0.25).withColumn("slice", key).collect() for s in (8, 9)}
    ways = ring_by_hand([(r.slice,) for r in placed[8]], 8, ring_shards.VIRTUAL_NODES)
    assert max(sum(r.shard == s for r in placed[8]) for s in range(8)) <= 625
    assert np.mean([r.shard == ways[r.slice][0] for r in placed[8]]) > 0.85
    after = {r.doc_id: r.shard for r in placed[9]}
    assert np.mean([after[r.doc_id] != r.shard for r in placed[8]]) < 0.3
    assert ring_shards.shard(empty).collect() == []


# pipeline and registry


def test_pipeline(spark, rows, tmp_path):
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 0 if r[1] and len(r[1]) > 20000 else 1, 0) for r in rows]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    step, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, step, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, step = step, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert step.columns == docs.columns
            assert {r.doc_id for r in step.collect()} <= {r.doc_id for r in before.collect()}
        if name in ("exact_duplicates", "near_duplicates"):
            assert step.count() < before.count()
    assert {r.doc_id for r in step.collect()} == {r.doc_id for r in before.collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg(F.sum("length")).first()[0] == step.agg(F.sum("length")).first()[0]


def test_registry():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(queries.queries()) | {"pipeline"} <= names
    assert set(entry.oracle_sql()) <= names
    assert [json.dumps(n) for n in queries.queries()] and len(queries.queries()) == 13
