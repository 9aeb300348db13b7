"""Exact and near deduplication and repeated passages against plain loops."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from apexgrid.llm import content_dedup, minmax_dedup, repeats, words

SPACE = re.compile(rb"[\x20\x09-\x0D]+")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def data(text):
    return (text or "").encode()


def test_word_hashes_are_the_words(monkeypatch):
    rng = random.Random(1)
    texts = ["", None, " a b  a", "x" * 90] + ["".join(rng.choice("ab \n\té") for _ in range(rng.randrange(80))) for _ in range(300)]
    monkeypatch.setattr(words, "BLOCK_BYTES", 64)
    monkeypatch.setattr(words, "_powers", words._Powers())
    of_hash, of_word, n = {}, {}, 0
    for low, hashes, borders in words.word_hashes(pa.array(texts)):
        for i in range(len(borders) - 1):
            expected = WORD.findall(data(texts[low + i]))
            got = hashes[borders[i] : borders[i + 1]].tolist()
            assert len(got) == len(expected)
            for w, h in zip(expected, got):
                assert of_hash.setdefault(h, w) == w and of_word.setdefault(w, h) == h
            n += 1
    assert n == len(texts)


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub(b" ", data(t)), []).append(i)
    return {
        i: (min(g), len(g), i == min(g), hashlib.sha256(k).hexdigest()) for k, g in groups.items() for i in g
    }


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_exact_groups(docs, rows, partitions):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in content_dedup.exact_groups(docs, partitions=partitions).collect()}
    assert got == exact([r[:2] for r in rows])


def test_exact_odd_rows(odd, empty):
    got = content_dedup.exact_groups(odd).collect()
    assert len(got) == odd.count()
    one = [r for r in got if r.text_sha256 == hashlib.sha256(b"one").hexdigest()]
    assert len(one) == 3 and sum(r.kept for r in one) == 1 and {r.group_size for r in one} == {3}
    assert [r.doc_id is None for r in one if r.kept] == [False]
    assert content_dedup.exact_groups(empty).collect() == []


def test_exact_deduplicate(docs, rows):
    kept = content_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in exact([r[:2] for r in rows]).items() if v[2])


def shingles(text):
    w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in data(text)))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


@pytest.mark.parametrize("pairs_per_entry", [512, 0])
def test_near_groups(docs, rows, pairs_per_entry, monkeypatch):
    monkeypatch.setattr(minmax_dedup, "PAIRS_PER_ENTRY", pairs_per_entry)
    monkeypatch.setattr(minmax_dedup, "MAX_ROUNDS", 2)
    monkeypatch.setattr(minmax_dedup, "TOGETHER", 512 if pairs_per_entry else 3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minmax_dedup.near_groups(docs).collect()}
    expected = near([r[:2] for r in rows])
    assert got == expected
    assert len({v[1] for v in expected.values()}) < len(exact([r[:2] for r in rows])) - 10


def test_near_odd_rows(odd, empty):
    got = minmax_dedup.near_groups(odd).collect()
    assert len(got) == odd.count()
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert minmax_dedup.near_groups(empty).collect() == []


def odd_rows(odd):
    """As the fixture, with null-id copies of texts with and without an id, and a copy under an id that has another text."""
    more = [(None, "one two three four"), (None, "  only\there "), (None, " only here "), (0, "some text of its own"), (0, "one")]
    spark = odd.sparkSession
    known = odd.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id bigint, text string"))
    return known.repartition(4), [tuple(r) for r in known.collect()]


def normal(rows):
    return sorted(((i is None, i or 0, SPACE.sub(b" ", data(t))) for i, t in rows))


def test_exact_deduplicate_odd_rows(odd):
    frame, known = odd_rows(odd)
    groups = {}
    for i, t in known:
        groups.setdefault(SPACE.sub(b" ", data(t)), []).append((i is None, i))
    expected = [(null, i or 0, t) for t, g in groups.items() for null, i in [min(g, key=lambda x: (x[0], x[1] or 0))]]
    assert normal(content_dedup.deduplicate(frame).collect()) == sorted(expected)


def test_near_deduplicate_odd_rows(odd):
    rng = random.Random(4)
    base = words_of(rng)
    close = [*base[:-1], "changed"]
    # under id 900 a copy of an earlier document, one near it, and a text of its own; 901 is near the latter
    own = words_of(rng)
    more = [(-5, " ".join(base)), (900, " ".join(base).upper()), (900, " ".join(close)), (900, " ".join(own)), (901, " ".join([*own[1:], "y"]))]
    frame, known = odd_rows(odd)
    frame = frame.unionAll(frame.sparkSession.createDataFrame(more, "doc_id bigint, text string"))
    known += more
    words_in = {k: tuple(WORD.findall(data(t).lower())) for k, (_, t) in enumerate(known)}
    node = {k: (i, words_in[k]) for k, (i, _) in enumerate(known) if i is not None and words_in[k]}
    # plain loop over (id, words) as nodes; the numbers stand in the order of the ids
    order = {n: j for j, n in enumerate(sorted(set(node.values())))}
    labels = near([(order[n], known[k][1]) for k, n in node.items()])
    kept = [row for k, row in enumerate(known) if k not in node or labels[order[node[k]]][2]]
    got = [tuple(r) for r in minmax_dedup.deduplicate(frame).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(key, got)) == sorted(map(key, kept))
    assert [r for r in got if r[0] == 900] == [(900, " ".join(own))] and not [r for r in got if r[0] == 901]


def words_of(rng):
    return [f"n{rng.randrange(10**9)}" for _ in range(80)]


def test_min_max_signature_is_unbiased():
    rng = np.random.default_rng(5)
    agree = []
    for _ in range(60):
        both = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
        a, b = np.unique(both[:320]), np.unique(both[80:])
        agree.append((minmax_dedup.signature(a) == minmax_dedup.signature(b)).mean())
    assert abs(np.mean(agree) - 240 / 400) < 0.02


def test_no_band_holds_both_values_of_a_permutation():
    values = minmax_dedup.signature(np.arange(1, 6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # a single shingle has equal minimum and maximum under every permutation, so equal values name the permutation
    names = minmax_dedup.signature(np.array([12345], np.uint64) << np.uint64(32)).reshape(-1, minmax_dedup.ROWS)
    assert len(values) == names.size and all(len(set(band)) == minmax_dedup.ROWS for band in names.tolist())


def test_bands_of_small_sets_find_as_many_as_stated():
    rng = np.random.default_rng(6)
    n, agree = 400, 0
    for _ in range(n):
        x = rng.integers(0, 1 << 64, 4, dtype=np.uint64)
        a, b = (minmax_dedup.band_keys(minmax_dedup.signature(np.sort(s))) for s in (x, x[:3]))
        agree += (a == b).mean()
    assert abs(agree / n - 0.75**5) < 0.02


def test_bound_lets_sets_without_counts_through(monkeypatch):
    monkeypatch.setattr(minmax_dedup, "CLASSES", 2)
    rng = np.random.default_rng(8)
    both = rng.integers(0, 1 << 64, 2100, dtype=np.uint64)
    sets = [np.unique(both[:2000]), np.unique(both[100:])]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([x.tobytes() for x in sets], pa.binary())], names=["rep", "shingles"])
    classes = pa.concat_arrays([b.column(1) for b in minmax_dedup._count_classes(iter([batch]))])
    assert classes.to_pylist() == [b"", b""]
    # the second set asks (turn 0), the first is asked (turn 1); both lie in bucket 7
    columns = [[7, 7], [0, 0], [0, 1], [2, 1], [2000, 2000], [2, 1], [True, False], classes, [[7], [7]]]
    held = pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in columns], names=minmax_dedup._HELD)
    got = [b.to_pydict() for b in minmax_dedup._let_through(75)(iter([held]))]
    assert got == [{"a": [1], "b": [2]}]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    parent = {n: n for e in edges for n in e if e[0] != e[1]}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    got = {r.rep: r.component for r in minmax_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: top(n) for n in parent}


def without_repeats(rows, window=13):
    lists = [(i, WORD.findall(data(t))) for i, t in rows]
    first = {}
    for i, w in lists:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in lists:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def in_order(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


def test_remove_repeats(docs, odd, empty, rows):
    for frame in (docs, odd):
        known = [(r.doc_id, r.text) for r in frame.collect()]
        got = [tuple(r) for r in repeats.remove_repeats(frame).collect()]
        assert in_order(got) == in_order(without_repeats(known))
    assert sum(r[2] for r in without_repeats([r[:2] for r in rows])) > 500
    assert repeats.remove_repeats(empty).collect() == []


def test_repeats_of_texts_under_one_id(spark):
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    first = fresh(60)
    # one id for a long copy of an earlier document, a short text and a longer one, none of which repeats but the copy
    known = [(1, first), (2, fresh(20) + " " + first), (2, fresh(15)), (2, fresh(90)), (2, None), (3, fresh(30)), (None, first)]
    got = repeats.remove_repeats(spark.createDataFrame(known, "doc_id bigint, text string").repartition(3)).collect()
    expected = without_repeats(known)
    assert in_order(tuple(r) for r in got) == in_order(expected)
    assert sum(r[2] for r in expected) == 60


def test_every_window_has_an_anchor():
    hashes = words.mixed(np.arange(1, 60, dtype=np.uint64))
    seeds = words.run_hashes(hashes, repeats.SEED)
    anchors = repeats.window_anchors(hashes)
    assert anchors.tolist() == [min(seeds[i : i + 9].tolist()) for i in range(len(hashes) - 12)]
