"""Spelling variants, near vectors and periodic runs against plain loops."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from apexgrid.llm import cap_filters, periodic_runs, queries, spelling_variants

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    short, long = sorted((x, y), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def forms(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


@pytest.mark.parametrize("block", [1 << 15, 7])
def test_variants(spark, monkeypatch, block):
    monkeypatch.setattr(spelling_variants, "BLOCK", block)
    rng = random.Random(4)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randrange(7))): rng.randrange(1, 200) for _ in range(150)}
    counts |= {"a" * 3000: 5, "a" * 2999: 20, "a" * 1500 + "b" + "a" * 1499: 2}
    # a word in two rows, a null word, a column with a name of the operator's
    rows = [(w, n, 1) for w, n in counts.items()] + [("a" * 3000, 4, 1), (None, 7, 1)]
    counts["a" * 3000] += 4
    got = spelling_variants.variants(spark.createDataFrame(rows, "word string, n bigint, short int").repartition(3)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == forms(counts)
    assert len(got) == len(counts)


def test_variants_empty(spark):
    assert spelling_variants.variants(spark.createDataFrame([], "word string, n bigint")).collect() == []


def test_acceptor_is_minimal():
    a = spelling_variants.Acceptor(sorted(x + y for x in ("ab", "cd", "ef") for y in ("", "s", "ing")))
    # start, one state after each first letter (all alike), the shared endings
    assert a.accepted[0] == 9
    reached, todo = set(), [0]
    while todo:
        state = todo.pop()
        if state not in reached:
            reached.add(state)
            todo += [t for t, _ in a.next[state].values()]
    assert len(reached) == 1 + 3 + 1 + 3


def test_vocabulary(spark, docs, rows, odd, empty):
    expected = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 2:
                expected[run] += 1
    got = {r.word: r.n for r in queries.vocabulary(docs, at_least=2, letters=2).collect()}
    assert got == {w: n for w, n in expected.items() if n >= 2}
    assert queries.vocabulary(odd).count() >= 0 and queries.vocabulary(empty).collect() == []


def linked(vectors, threshold=0.95):
    usable = {}
    for k, (i, v) in enumerate(vectors):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[k] = np.array(v + [0.0] * (64 - len(v)))
    units = {k: v / np.linalg.norm(v) for k, v in usable.items()}
    near = {k: [o for o in units if o != k and float(units[k] @ units[o]) >= threshold] for k in units}
    out = []
    for k, (i, _) in enumerate(vectors):
        reached, todo = {k}, [k]
        while todo:
            for o in near.get(todo.pop(), []):
                if o not in reached:
                    reached.add(o)
                    todo.append(o)
        component = min((vectors[o][0] for o in reached), default=i) if k in units else i
        out.append((i, len(near.get(k, [])), component, True if i is None else component == i))
    return sorted(out, key=str)


def some_vectors(seed=3, dims=64):
    rng = np.random.default_rng(seed)
    vectors = [rng.standard_normal(dims) for _ in range(60)]
    for k in range(8):
        # chains: neighbours are near, ends are not
        at = vectors[k]
        for _ in range(5):
            step = rng.standard_normal(dims)
            at = at + 0.25 * step * np.linalg.norm(at) / np.linalg.norm(step)
            vectors.append(at)
    vectors += [vectors[3] + 0.02 * rng.standard_normal(dims) for _ in range(40)] + [3 * vectors[5], -vectors[5]] + [vectors[9]] * 20
    rows = [[float(x) for x in v] for v in vectors]
    rows += [None, [], [0.0] * dims, [None] + [1.0] * (dims - 1), [float("nan")] + [1.0] * (dims - 1), [float("inf")] * dims, [1.0, 2.0]]
    order = rng.permutation(len(rows)).tolist()
    out = [(i * 3, v) for i, v in zip(order, rows)]
    # null and repeated ids
    return out + [(None, rows[3]), (None, None), (out[3][0], rows[7]), out[4], out[4]]


@pytest.mark.parametrize("together", [1024, 5])
def test_near_vectors(spark, monkeypatch, together):
    monkeypatch.setattr(cap_filters, "TOGETHER", together)
    vectors = some_vectors()
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id bigint, embedding array<double>, caps int, node string")
    got = cap_filters.near_vectors(df.repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == linked(vectors)
    assert cap_filters.near_vectors(df.limit(0)).collect() == []


def test_recall_of_caps():
    """Pairs exactly at the threshold share a cap."""
    rng = np.random.default_rng(8)
    for vectors, dims in ((2000, 64), (200000, 64), (50000, 48)):
        caps = cap_filters.Caps(dims, vectors).opened()
        x, z = rng.standard_normal((2, 1500, dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        y = 0.95 * x + np.sqrt(1 - 0.95**2) * z
        lists = [[c for k in range(0, 1500, 100) for c in caps.decode(v[k : k + 100])] for v in (x, y)]
        found = sum(bool(set(a.tolist()) & set(b.tolist())) for a, b in zip(*lists))
        assert found >= 1500 * 0.995
        # each list holds what reaches the vector's alpha, by all directions
        turn, first, second = caps._open[0]
        v = (x[:1] @ turn)[0]
        sums = (first @ v[: dims // 2])[:, None] + (second @ v[dims // 2 :])[None, :]
        best = np.sort(np.argpartition(-sums.ravel(), cap_filters.CAPS - 1)[: cap_filters.CAPS])
        assert lists[0][0][: cap_filters.CAPS].tolist() == best.tolist()


def plain_runs(w, least=24, times=3):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((i, n, q) for (i, n), q in found.items())


def test_runs_of():
    rng = random.Random(6)
    for _ in range(1500):
        n, letters = rng.randrange(1, 150), rng.choice([1, 2, 3, 6])
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 3))
            for i in range(a + p, min(n, a + p * rng.randrange(2, 9) + rng.randrange(p))):
                w[i] = w[i - p]
        for least, times in ((24, 3), (6, 3), (5, 4)):
            assert periodic_runs.runs_of(w, least, times) == plain_runs(w, least, times)


def periodic(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def expected_runs(doc_id, text):
    w = periodic(doc_id, WORD.findall((text or "").encode()))
    runs = plain_runs(w)
    dropped = {k for i, n, q in runs for k in range(i + q, i + n)}
    best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{i},{n},{q}\n" for i, n, q in runs)
    rest = b" ".join(x for k, x in enumerate(w) if k not in dropped)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, runs and 1000 * best[1] // best[2] or None, sha(lines.encode()), sha(rest))


def test_query_of_runs(spark, rows, tmp_path):
    rng = random.Random(9)
    short = [r for r in rows if len(r[1] or "") < 20000]
    extra = [(1000 + k, " ".join(["x y z"] * k + ["w"] * (3 * k) + [str(rng.random())])) for k in range(30)]
    extra += [(None, "a b " * 20), (None, None), (rows[9][0], "c " * 30)] + [(2000, "d e f " * 9)] * 2 + [(3000, "word " * 3000)]
    texts = [(r[0], r[1]) for r in short] + extra
    spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected_runs(*t) for t in texts), key=str)


def test_runs_keep_text(docs, rows, empty):
    got = {r.doc_id: r for r in periodic_runs.find_runs(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept_text.split() == (t or "").split() or got[i].runs for i, t, *_ in rows if (t or "").isascii())
    assert periodic_runs.find_runs(empty).collect() == []
