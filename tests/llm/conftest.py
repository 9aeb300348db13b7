import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, norm string, rep string, _size string, slice string"


def words_of(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=7):
    """Rows with nulls, empty and long texts, copies, near copies around the threshold, shared passages, and columns
    whose names the operators use themselves."""
    rng = random.Random(seed)
    base = words_of(rng, 120)
    passage = words_of(rng, 40, 5000)
    texts = [None, "", "  \n\t ", "one", "one two three four", "one  two\tthree four", "ÀÉ Straße DON'T <|endoftext|> x"]
    texts += [" ".join(words_of(rng, rng.randrange(5, 200))) for _ in range(25)]
    for edits in range(0, 16):
        near = list(base)
        for _ in range(edits):
            near[rng.randrange(len(near))] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    texts += [" ".join(words_of(rng, 30, 5000) + passage + words_of(rng, 30, 5000)) for _ in range(6)]
    texts += [texts[10]] * 12 + [texts[11].upper()] * 2
    texts.append(" ".join(words_of(rng, 20000)))
    texts.append("a" * 30000)
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = []
    for i, t in zip(order, texts):
        source = ["a", "b", "", None, "é"][i % 5] if i % 3 else "a"
        rows.append((i, t, "en", source, None, "x", None, "y", "z"))
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, rows):
    """The same with null and repeated ids, and a row repeated as a whole."""
    extra = [(None, "one", None, None, None, None, None, None, None)] * 2
    extra += [(None, None, None, None, None, None, None, None, None), rows[12], rows[12], (rows[13][0], "other text", *rows[13][2:])]
    return spark.createDataFrame(rows + extra, SCHEMA).repartition(4)
