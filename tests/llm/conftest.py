import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, shard string, key string, node string, size string, text_hash string, intervals string, quality_score string, hits string, spans string"


def rows_of(texts):
    """Documents with columns whose names clash with the operators' own."""
    return [(i, t, "en" if i is not None and i % 2 else None, None if i is not None and i % 5 == 0 else f"s{(i or 0) % 3}", None if t is None else len(t), *["x"] * 10) for i, t in texts]


def words(rng, n, sep=" "):
    return sep.join("".join(rng.choice(("an", "er", "th", "ö", "lo", "ri")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def tricky_texts():
    """(doc_id, text): nulls, empty and blank texts, copies, near copies, shared passages, a long text, repeated rows."""
    rng = random.Random(3)
    base = words(rng, 120)
    passage = words(rng, 70)
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One TWO three four"), (5, base), (6, base), (7, base.replace(" ", "\n", 3)), (8, base + " extra words at the end"), (None, base), (None, None)]
    out += [(10 + i, words(rng, 40) + "\n" + passage + "\n" + words(rng, 40)) for i in range(6)]
    out += [(20, "ab" * 400), (21, "ab" * 250), (22, "é" * 300), (23, "\x00\x1f ¤ ￿ word"), (24, words(rng, 8000)), (25, "same line\n" * 60), (25, "same line\n" * 60), (26, "one two one two one two one two")]
    out += [(30 + i, words(rng, rng.randint(1, 90))) for i in range(10)]
    return out


@pytest.fixture(scope="session")
def tricky(spark):
    return spark.createDataFrame(rows_of(tricky_texts()), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
