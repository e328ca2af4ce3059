import random

import pytest

CLASHING = ("_d", "_h", "key", "score", "runs", "removed_lines", "spans", "ids", "root", "_text", "size", "at", "lang", "n_chars")


@pytest.fixture
def prose():
    """prose(seed, n): n invented words."""
    def make(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice(("er", "th", "on", "an", "re", "ti", "es")) for _ in range(r.randint(1, 4))) for _ in range(n))
    return make


@pytest.fixture
def docs(spark):
    """docs(rows): a table of (doc_id, text) with columns whose names clash with those of the operators."""
    def make(rows):
        schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame([(d, t, *(f"{c}-{d}" for c in CLASHING)) for d, t in rows], schema)
    return make


@pytest.fixture
def awkward(prose):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = "\n".join(prose(i, 60) for i in range(400))
    return [(1, "a b c"), (1, "a b c"), (1, "other text of one id"), (None, "no id"), (None, None), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long), (7, "ÄÖ 日本 ▁ x\0y")]
