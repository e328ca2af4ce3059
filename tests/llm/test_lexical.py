import math
import random
import re
from collections import Counter

import pytest
from lociframe.llm import lexical
from lociframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, top):
    held = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for d, c in held:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def answers(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def texts(seed, n, words):
    r = random.Random(seed)
    vocabulary = ["a", "B", "the", "éa", "É", "日本", "x1", "1", "of", "ab", "abc", "thé", " b"]
    return [r.choice([" ", ", ", "-", "\x7f", "\n"]).join(r.choice(vocabulary) for _ in range(r.randint(0, words))) for _ in range(n)]


def test_query_equals_sql(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ORACLES['op12_lexical_search']})").fetchall(), key=str)
    assert answers(QUERIES["op12_lexical_search"](spark, SF)) == want


@pytest.mark.parametrize("top", [1, 3, 50])
def test_equals_brute_force_in_blocks(spark, docs, monkeypatch, top):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 5)
    monkeypatch.setattr(lexical, "POOL", 40)
    rows, items = list(enumerate(texts(1, 90, 25))), list(enumerate(texts(2, 25, 9)))
    table = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(lexical._blocks(table))) > 3
    assert answers(lexical.search(docs(rows).repartition(5), table, top)) == brute(rows, items, top)


def test_terms_are_guarded(spark, docs):
    rows = [(1, "cat"), (2, "concat cats"), (3, "CAT cat-cat"), (4, "cät")]
    got = answers(lexical.search(docs(rows), spark.createDataFrame([(7, "Cat")], "item_id long, text string")))
    assert [(r[1], r[2]) for r in got] == [(1, 3), (2, 1)]


def test_awkward_rows(spark, docs, awkward):
    items = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "text of no id"), (4, "日本 x"), (5, "er th on " * 50)]
    table = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, rank string")
    got = answers(lexical.search(docs(awkward), table))
    assert got == brute(awkward, items, 20) and {r[0] for r in got} == {1, None, 4, 5}
    for a, b in ((docs(awkward).limit(0), table), (docs(awkward), table.limit(0))):
        assert lexical.search(a, b).columns == ["item_id", "rank", "doc_id", "score"] and lexical.search(a, b).count() == 0


def test_ties_go_to_the_smaller_id(spark, docs):
    rows = [(d, "same words here") for d in range(100, 0, -1)] + [(None, "same words here")] + [(200 + d, "other") for d in range(300)]
    got = answers(lexical.search(docs(rows).repartition(7), spark.createDataFrame([(1, "words")], "item_id long, text string")))
    assert sorted((r[1], r[2]) for r in got) == [(1, None), *[(k + 2, k + 1) for k in range(19)]]


def test_a_very_long_text(spark, docs, prose):
    rows = [(1, prose(1, 300_000) + " needle"), (2, "needle needle"), (3, prose(3, 50))]
    items = [(1, "needle"), (2, prose(1, 30))]
    assert answers(lexical.search(docs(rows), spark.createDataFrame(items, "item_id long, text string"))) == brute(rows, items, 20)
