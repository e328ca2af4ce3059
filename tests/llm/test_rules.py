import random
import re
from collections import Counter, defaultdict

import pytest
from lociframe.llm import rules
from lociframe.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    seen = defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i:i + 5])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def judged(rows, min_docs, share, least):
    """rows of (doc_id, text, host)."""
    def norm(x):
        return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09\x0B-\x0D]+", " ", x.lower())).strip(" ")
    hosts, docs = defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for _, t, s in rows:
        docs[s].add(t or "")
        for x in (t or "").split("\n"):
            hosts[s][norm(x)].add(t or "")
    out = []
    for d, t, s in rows:
        lines = (t or "").split("\n")
        gone = [i for i, x in enumerate(lines) if norm(x) and len(hosts[s][norm(x)]) > min_docs and len(hosts[s][norm(x)]) > share * len(docs[s])]
        lost = sum(len(WORD.findall(lines[i])) for i in gone)
        b = base(t)
        left = b[0] - lost
        out.append((d, *b, gone, "\n".join(x for i, x in enumerate(lines) if i not in set(gone)), not b[5] and left >= 10 and left >= least * b[0]))
    return out


def answers(df):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed", "kept_text", "kept")
    return [tuple(r[n] for n in names) for r in df.collect()]


def table(spark, rows):
    clash = ("_d", "_h", "_s", "line", "words", "removed", "kept", "base", "n_words")
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in clash)
    return spark.createDataFrame([(*r, *clash) for r in rows], schema)


def by_text(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def test_query_equals_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(ORACLES["op13_quality_rules"])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(sorted(zip(names, r))) for r in cur.fetchall())
    assert sorted(tuple(sorted(r.asDict().items())) for r in QUERIES["op13_quality_rules"](spark, SF).collect()) == want


@pytest.mark.parametrize("seed", range(3))
def test_base_rules_equal_brute_force(spark, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(["a", "b", "é", "日", " ", "\t", "\n", "\x0b", "#", "|", " ", "a b c d e "]) for _ in range(r.randint(0, 120))) for _ in range(150)]
    texts += ["a " * 30, "x\n" * 40, "a b c d e f a b c d e f", "a b c d e", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", rules.base_rules(F.col("text")).alias("b"))
    got = {x["i"]: tuple(x["b"]) for x in df.collect()}
    for i, t in enumerate(texts):
        assert got[i] == base(t), repr(t)


def test_frequent_lines_equal_brute_force(spark, prose):
    r = random.Random(1)
    common = [prose(900 + k, 6) for k in range(4)]
    rows = []
    for d in range(60):
        lines = [prose(d * 50 + k, r.randint(4, 9)) for k in range(r.randint(1, 6))]
        for c in common:
            if r.random() < 0.5:
                lines.insert(r.randrange(len(lines) + 1), r.choice([c, c.upper(), f"  {c} "]))
        rows.append((d, "\n".join(lines), r.choice(["one", "two", None])))
    rows += rows[:5]
    got = answers(rules.judge(table(spark, rows), min_docs=4, share=0.1))
    want = judged(rows, 4, 0.1, rules.LEAST)
    assert by_text(got) == by_text(want) and any(w[7] for w in want) and len({w[9] for w in want}) == 2


def test_copies_of_one_text_are_one_document(spark, prose):
    text = "\n".join(prose(k, 20) for k in range(4))
    rows = [(d, text, "one") for d in range(30)] + [(100 + d, prose(100 + d, 40) + "\nsame line here", "one") for d in range(30)]
    got = {r[0]: r for r in answers(rules.judge(table(spark, rows)))}
    assert all(got[d][9] and got[d][7] == [] for d in range(30))
    assert all(got[100 + d][7] == [1] for d in range(30))


def test_a_depleted_document_goes(spark, prose):
    line = prose(5, 30)
    rows = [(d, f"{line}\n{prose(50 + d, 12)}", "one") for d in range(15)] + [(99, prose(99, 60), "one")]
    got = {r[0]: r[9] for r in answers(rules.judge(table(spark, rows)))}
    assert got.pop(99) and not any(got.values())


def test_awkward_rows(spark, awkward):
    rows = [(d, t, s) for (d, t), s in zip(awkward, ["a", "a", None, "", None, "a", "b", None, "x", "x", "y"])]
    got = answers(rules.judge(table(spark, rows)))
    assert by_text(got) == by_text(judged(rows, rules.MIN_DOCS, rules.SHARE, rules.LEAST))
    assert rules.judge(table(spark, rows).limit(0)).count() == 0


def test_a_very_long_text(spark, prose):
    text = "\n".join(prose(k % 500, 12) for k in range(40_000))
    got = answers(rules.judge(table(spark, [(1, text, "a")])))[0]
    assert got[:7] == (1, *base(text)) and len(text) > 2_000_000


def test_native(spark):
    plan = QUERIES["op13_quality_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
