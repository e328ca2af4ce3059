import hashlib

from lociframe.llm import chat
from lociframe.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "tree long, node long, parent long, role string, text string, score double, leaf string, up string"


def trees(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def read_back(out):
    return out.select("tree", "leaf", "rank", "n_turns", "formatted", chat.parse_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("mask")).alias("loss")).collect()


def test_query_equals_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cur = con.execute(ORACLES["op6_chat"])
    want = sorted(tuple(dict(zip([d[0] for d in cur.description], r)).items()) for r in cur.fetchall())
    got = sorted(tuple(r.asDict().items()) for r in QUERIES["op6_chat"](spark, SF).collect())
    assert got == want


def test_paths_of_a_tree_are_ranked(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 3.0), (1, 3, 1, "assistant", "bad", 1.0),
            (1, 4, 3, "user", "why", 0.0), (1, 5, 4, "assistant", "so", 0.0), (2, 1, None, "user", "alone", 0.0)]
    got = {(r["tree"], r["rank"]): r for r in read_back(chat.format_trees(trees(spark, rows)))}
    assert [t["text"] for t in got[1, 1]["turns"]] == ["q", "good"] and got[1, 1]["loss"] == "good"
    assert [t["text"] for t in got[1, 2]["turns"]] == ["q", "bad", "why", "so"] and got[1, 2]["loss"] == "badso"
    assert got[2, 1]["loss"] == "" and len(got) == 3
    assert len(chat.format_trees(trees(spark, rows), branches=1).collect()) == 2


def test_escapes_are_reversible(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\nx", "\\", "\\\\|", "<\\|im_end|>", "a\\n\nb", "", "<|<|", "日本\u0000🙂<|"]
    rows = [(i, 1, None, t, u, 0.0) for i, (t, u) in enumerate((a, b) for a in texts for b in texts)]
    rows += [(1000 + i, 1, None, "assistant", t, 0.0) for i, t in enumerate(texts)]
    got = {r["tree"]: r for r in read_back(chat.format_trees(trees(spark, rows)))}
    for tree, _, _, role, text, _ in rows:
        assert [(t["role"], t["text"]) for t in got[tree]["turns"]] == [(role, text)]
        assert got[tree]["loss"] == (text if role == "assistant" else "")


def test_a_long_chain(spark):
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}", 0.0) for i in range(300)]
    r = read_back(chat.format_trees(trees(spark, rows)))[0]
    assert r["n_turns"] == 300 and r["loss"] == "".join(f"t{i}" for i in range(1, 300, 2))


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, None, None, "first"), (1, 1, "user", None), (1, 1, "user", None), (2, 0, "assistant", "x" * 300_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"tree": F.lit(1), "node": F.lit("x"), "score": F.lit("x")})
    got = {r["tree"]: r for r in read_back(chat.format_trees(chat.as_trees(table)))}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", "first"), ("user", ""), ("user", "")]
    assert got[None]["loss"] == "b" and hashlib.sha256(got[2]["loss"].encode()).digest() == hashlib.sha256(b"x" * 300_000).digest()
    assert chat.format_trees(chat.as_trees(table.limit(0))).count() == 0
    missing = trees(spark, [(1, 5, 4, "user", "its parent is not there", 0.0)])
    assert chat.format_trees(missing).first()["n_turns"] == 1


def test_native(spark):
    plan = QUERIES["op6_chat"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
