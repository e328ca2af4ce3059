import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from lociframe.llm import prefix_trie
from lociframe.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    """conv_id -> turns, of rows (conv_id, turn, role, text) without ties."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()), key=str)


def answers(df):
    return sorted(map(tuple, df.select(*NAMES).collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", "c") for r in rows], "conv_id long, turn long, role string, text string, id string, depth string, size string")


def run(spark, rows, base=prefix_trie.BASE):
    turns = prefix_trie.numbered(prefix_trie.turn_table(table(spark, rows)))
    return answers(prefix_trie.trie(turns.select("conv_id"), prefix_trie.with_shared_heads(turns), base))


def random_rows(seed, n, longest=8):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "é", "long text", ""])) for c in range(n) for t in range(r.randint(1, longest))]


def test_query_equals_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(f"SELECT {', '.join(NAMES)} FROM ({ORACLES['op11_prefix_trie']})").fetchall()
    assert answers(QUERIES["op11_prefix_trie"](spark, SF)) == sorted(want, key=str)


def test_equals_brute_force(spark):
    rows = random_rows(1, 150) + [(-7, 0, "user", "a"), (-5, 1, "user", "b"), (10**12, 3, "user", "c")]
    assert run(spark, rows) == brute(rebuilt(rows))


def test_equals_brute_force_over_split_parts(spark, monkeypatch):
    """One conversation, one root and the tour lie in many parts, and the list is ranked over several levels."""
    monkeypatch.setattr(prefix_trie, "PART_ROWS", 40)
    monkeypatch.setattr(prefix_trie, "SCAN", 5)
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    rows = random_rows(2, 60, 6) + [(1000, t, "user", f"t{t}") for t in range(150)] + [(2000 + c, 0, "user", "same") for c in range(60)]
    assert run(spark, rows, base=8) == brute(rebuilt(rows))


@pytest.mark.parametrize("n", [1, 2, 500])
def test_list_rank(spark, n):
    order = random.Random(n).sample(range(10 * n), n)
    links = spark.createDataFrame([(a, b, 3) for a, b in zip(order, [*order[1:], None])], "arc long, to long, dist long")
    got = {r["arc"]: r["rank"] for r in prefix_trie.list_rank(links, base=4).collect()}
    assert got == {a: 3 * (n - 1 - k) for k, a in enumerate(order)}


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, "user", "first"), (1, 5, None, None), (2, 0, "user", "x" * 300_000), (3, 1, "user", "a"), (3, 1, "user", "a"), (3, 1, "user", "a")]
    rows += [(c, 0, "user", "only") for c in range(4, 30)]
    want = rebuilt(rows)
    assert [] in want.values() and run(spark, rows) == brute(want)
    assert run(spark, []) == [] and run(spark, [(None, 0, "user", "x")]) == []


def test_member_ids_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    ids = [-40, -1, 0, 5, 7, 8, 100, 99, 10**15]
    got = prefix_trie.id_digests(spark.createDataFrame([(k, c) for k in (1, 2, 3) for c in ids[k:]], "id long, conv_id long").repartition(3))
    assert {r["id"]: r["sha256"] for r in got.collect()} == {k: hashlib.sha256(",".join(map(str, sorted(ids[k:]))).encode()).hexdigest() for k in (1, 2, 3)}
    assert got.filter(F.col("id") == 9).count() == 0
