import random

import pytest

from lociframe.operators import events as ev

USES = "use_id long, tool string, args string, ts_ms long, end_ms long"
CALLS = "call_id long, tool string, args string, ts_ms long"


def fits(use, call, slack):
    return call[3] >= use[3] - slack and (use[4] is None or call[3] <= use[4] + slack)


def by_hand(uses, calls, slack):
    """All candidates in order, each taken if both sides are free; then the earliest free call of the tool."""
    order = sorted((c[3] < u[3], abs(c[3] - u[3]), u[0], c[0]) for u in uses for c in calls
                   if u[1:3] == c[1:3] and fits(u, c, slack))
    pairs, taken = {}, set()
    for _, _, u, c in order:
        if u not in pairs and c not in taken:
            pairs[u] = (c, "arguments")
            taken.add(c)
    for u in sorted(uses, key=lambda u: (u[3], u[0])):
        if u[0] in pairs or any(c[1:3] == u[1:3] for c in calls):
            continue
        for c in sorted(calls, key=lambda c: (c[3], c[0])):
            if c[1] == u[1] and c[0] not in taken and fits(u, c, slack):
                pairs[u[0]] = (c[0], "order")
                taken.add(c[0])
                break
    return sorted((u, c, how) for u, (c, how) in pairs.items())


@pytest.mark.parametrize("seed", range(4))
def test_matching_equals_the_greedy_choice(spark, rows, seed):
    """Dense logs with ties, late and missing results, calls before their use and unknown arguments."""
    rng = random.Random(seed)
    span = rng.choice([60, 400, 3000])
    uses, calls = [], []
    for i in range(70):
        t = rng.randrange(span) * 100
        uses.append((i, rng.choice("ab"), rng.choice(["x", "y", "z", "q"]), t, rng.choice([None, t + rng.randrange(0, 9000), t + 500])))
    for i in range(60):
        calls.append((i, rng.choice("ab"), rng.choice(["x", "y", "z"]), rng.randrange(span) * 100))
    got = ev.match_events(spark.createDataFrame(uses, USES), spark.createDataFrame(calls, CALLS), 700)
    assert rows(got, "use_id", "call_id", "how") == by_hand(uses, calls, 700)


def test_nested_calls_pair_from_the_inside(spark, rows):
    uses = [(1, "t", "{}", 0, 100_000), (2, "t", "{}", 10, 100_000), (3, "t", "{}", 20, 25)]
    calls = [(7, "t", "{}", 11), (8, "t", "{}", 90_000)]
    got = ev.match_events(spark.createDataFrame(uses, USES), spark.createDataFrame(calls, CALLS), 5)
    assert rows(got, "use_id", "call_id") == [(u, c) for u, c, _ in by_hand(uses, calls, 5)] == [(1, 8), (2, 7)]


def test_timeline(spark):
    uses = spark.createDataFrame([(1, "t", "{}", 10_000, None), (2, "t", "{}", 20_000, None)], USES)
    calls = spark.createDataFrame([(1, "t", "{}", 10_001), (2, "t", "{}", 15_000), (3, "t", "{}", 90_000)], CALLS)
    pairs = spark.createDataFrame([(1, 1, "arguments")], "use_id long, call_id long, how string")
    got = ev.timeline(uses, calls, pairs)
    assert [(r["ts_ms"], r["status"]) for r in got.collect()] == [
        (10_000, "matched"), (15_000, "call_log_only"), (20_000, "transcript_only"), (90_000, "outside")]
    assert {r["status"]: r["n"] for r in ev.timeline_counts(got).collect()} == {
        "matched": 1, "call_log_only": 1, "transcript_only": 1, "outside": 1}


def test_phases_take_the_first_rule(spark):
    df = spark.createDataFrame([("prepare_x",), ("scan",), ("scan_all",), ("a.b",), ("axb",)], "tool string")
    rules = [("scan", "One"), ("prepare_*", "Prep"), ("scan*", "Two"), ("a.b", "Dot")]
    assert {r["tool"]: r["phase"] for r in ev.label_phase(df, rules).collect()} == {
        "prepare_x": "Prep", "scan": "One", "scan_all": "Two", "a.b": "Dot", "axb": "Analysis"}


def test_arguments_are_compared_as_json(spark, rows):
    uses = [(1, "t", '{"a":1,"b":[1, 2]}', 0, 10), (2, "t", "not json", 100_000, None)]
    calls = [(7, "t", '{ "b": [1,2], "a": 1 }', 5), (8, "t", "not json", 100_001)]
    got = ev.match_events(spark.createDataFrame(uses, USES), spark.createDataFrame(calls, CALLS))
    assert rows(got, "use_id", "call_id", "how") == [(1, 7, "arguments"), (2, 8, "arguments")]


def test_events_without_a_time_fit_anything(spark, rows):
    uses = [(1, "t", "{}", 0, 10), (2, "t", "{}", 9_000_000, None), (3, "t", "{}", None, None), (4, "s", "{}", None, None)]
    calls = [(7, "t", "{}", None), (8, "t", "{}", 9_000_001), (9, "t", "{}", 5_000_000), (10, "s", "{}", None)]
    got = ev.match_events(spark.createDataFrame(uses, USES), spark.createDataFrame(calls, CALLS))
    assert rows(got, "use_id", "call_id") == [(1, 7), (3, 8), (4, 10)]


@pytest.mark.parametrize("seed", range(2))
def test_matching_over_split_parts(spark, rows, monkeypatch, seed):
    """Groups, depths and queues that reach over many borders of parts; every third use has no end."""
    from lociframe.operators import running
    monkeypatch.setattr(running, "PART_ROWS", 12)
    rng = random.Random(100 + seed)
    uses, calls = [], []
    for i in range(90):
        t = rng.randrange(300) * 100
        uses.append((i, "a", rng.choice(["x", "q"]), t, None if i % 3 == 0 else t + rng.randrange(0, 4000)))
    for i in range(70):
        calls.append((i, "a", rng.choice(["x", "z"]), rng.randrange(300) * 100))
    got = ev.match_events(spark.createDataFrame(uses, USES), spark.createDataFrame(calls, CALLS), 700)
    assert rows(got, "use_id", "call_id", "how") == by_hand(uses, calls, 700)


def test_pairs_that_give_up_inside_each_other(spark, rows):
    """The inner use takes the only call in the time of the outer ones, one after the other."""
    uses = [(k, "t", "{}", 10 * k, 10 * k + 1000 * (8 - k)) for k in range(8)]
    calls = [(k, "t", "{}", 900 + 950 * k) for k in range(8)]
    got = ev.match_events(spark.createDataFrame(uses, USES), spark.createDataFrame(calls, CALLS), 5)
    assert rows(got, "use_id", "call_id", "how") == by_hand(uses, calls, 5)


def test_a_queue_with_misses(spark, rows):
    """More uses than calls in their time: who comes first is served, who waits too long is not."""
    uses = [(k, "t", f"u{k}", 100 * k, 100 * k + (50 if k % 3 else 5000)) for k in range(20)]
    calls = [(k, "t", "c", 130 * k + 20) for k in range(12)]
    got = ev.match_events(spark.createDataFrame(uses, USES), spark.createDataFrame(calls, CALLS), 30)
    want = by_hand(uses, calls, 30)
    assert rows(got, "use_id", "call_id", "how") == want and 0 < len(want) < 20


@pytest.mark.parametrize("part_rows", [7, 1000])
def test_running_numbers(spark, part_rows):
    from lociframe.operators.running import running
    from pyspark.sql import functions as F
    rng = random.Random(5)
    data = [(rng.choice("aab"), k, rng.randrange(9)) for k in rng.sample(range(1000), 120)]
    df = spark.createDataFrame(data, "g string, k long, x long")
    got = running(df, ["g"], ["k"], {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "n": ("min", F.col("x"))}, part_rows)
    for g, k, _, s, m, n in got.collect():
        own = [r[2] for r in data if r[0] == g and r[1] <= k]
        assert (s, m, n) == (sum(own), max(own), min(own))
