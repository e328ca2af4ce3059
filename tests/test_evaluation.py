import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import evaluation as ev
from lociframe.operators import runs

SCHEMA = "label int, score double"


def frame(spark, pairs):
    return spark.createDataFrame([(int(a), float(b)) for a, b in pairs], SCHEMA)


def auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    row = ev.roc_auc(frame(spark, [(1, 2), (1, 1), (0, 1), (0, 0)])).first()
    assert row["roc_auc"] == 0.875 and (row["n_pos"], row["n_neg"]) == (2, 2)
    assert ev.roc_auc(frame(spark, [(1, 2), (1, 1)])).first()["roc_auc"] is None


@pytest.mark.parametrize("part_rows", [100_000, 7, 50])
def test_prefix_sums_with_infinities_and_skew(spark, part_rows):
    rng = random.Random(part_rows)
    values = [rng.choice([float("inf"), float("-inf"), 1e300, -1e300, 0.0, rng.gauss(0, 1), round(rng.gauss(0, 1), 1)]) for _ in range(300)]
    pairs = [(rng.randrange(2), v) for v in values]
    points = ev.class_counts(frame(spark, pairs), [], "score", "label")
    got = ev.with_prefix(points, [], "score", ["pos", "neg"], part_rows=part_rows).collect()
    for r in got:
        assert r["neg_before"] == sum(y == 0 and s < r["score"] for y, s in pairs)
        assert r["pos_all"] == sum(y for y, _ in pairs)
        lower = [s for s in set(values) if s < r["score"]]
        assert r["pos_lower"] == (sum(y == 1 and s == max(lower) for y, s in pairs) if lower else None)
    assert len(got) == len(set(values))


def test_grouped_auc_equals_pairs(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(2), rng.choice([rng.random(), 0.5, float("nan")])) for g in "abc" for _ in range(90)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    got = {r["g"]: r["roc_auc"] for r in ev.roc_auc(df, ["g"]).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(auc([(y, s) for h, y, s in rows if h == g and s == s]))


def test_curves_end_where_they_must(spark):
    pairs = [(1, .9), (1, .8), (0, .7), (1, .6), (0, .5), (0, .5), (1, .5)]
    roc = ev.roc_curve(frame(spark, pairs)).collect()
    assert (0.0, 0.0) in {(r["fpr"], r["tpr"]) for r in roc} and (1.0, 1.0) in {(r["fpr"], r["tpr"]) for r in roc}
    pts = sorted((r["fpr"], r["tpr"]) for r in roc)
    assert sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:])) == pytest.approx(auc(pairs))
    pr = ev.pr_curve(frame(spark, pairs)).collect()
    assert any(r["recall"] == 0 and r["precision"] == 1 for r in pr)
    pts = [(r["recall"], r["precision"]) for r in sorted(pr, key=lambda r: -(r["threshold"] if r["threshold"] is not None else 9))]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    row = ev.pr_auc(frame(spark, pairs)).first()
    assert row["pr_auc"] == pytest.approx(area) and row["baseline"] == pytest.approx(4 / 7)


def test_perfect_separation(spark):
    df = frame(spark, [(1, 5), (1, 6), (0, 1), (0, 2)])
    assert ev.roc_auc(df).first()["roc_auc"] == 1.0 and ev.pr_auc(df).first()["pr_auc"] == 1.0


def exact_p(pos, neg):
    u = sum(a > b for a in pos for b in neg)
    n, values = len(pos), pos + neg
    total = hits = 0
    for chosen in itertools.combinations(range(len(values)), n):
        p = [values[i] for i in chosen]
        q = [values[i] for i in range(len(values)) if i not in chosen]
        total += 1
        hits += sum(a > b for a in p for b in q) >= u
    return u, hits / total


def test_mann_whitney_exact_and_normal(spark):
    pos, neg = [3.0, 5.5, 7.1, 2.2], [1.0, 2.0, 4.0, 5.0, 6.0]
    u, p = exact_p(pos, neg)
    row = ev.mann_whitney(frame(spark, [(1, x) for x in pos] + [(0, x) for x in neg])).first()
    assert row["u"] == u and row["p_value"] == pytest.approx(p)
    pos, neg = [1.0, 2.0, 2.0, 3.0], [1.0, 1.0, 2.0]        # ties: normal approximation, by hand
    row = ev.mann_whitney(frame(spark, [(1, x) for x in pos] + [(0, x) for x in neg])).first()
    assert row["u"] == 9.0
    sd = math.sqrt(4 * 3 / 12 * (8 - (24 + 24) / (7 * 6)))
    assert row["p_value"] == pytest.approx(0.5 * math.erfc((9 - 6 - 0.5) / sd / math.sqrt(2)))


def test_quantiles_equal_linear_interpolation(spark):
    rng = random.Random(4)
    values = [rng.choice([rng.random(), 0.25]) for _ in range(101)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = ev.exact_quantiles(df, [], "x", {"a": 0.25, "b": 0.5, "c": 0.9, "d": 1.0, "e": 0.0}).first()
    s = sorted(values)

    def q(p):
        i = p * (len(s) - 1)
        lo = math.floor(i)
        return s[lo] + (s[min(lo + 1, len(s) - 1)] - s[lo]) * (i - lo)
    assert [got[c] for c in "abcde"] == pytest.approx([q(.25), q(.5), q(.9), q(1), q(0)])


def test_cutoffs_with_one_class_give_no_row(spark):
    df = spark.createDataFrame([("m", 1, .1), ("m", 2, .2), ("m", 4, .3), ("m", 1, .4)], "method string, num long, score double")
    got = {r["cutoff"]: (r["roc_auc"], r["n_pos"], r["n_neg"]) for r in ev.auc_by_cutoff(df).collect()}
    assert set(got) == {3} and got[3] == (pytest.approx(2 / 3), 1, 3)


def test_spearman_uses_average_ranks(spark):
    df = spark.createDataFrame([("m", 1, 1.0), ("m", 1, 3.0), ("m", 2, 2.0), ("m", 3, 3.0)], "method string, num long, score double")
    row = ev.score_regression(df).first()
    a, b = [1, 3.5, 2, 3.5], [1.5, 1.5, 3, 4]

    def corr(x, y):
        mx, my = sum(x) / 4, sum(y) / 4
        return sum((i - mx) * (j - my) for i, j in zip(x, y)) / math.sqrt(sum((i - mx) ** 2 for i in x) * sum((j - my) ** 2 for j in y))
    assert row["spearman_rho"] == pytest.approx(corr(a, b)) and row["pearson_r"] == pytest.approx(corr([1, 3, 2, 3], [1, 1, 2, 3]))


def test_effects_need_ten_rows_and_two_classes(spark):
    rows = [("a", i % 2, float(i)) for i in range(12)] + [("b", i % 2, float(i)) for i in range(8)] + [("c", 1, float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "method string, label int, score double")
    assert [r["method"] for r in ev.effect_summary(df).collect()] == ["a"]


def test_balance(spark):
    rows = [(i, 1 if i < 30 else 0, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    counts = {r["label"]: r["count"] for r in ev.balance_scores(df, "id").groupBy("label").count().collect()}
    assert counts == {0: 30, 1: 30}
    flipped = df.withColumn("label", 1 - F.col("label"))
    counts = {r["label"]: r["count"] for r in ev.balance_scores(flipped, "id", "negatives").groupBy("label").count().collect()}
    assert counts == {0: 30, 1: 70}


def test_best_epoch_and_dead_runs(spark):
    rows = [("dead", 0, "0.6931", "0.51"), ("dead", 1, "0.6935", "0.50"), ("live", 0, "0.6931", "0.62"), ("live", 1, "0.6935", "0.50"),
            ("first", 0, "0.6930", ""), ("first", 1, "0.9", ""), ("single", 0, "0.5", "0.7"), ("blank", 0, "nan", ""), ("blank", 1, "", "")]
    df = spark.createDataFrame(rows, "run string, epoch int, val_loss string, val_auc string")
    best = {r["run"]: (r["val_loss"], r["best_epoch"], r["epochs_run"]) for r in runs.best_epoch(df).collect()}
    assert best == {"dead": (0.6931, 0, 2), "live": (0.6931, 0, 2), "first": (0.693, 0, 2), "single": (0.5, 0, 1)}
    assert {r["run"]: r["dead"] for r in runs.dead_run(df).collect()} == {"dead": True, "live": False, "first": True, "single": False}


def test_rows_of_an_earlier_run_are_dropped(spark):
    def log(run, *rows):
        return [(run, i, e, s, v) for i, (e, s, v) in enumerate(rows)]
    schema = "run string, row_no int, epoch string, step string, val_loss string"
    old = log("restart", ("0", "1", "a"), ("1", "2", "b")) + log("goes on", ("0", "1", "a")) + log("changed", ("0", "1", "a"), ("1", "2", "b"))
    new = (log("restart", ("0", "1", "a"), ("1", "2", "b"), ("0", "1", "c")) + log("goes on", ("0", "1", "a"), ("1", "2", "b"))
           + log("changed", ("0", "1", "x"), ("1", "2", "b"), ("0", "1", "c")) + log("new", ("0", "1", "z")))
    got = runs.rows_of_this_run(spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)).collect()
    assert sorted((r["run"], r["row_no"]) for r in got) == [
        ("changed", 0), ("changed", 1), ("changed", 2), ("goes on", 0), ("goes on", 1), ("new", 0), ("restart", 2)]


def test_no_part_is_large_under_a_long_tail(spark):
    """Scores from 10^-300 to 1, and a million of them in a hundredth of the range."""
    from pyspark.sql import functions as F
    for x in (F.pow(F.lit(10.0), -F.col("id") / 1000), F.when(F.col("id") % 100 > 0, 0.5 + F.col("id") * 1e-12).otherwise(F.col("id") * 1e3)):
        points = spark.range(300_000).select(x.alias("score"), F.lit(1).alias("n"))
        parts = ev._parts(points, [], "score", 1000).groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy("_b").collect()
        assert max(r["n"] for r in parts) <= 3000 and sum(r["n"] for r in parts) == 300_000
        assert all(a["hi"] < b["lo"] for a, b in zip(parts, parts[1:]))


def test_exact_p_of_a_small_class_against_all_orders():
    from itertools import combinations
    from math import comb
    for a, b in ((1, 4), (2, 5), (3, 6), (4, 4), (2, 40)):
        us = [sum(c) - a * (a - 1) // 2 for c in combinations(range(a + b), a)]
        for u in range(a * b + 1):
            assert ev._mwu_p(u, a, b, 0) == pytest.approx(sum(x >= u for x in us) / comb(a + b, a))
            assert ev._mwu_p(u, b, a, 0) == ev._mwu_p(u, a, b, 0)
    assert ev._mwu_p(4 * 10**9, 8, 10**9, 0) == pytest.approx(0.5, abs=1e-3)      # no array of 8 times 10^9


def test_effect_medians_and_auc(spark):
    rng = random.Random(5)
    rows = [("m", rng.randrange(2), rng.gauss(0, 1)) for _ in range(201)]
    out = ev.effect_summary(spark.createDataFrame(rows, "method string, label int, score double")).first()
    import statistics
    for name, y in (("median_abs_path", 1), ("median_abs_benign", 0)):
        assert out[name] == pytest.approx(statistics.median(abs(s) for _, l, s in rows if l == y))
    assert out["auc_raw"] == pytest.approx(auc([(l, s) for _, l, s in rows])) and out["auc_abs"] == pytest.approx(auc([(l, abs(s)) for _, l, s in rows]))


def test_method_auc_evaluates_its_rows_once(spark):
    """Sizes, cuts and the draw read one stored table, so that a join or a scorer before it runs once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        seen.add(1)
        return float(i % 7)
    df = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("A").alias("neg_set"), F.lit("m").alias("method"),
                                 (F.col("id") % 3 == 0).cast("int").alias("label"), score.asNondeterministic()("id").alias("score"))
    got = ev.method_auc(df, "id").collect()
    assert (got[0]["n_pos"], got[0]["n_neg"], seen.value) == (100, 100, 300)
