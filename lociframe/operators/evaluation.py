"""Evaluation of scores: ROC and precision-recall, ranks, correlation, quantiles.

Every rank statistic starts from one row per distinct score and group, so copies of a score cost
nothing after the first aggregation. Prefix sums over the scores are taken in two levels: over parts of
bounded size, whose borders Spark's range partitioning takes from the data, then inside each part; no
task orders a whole group. Results are exact. NULL and NaN scores are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lociframe.operators.joins import join_few
from lociframe.operators.sampling import take_by_hash
from lociframe.session import stored

PART_ROWS = 100_000   # distinct scores that are ordered together


def _group(by: Sequence[str], *more) -> list:
    return [*by, *more] if by or more else [F.lit(0)]


def scored(df: DataFrame, score: str = "score") -> DataFrame:
    return df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))


def _parts(points: DataFrame, by: Sequence[str], x: str, part_rows: int) -> DataFrame:
    """points, stored, with _b: numbers of parts of about part_rows rows that never fall as (by, x) grows.

    The rows are distinct, so no value is too frequent for a part, and the borders are sampled quantiles,
    so a long tail or a crowded range makes no part large.
    """
    kept = stored(points)
    n = -(-kept.count() // part_rows)
    if n <= 1:
        return kept.withColumn("_b", F.lit(0))
    return stored(kept.repartitionByRange(2 * n, *by, x).withColumn("_b", F.spark_partition_id()))


def with_prefix(points: DataFrame, by: Sequence[str], x: str, counts: Sequence[str], part_rows: int = PART_ROWS) -> DataFrame:
    """Adds to each point of a group the sum of every count over the smaller x (c_before), the
    group's total (c_all), and the same counts of the next smaller and next larger x
    (c_lower, c_upper; NULL at the ends). points has one row per group and x.
    """
    by = list(by)
    spread = _parts(points, by, x, part_rows)
    row = F.struct(*counts)
    totals = spread.groupBy(*by, "_b").agg(
        *[F.sum(c).alias(c) for c in counts],
        F.min_by(row, x).alias("_first"), F.max_by(row, x).alias("_last"))
    across = Window.partitionBy(*_group(by)).orderBy("_b")    # one row per part of the group
    whole = Window.partitionBy(*_group(by))
    totals = totals.select(
        *by, "_b",
        *[(F.sum(c).over(across) - F.col(c)).alias(f"_{c}_base") for c in counts],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in counts],
        F.lag("_last").over(across).alias("_left"), F.lead("_first").over(across).alias("_right"))
    inside = Window.partitionBy(*by, "_b").orderBy(x)
    joined = spread.join(totals, [*by, "_b"])
    out = joined.select("*", F.coalesce(F.lag(row).over(inside), F.col("_left")).alias("_l"),
                        F.coalesce(F.lead(row).over(inside), F.col("_right")).alias("_r"),
                        *[(F.col(f"_{c}_base") + F.sum(c).over(inside) - F.col(c)).alias(f"{c}_before")
                          for c in counts])
    return out.select(*points.columns, *[f"{c}_{k}" for c in counts for k in ("before", "all")],
                      *[F.col(f"_l.{c}").alias(f"{c}_lower") for c in counts],
                      *[F.col(f"_r.{c}").alias(f"{c}_upper") for c in counts])


def class_counts(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """One row per group and distinct score: pos and neg."""
    positive = F.col(label).cast("int") == 1
    return (scored(df, score).groupBy(*by, F.col(score).cast("double").alias("score"))
            .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")))


def roc_auc(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Per group: roc_auc with ties counted half, U of the positives, and the class sizes.

    Groups with one class only have a NULL roc_auc.
    """
    points = with_prefix(class_counts(df, by, score, label), by, "score", ["pos", "neg"])
    total = points.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("u"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return total.withColumn("roc_auc", F.when(pairs > 0, F.col("u") / pairs)).select(
        *by, "roc_auc", "u", "n_pos", "n_neg")


def roc_curve(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """ROC points per group: threshold, fpr, tpr; (0, 0) has a NULL threshold.

    One point per distinct score, without the inner points whose two neighbouring steps are equal.
    """
    p = with_prefix(class_counts(df, by, score, label), by, "score", ["pos", "neg"])
    inner = F.col("pos_lower").isNotNull() & F.col("pos_upper").isNotNull()
    equal = (F.col("pos") == F.col("pos_lower")) & (F.col("neg") == F.col("neg_lower"))
    kept = p.where(~F.coalesce(inner & equal, F.lit(False))).select(
        *by, F.col("score").alias("threshold"),
        ((F.col("neg_all") - F.col("neg_before")) / F.col("neg_all")).alias("fpr"),
        ((F.col("pos_all") - F.col("pos_before")) / F.col("pos_all")).alias("tpr"))
    start = p.where(F.col("pos_upper").isNull()).select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return kept.unionByName(start)


def pr_curve(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Precision-recall points per group, one per distinct score, and recall 0 with precision 1."""
    p = with_prefix(class_counts(df, by, score, label), by, "score", ["pos", "neg"])
    tp, fp = F.col("pos_all") - F.col("pos_before"), F.col("neg_all") - F.col("neg_before")
    points = p.select(*by, F.col("score").alias("threshold"), (tp / (tp + fp)).alias("precision"),
                      (tp / F.col("pos_all")).alias("recall"))
    end = p.where(F.col("pos_upper").isNull()).select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def pr_auc(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Area under the precision-recall points by trapezoids, and the rate of positives."""
    p = with_prefix(class_counts(df, by, score, label), by, "score", ["pos", "neg"])
    tp, fp = F.col("pos_all") - F.col("pos_before"), F.col("neg_all") - F.col("neg_before")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(1.0)
    area = F.col("pos") / F.col("pos_all") * (tp / (tp + fp) + before) / 2
    return p.groupBy(*by).agg(F.sum(area).alias("pr_auc"),
                              (F.sum("pos") / F.sum(F.col("pos") + F.col("neg"))).alias("baseline"))


def pr_baseline(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("baseline"))


def balance_scores(df: DataFrame, key, mode: str = "both", by: Sequence[str] = (), seed=42,
                   score: str = "score", label: str = "label") -> DataFrame:
    """Both classes cut to the smaller one's size, or only the negatives to the positives'.

    Exact sizes, drawn in hash order; key identifies a row within a group.
    """
    rows = scored(df, score).withColumn("_label", F.col(label).cast("int"))
    sizes = rows.groupBy(*by).agg(F.count_if(F.col("_label") == 1).alias("_p"),
                                  F.count_if(F.col("_label") != 1).alias("_n"))
    smaller = F.least("_p", "_n")
    limit_pos = smaller if mode == "both" else F.col("_p")
    quotas = sizes.select(*by, F.explode(F.array(
        F.struct(F.lit(1).alias("_label"), limit_pos.alias("quota")),
        F.struct(F.lit(0).alias("_label"), smaller.alias("quota")))).alias("q")).select(*by, "q.*")
    return take_by_hash(rows, key, seed, quotas, by=[*by, "_label"]).drop("_label")


def auc_by_cutoff(df: DataFrame, cutoffs: Sequence[float] = (1, 3, 5, 8), by: Sequence[str] = ("method",),
                  score: str = "score", num: str = "num") -> DataFrame:
    """AUC per count cutoff and group, a row being positive when num >= cutoff; cutoffs that
    leave one class only give no row."""
    counts = (scored(df, score).groupBy(*by, score, num).agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
              .groupBy("cutoff", *by, F.col(score).cast("double").alias("score"))
              .agg(F.sum(F.when(F.col(num) >= F.col("cutoff"), F.col("_n")).otherwise(0)).alias("pos"),
                   F.sum(F.when(F.col(num) < F.col("cutoff"), F.col("_n")).otherwise(0)).alias("neg")))
    keys = ["cutoff", *by]
    points = with_prefix(counts, keys, "score", ["pos", "neg"])
    return (points.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("_u"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
        .where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
        .withColumn("roc_auc", F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg")))
        .drop("_u"))


def average_ranks(df: DataFrame, by: Sequence[str], x: str, out: str) -> DataFrame:
    """(by, x, out): average rank of each distinct x, minus the mean rank."""
    points = df.groupBy(*by, x).agg(F.sum("_n").alias("_c"))
    ranked = with_prefix(points, by, x, ["_c"])
    return ranked.select(*by, x, (F.col("_c_before") + F.col("_c") / 2 - F.col("_c_all") / 2).alias(out))


def score_regression(df: DataFrame, by: Sequence[str] = ("method",), score: str = "score",
                     num: str = "num") -> DataFrame:
    """Pearson, Spearman with average ranks, and the least-squares line of num on score."""
    by = list(by)
    rows = scored(df, score).where(F.col(num).isNotNull())
    line = rows.groupBy(*by).agg(
        F.corr(score, num).alias("pearson_r"), F.regr_slope(num, score).alias("slope"),
        F.regr_intercept(num, score).alias("intercept"), F.count(F.lit(1)).alias("n"))
    pairs = stored(rows.groupBy(*by, score, num).agg(F.count(F.lit(1)).alias("_n")))
    ranked = (pairs.join(average_ranks(pairs, by, score, "_rx"), [*by, score])
              .join(average_ranks(pairs, by, num, "_ry"), [*by, num]))
    w, rx, ry = F.col("_n"), F.col("_rx"), F.col("_ry")
    spread = F.sqrt(F.sum(w * rx * rx)) * F.sqrt(F.sum(w * ry * ry))
    spearman = ranked.groupBy(*by).agg(
        F.when(spread > 0, F.sum(w * rx * ry) / spread).alias("spearman_rho"))
    if not by:
        return line.withColumn("spearman_rho", spearman.scalar())
    return line.join(spearman, by)


def binned_scores(df: DataFrame, by: Sequence[str] = ("method",), score: str = "score", num: str = "num",
                  top: int = 20, more_than: int = 5) -> DataFrame:
    """Mean and population standard deviation of the score per whole count 1..top, for counts with
    more than five rows."""
    return (scored(df, score).where((F.col(num) >= 1) & (F.col(num) <= top) & (F.col(num) == F.floor(num)))
            .groupBy(*by, num)
            .agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > more_than))


def exact_quantiles(df: DataFrame, by: Sequence[str], x: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles with linear interpolation, exact on any number of rows, as named columns per group."""
    by = list(by)
    points = (scored(df, x).groupBy(*by, F.col(x).cast("double").alias("_x"))
              .agg(F.count(F.lit(1)).alias("_c")))
    ranked = with_prefix(points, by, "_x", ["_c"])

    def at(index):
        return F.max(F.when((F.col("_c_before") <= index) & (index < F.col("_c_before") + F.col("_c")), F.col("_x")))

    columns = []
    for name, p in probs.items():
        place = (F.col("_c_all") - 1) * F.lit(float(p))
        low = at(F.floor(place))
        part = F.max(place - F.floor(place))
        columns.append((low + F.when(part > 0, part * (at(F.ceil(place)) - low)).otherwise(0.0)).alias(name))
    return ranked.groupBy(*by).agg(*columns)


def value_summary(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """n of all rows; min, median, mean, max of the finite numbers."""
    by = list(by)
    finite = df.where(F.abs(F.col(col).cast("double")) < float("inf"))
    one = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    value = F.col(col).cast("double")
    ok = F.when(F.abs(value) < float("inf"), value)
    one = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(ok).alias("min"),
                              F.avg(ok).alias("mean"), F.max(ok).alias("max"))
    middle = exact_quantiles(finite, by, col, {"median": 0.5})
    return one.join(middle, by, "left") if by else one.withColumn("median", middle.scalar())


def mann_whitney(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """One-sided Mann-Whitney test that positives score higher: u, n_pos, n_neg, p_value.

    U and the tie term are Spark aggregates. The p-value is taken on the one row per group: exact
    when a class has at most 8 rows and no score is shared, else the normal approximation with tie
    and continuity correction.
    """
    points = with_prefix(class_counts(df, by, score, label), by, "score", ["pos", "neg"])
    t = (F.col("pos") + F.col("neg")).cast("double")
    stats = points.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("u"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.sum(t * t * t - t).alias("_ties"))

    return stats.withColumn("p_value", _p_values("u", "n_pos", "n_neg", "_ties")).drop("_ties")


@F.pandas_udf(DoubleType())
def _p_values(u: pd.Series, a: pd.Series, b: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([_mwu_p(*row) for row in zip(u, a, b, ties)], dtype=object)


@lru_cache
def _sums_upto(parts: int) -> list[int]:
    """How many multisets of 1..parts have a sum of at most n, for so many n that the rule below is fixed by them."""
    period = math.lcm(*range(1, parts + 1))
    ways = [1] + [0] * (period * (parts + 2))
    for part in [1, *range(1, parts + 1)]:      # the second 1 sums up
        for n in range(part, len(ways)):
            ways[n] += ways[n - part]
    return ways


def _multisets_upto(n: int, parts: int) -> int:
    """_sums_upto for any n: on the numbers of one remainder by the period it is a polynomial of degree `parts`."""
    known, period = _sums_upto(parts), math.lcm(*range(1, parts + 1))
    if n < len(known):
        return known[n] if n >= 0 else 0
    k, rest = divmod(n, period)
    total = Fraction(0)
    for i in range(parts + 1):
        weight = Fraction(known[rest + i * period])
        for j in range(parts + 1):
            if j != i:
                weight *= Fraction(k - j, i - j)
        total += weight
    return int(total)


def _orders_below(u: int, a: int, b: int) -> int:
    """How many orders of a and b rows have a U below u: partial sums of the Gaussian binomial, whose numerator
    is multiplied out (2^a terms), so that memory does not depend on b."""
    total = 0
    for chosen in range(1 << a):
        taken = [b + i + 1 for i in range(a) if chosen >> i & 1]
        total += (-1) ** len(taken) * _multisets_upto(u - 1 - sum(taken), a)
    return total


def _mwu_p(u: float, a: int, b: int, ties: float) -> float | None:
    a, b = int(a), int(b)
    if a == 0 or b == 0:
        return None
    if ties == 0 and min(a, b) <= 8:
        return float(1 - Fraction(_orders_below(math.ceil(u), min(a, b), max(a, b)), math.comb(a + b, min(a, b))))
    n = a + b
    variance = a * b / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    if variance <= 0:
        return 1.0
    z = (u - a * b / 2.0 - 0.5) / math.sqrt(variance)
    return 0.5 * math.erfc(z / math.sqrt(2))


def long_scores(df: DataFrame, columns: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """One row per row and method; columns maps a method's name to its column."""
    return df.select(*keep, F.explode(F.array(*[
        F.struct(F.lit(name).alias("method"), F.col(c).cast("double").alias("score"))
        for name, c in columns.items()])).alias("m")).select(*keep, "m.*")


def effect_summary(long: DataFrame, label: str = "label", least: int = 10,
                   by: Sequence[str] = ("method",)) -> DataFrame:
    """Per method with at least ten scored rows and both classes: AUC of the absolute and of the raw
    effect, the Mann-Whitney p of the absolute one, median absolute effect and count per class."""
    by = list(by)
    rows = scored(long).withColumn("abs_score", F.abs("score"))
    points = stored(with_prefix(class_counts(rows, by, "abs_score", label), by, "score", ["pos", "neg"]))
    t = (F.col("pos") + F.col("neg")).cast("double")

    def median(count):
        def at(index):
            return F.max(F.when((F.col(f"{count}_before") <= index) & (index < F.col(f"{count}_before") + F.col(count)), F.col("score")))
        place = (F.col(f"{count}_all") - 1) / 2
        return (at(F.floor(place)) + at(F.ceil(place))) / 2
    stats = points.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n_path"), F.sum("neg").alias("n_benign"),
        F.sum(t * t * t - t).alias("_ties"), median("pos").alias("median_abs_path"), median("neg").alias("median_abs_benign"))
    raw = roc_auc(rows, by, "score", label).select(*by, F.col("roc_auc").alias("auc_raw"))
    return (stats.where((F.col("n_path") + F.col("n_benign") >= least) & (F.col("n_path") > 0) & (F.col("n_benign") > 0))
            .withColumn("auc_abs", F.col("u") / (F.col("n_path").cast("double") * F.col("n_benign")))
            .withColumn("mwu_p", _p_values("u", "n_path", "n_benign", "_ties")).join(raw, by)
            .select(*by, "auc_abs", "auc_raw", "mwu_p", "median_abs_path", "median_abs_benign", "n_path", "n_benign"))


def method_auc(df: DataFrame, key, least: int = 10, by: Sequence[str] = ("neg_set", "method"),
               seed=42, label: str = "label") -> DataFrame:
    """AUC per negative set and method on balanced classes; NULL scores dropped, groups with fewer
    than `least` rows in a class left out."""
    by = list(by)
    rows = stored(scored(df).select(*by, key, label, "score"))      # read for the sizes, the cuts and the draw
    big = rows.groupBy(*by).agg(F.count_if(F.col(label).cast("int") == 1).alias("_p"),
                                F.count_if(F.col(label).cast("int") != 1).alias("_n"))
    # One row per group: a shuffle on the groups would deal all rows to a few tasks.
    kept = join_few(rows, stored(big.where((F.col("_p") >= least) & (F.col("_n") >= least)).select(*by)), by)
    return roc_auc(balance_scores(kept, key, "both", by, seed, label=label), by, label=label).select(
        *by, F.col("roc_auc").alias("auc"), "n_pos", "n_neg")


def auc_pivot(df: DataFrame, rows: str = "method", columns: str = "neg_set", values: Sequence | None = None,
              auc: str = "auc") -> DataFrame:
    """Methods as rows, negative sets as columns."""
    return df.groupBy(rows).pivot(columns, list(values) if values else None).agg(F.avg(auc))


def auc_grid(df: DataFrame, by: Sequence[str], curves: Sequence[str] = ("ROC", "PR"), key=None,
             seed=42) -> DataFrame:
    """AUC per parameter combination and curve in one table.

    With a key, negatives beyond the number of positives are drawn away for ROC, not for PR.
    """
    by, parts = list(by), []
    if "ROC" in curves:
        rows = balance_scores(df, key, "negatives", by, seed) if key is not None else df
        parts.append(roc_auc(rows, by).select(*by, F.lit("ROC").alias("curve_type"), F.col("roc_auc").alias("auc")))
    if "PR" in curves:
        parts.append(pr_auc(df, by).select(*by, F.lit("PR").alias("curve_type"), F.col("pr_auc").alias("auc")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def box_stats(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Quartiles and whiskers (the furthest values within 1.5 box heights) per group."""
    by = list(by)
    q = exact_quantiles(df, by, x, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return (scored(df, x).join(q, by)
            .groupBy(*by, "q1", "median", "q3")
            .agg(F.min(F.when(F.col(x) >= F.col("q1") - reach, F.col(x))).alias("whisker_low"),
                 F.max(F.when(F.col(x) <= F.col("q3") + reach, F.col(x))).alias("whisker_high"),
                 F.count_if((F.col(x) < F.col("q1") - reach) | (F.col(x) > F.col("q3") + reach)).alias("n_outliers")))

