"""Evaluation aggregates over the driver's tables."""

from pyspark.sql import functions as F

from lociframe.operators import evaluation as ev
from lociframe.operators import runs
from lociframe.queries.registry import query

METHODS = ["method"]

# Average ranks per method, and U and AUC from them.
_RANKED = """ranked AS (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY {s})
    + (count(*) OVER (PARTITION BY {g}, {s}) - 1) / 2.0::DOUBLE AS r FROM {t})"""
_AUC = """(sum(r) FILTER ({l} = 1) - count(*) FILTER ({l} = 1) * (count(*) FILTER ({l} = 1) + 1) / 2.0::DOUBLE)"""
_N1, _N0 = "count(*) FILTER ({l} = 1)", "count(*) FILTER ({l} <> 1)"


def auc_sql(table, group, score="score", label="label", extra=""):
    u, n1, n0 = (x.format(l=label) for x in (_AUC, _N1, _N0))
    return (f"WITH {_RANKED.format(g=group, s=score, t=table)} SELECT {group}, "
            f"round({u} / (({n1})::DOUBLE * ({n0})), 6) AS roc_auc{extra} FROM ranked GROUP BY {group}")


# Counts per distinct score and their running sums from the top.
_CUM = """cum AS (SELECT method, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY method) AS np, sum(neg) OVER (PARTITION BY method) AS nn,
    lead(pos) OVER w2 AS pos2, lead(neg) OVER w2 AS neg2, lag(pos) OVER w2 AS pos0 FROM (
        SELECT method, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
        FROM scores GROUP BY method, score)
    WINDOW w AS (PARTITION BY method ORDER BY score DESC ROWS UNBOUNDED PRECEDING),
        w2 AS (PARTITION BY method ORDER BY score DESC))"""


@query("roc_curve", "E1", views="scores", sql=f"""
    WITH {_CUM} SELECT method, round(score, 6) AS threshold, round(fp / nn, 6) AS fpr, round(tp / np, 6) AS tpr
    FROM cum WHERE pos0 IS NULL OR pos2 IS NULL OR pos2 <> pos OR neg2 <> neg
    UNION ALL SELECT DISTINCT method, NULL, 0.0::DOUBLE, 0.0::DOUBLE FROM scores""")
def _(v):
    return ev.roc_curve(v.scores, METHODS).select("method", *[F.round(c, 6).alias(c) for c in ("threshold", "fpr", "tpr")])


@query("roc_auc", "E2", views="scores", sql=auc_sql(
    "scores", "method", extra=f", {_N1.format(l='label')} AS n_pos, {_N0.format(l='label')} AS n_neg"))
def _(v):
    return ev.roc_auc(v.scores, METHODS).select("method", F.round("roc_auc", 6).alias("roc_auc"), "n_pos", "n_neg")


@query("pr_curve", "E3", views="scores", sql=f"""
    WITH {_CUM} SELECT method, round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / np, 6) AS recall
    FROM cum UNION ALL SELECT DISTINCT method, NULL, 1.0::DOUBLE, 0.0::DOUBLE FROM scores""")
def _(v):
    return ev.pr_curve(v.scores, METHODS).select(
        "method", *[F.round(c, 6).alias(c) for c in ("threshold", "precision", "recall")])


_PR = f"""{_CUM}, pr AS (SELECT method, round(sum(pos / np * (tp / (tp + fp) +
    CASE WHEN tp + fp > pos + neg THEN (tp - pos) / (tp + fp - pos - neg) ELSE 1 END) / 2), 6) AS auc FROM cum GROUP BY method)"""


@query("pr_auc", "E3", views="scores", sql=f"WITH {_PR} SELECT method, auc AS pr_auc FROM pr")
def _(v):
    return ev.pr_auc(v.scores, METHODS).select("method", F.round("pr_auc", 6).alias("pr_auc"))


@query("pr_baseline", "E13", views="scores",
       sql="SELECT method, round(avg(label), 6) AS baseline FROM scores GROUP BY method")
def _(v):
    return ev.pr_baseline(v.scores, METHODS).select("method", F.round("baseline", 6).alias("baseline"))


_BALANCED = """balanced AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {g}, label
        ORDER BY md5('42:' || id)) AS k, least(count(*) FILTER (label = 1) OVER (PARTITION BY {g}),
        count(*) FILTER (label = 0) OVER (PARTITION BY {g})) AS m FROM {t})
    WHERE k <= m{only})"""


@query("balance_scores", "E4", views="scores", sql=f"""
    WITH {_BALANCED.format(g='method', t='scores', only='')} SELECT method, id, label FROM balanced""")
def _(v):
    return ev.balance_scores(v.scores, "id", "both", METHODS).select("method", "id", "label")


@query("balance_negatives", "E4", views="scores", sql=f"""
    WITH flipped AS (SELECT id, method, 1 - label AS label FROM scores),
    {_BALANCED.format(g='method', t='flipped', only=' OR label = 1')} SELECT method, id, label FROM balanced""")
def _(v):
    flipped = v.scores.withColumn("label", 1 - F.col("label"))
    return ev.balance_scores(flipped, "id", "negatives", METHODS).select("method", "id", "label")


@query("auc_by_cutoff", "E5", views="scores", sql="""
    WITH c AS (SELECT cutoff::INTEGER AS cutoff, method, score, CASE WHEN num >= cutoff THEN 1 ELSE 0 END AS label
        FROM scores, (VALUES (1), (3), (5), (8)) t(cutoff)),
    both_classes AS (SELECT *, min(label) OVER g <> max(label) OVER g AS ok FROM c
        WINDOW g AS (PARTITION BY cutoff, method)),
    kept AS (SELECT * FROM both_classes WHERE ok), """ + auc_sql(
    "kept", "cutoff, method", extra=", count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label <> 1) AS n_neg")[5:])
def _(v):
    out = ev.auc_by_cutoff(v.scores)
    return out.select("cutoff", "method", F.round("roc_auc", 6).alias("roc_auc"), "n_pos", "n_neg")


@query("score_regression", "E6", views="scores", sql="""
    WITH r AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0::DOUBLE AS rx,
        rank() OVER (PARTITION BY method ORDER BY num) + (count(*) OVER (PARTITION BY method, num) - 1) / 2.0::DOUBLE AS ry FROM scores)
    SELECT method, round(corr(score, num), 6) AS pearson_r, round(corr(rx, ry), 6) AS spearman_rho,
        round(regr_slope(num, score), 6) AS slope, round(regr_intercept(num, score), 6) AS intercept, count(*) AS n
    FROM r GROUP BY method""")
def _(v):
    out = ev.score_regression(v.scores)
    return out.select("method", "n", *[F.round(c, 6).alias(c) for c in ("pearson_r", "spearman_rho", "slope", "intercept")])


@query("binned_scores", "E7", views="scores", sql="""
    SELECT method, num, round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS std, count(*) AS n
    FROM scores WHERE num BETWEEN 1 AND 20 GROUP BY method, num HAVING count(*) > 5""")
def _(v):
    return ev.binned_scores(v.scores).withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query("mann_whitney_u", "E8", views="scores", sql=f"""
    WITH a AS (SELECT method, label, abs(score) AS s FROM scores), {_RANKED.format(g='method', s='s', t='a')},
    ties AS (SELECT method, sum(t * t * t - t) AS ties FROM (
        SELECT method, count(*)::DOUBLE AS t FROM a GROUP BY method, s) GROUP BY method),
    us AS (SELECT method, {_AUC.format(l='label')} AS u, {_N1.format(l='label')}::DOUBLE AS n1,
        {_N0.format(l='label')}::DOUBLE AS n0 FROM ranked GROUP BY method)
    SELECT method, u, n1::BIGINT AS n_pos, n0::BIGINT AS n_neg, round((u - n1 * n0 / 2 - 0.5) / sqrt(n1 * n0 / 12
        * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))), 6) AS z FROM us JOIN ties USING (method)""")
def _(v):
    rows = v.scores.withColumn("score", F.abs("score"))
    test = ev.mann_whitney(rows, METHODS)

    @F.pandas_udf("double")
    def z_of(p):   # the z whose upper tail is p, to compare with SQL, which has no error function
        from statistics import NormalDist
        return p.map(lambda x: -NormalDist().inv_cdf(x))

    return test.select("method", "u", "n_pos", "n_neg", F.round(z_of("p_value"), 6).alias("z"))


@query("effect_summary", "E9", views="scores", sql=f"""
    WITH a AS (SELECT *, abs(score) AS s FROM scores), {_RANKED.format(g='method', s='s', t='a')},
    raw AS ({auc_sql('scores', 'method').replace('ranked', 'ranked2')})
    SELECT method, round({_AUC.format(l='label')} / (({_N1.format(l='label')})::DOUBLE * {_N0.format(l='label')}), 6) AS auc_abs,
        any_value(raw.roc_auc) AS auc_raw, round(median(s) FILTER (label = 1), 6) AS median_abs_path,
        round(median(s) FILTER (label = 0), 6) AS median_abs_benign,
        {_N1.format(l='label')} AS n_path, {_N0.format(l='label')} AS n_benign
    FROM ranked JOIN raw USING (method) GROUP BY method""")
def _(v):
    out = ev.effect_summary(v.scores)
    return out.select("method", *[F.round(c, 6).alias(c) for c in (
        "auc_abs", "auc_raw", "median_abs_path", "median_abs_benign")], "n_path", "n_benign")


# The returned goods against the accepted and the unflagged ones.
_SETS = """sets AS MATERIALIZED (SELECT s.id, s.method, s.score, n.neg_set, CASE WHEN tf = 'R' THEN 1 ELSE 0 END AS label
    FROM scores s JOIN (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_returnflag AS tf
        FROM lineitem) USING (id), (VALUES ('A'), ('N')) n(neg_set) WHERE tf = 'R' OR tf = neg_set)"""


def _sets(v):
    flag = v.table("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_returnflag").alias("tf"))
    sets = F.when(F.col("tf") == "R", F.array(F.lit("A"), F.lit("N"))).otherwise(F.array("tf"))
    return (v.scores.drop("label").join(flag, "id")
            .withColumn("neg_set", F.explode(sets))
            .select("id", "method", "score", "neg_set", (F.col("tf") == "R").cast("int").alias("label")))


_METHOD_AUC = f"""{_SETS}, {_BALANCED.format(g='neg_set, method', t='sets', only='')},
    aucs AS ({auc_sql('balanced', 'neg_set, method', extra=f", {_N1.format(l='label')} AS n_pos, {_N0.format(l='label')} AS n_neg")})"""


@query("method_auc", "E10", views="scores", sql=f"""
    WITH {_METHOD_AUC} SELECT neg_set, method, roc_auc AS auc, n_pos, n_neg FROM aucs""")
def _(v):
    return ev.method_auc(_sets(v), "id").withColumn("auc", F.round("auc", 6))


@query("auc_pivot", "E11", views="scores", sql=f"""
    WITH {_METHOD_AUC} SELECT method, max(roc_auc) FILTER (neg_set = 'A') AS "A", max(roc_auc) FILTER (neg_set = 'N') AS "N"
    FROM aucs GROUP BY method""")
def _(v):
    return ev.auc_pivot(ev.method_auc(_sets(v), "id").withColumn("auc", F.round("auc", 6)), values=["A", "N"])


@query("auc_grid", "E12", views="scores", sql=f"""
    WITH {_PR}, roc AS ({auc_sql('scores', 'method')}) SELECT method, 'ROC' AS curve_type, roc_auc AS auc FROM roc
    UNION ALL SELECT method, 'PR', auc FROM pr""")
def _(v):
    return ev.auc_grid(v.scores, METHODS).withColumn("auc", F.round("auc", 6))


@query("box_stats", "E14", views="scores", sql="""
    WITH q AS (SELECT method, label, quantile_cont(abs(score), 0.25) AS q1, quantile_cont(abs(score), 0.5) AS median,
        quantile_cont(abs(score), 0.75) AS q3 FROM scores GROUP BY method, label)
    SELECT method, label, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
        round(min(x) FILTER (x >= q1 - (q3 - q1) * 1.5), 6) AS whisker_low,
        round(max(x) FILTER (x <= q3 + (q3 - q1) * 1.5), 6) AS whisker_high,
        count(*) FILTER (x < q1 - (q3 - q1) * 1.5 OR x > q3 + (q3 - q1) * 1.5) AS n_outliers
    FROM (SELECT method, label, abs(score) AS x FROM scores) JOIN q USING (method, label) GROUP BY ALL""")
def _(v):
    out = ev.box_stats(v.scores.withColumn("x", F.abs("score")), ["method", "label"], "x")
    return out.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})


_BEST = """best AS (SELECT run, arg_min(val_loss, k) AS val_loss, arg_min(val_auc, k) AS val_auc, arg_min(epoch, k) AS best_epoch,
    any_value(n) AS epochs_run FROM (SELECT *, (val_loss, epoch) AS k, max(epoch) OVER (PARTITION BY run) + 1 AS n FROM {t})
    WHERE val_loss IS NOT NULL GROUP BY run)"""


@query("best_epoch", "E15", views="runs", sql=f"""
    WITH {_BEST.format(t='runs')} SELECT run, round(val_loss, 6) AS val_loss, round(val_auc, 6) AS val_auc, best_epoch, epochs_run FROM best""")
def _(v):
    return runs.best_epoch(v.runs).withColumns({c: F.round(c, 6) for c in ("val_loss", "val_auc")})


@query("dead_run", "E16", views="runs", sql=f"""
    WITH flat AS (SELECT run, epoch, val_auc, CASE WHEN val_loss IS NOT NULL THEN 0.6931 + run % 3 * 0.003 + val_loss * 0.0001
        * (CASE WHEN run % 2 = 0 THEN epoch ELSE 0 END) END AS val_loss FROM runs),
    {_BEST.format(t='flat')}, span AS (SELECT run, bool_and(abs(val_loss - ln(2)) <= 0.005) AS flat, min(epoch) AS a, max(epoch) AS z
        FROM flat WHERE val_loss IS NOT NULL GROUP BY run)
    SELECT run, best_epoch, (flat OR (best_epoch = a AND z > a AND abs(val_loss - ln(2)) <= 0.005))
        AND coalesce(abs(val_auc - 0.5) < 0.05, true) AS dead FROM best JOIN span USING (run)""")
def _(v):
    loss = F.lit(0.6931) + F.col("run") % 3 * 0.003 + F.col("val_loss") * 0.0001 * F.when(
        F.col("run") % 2 == 0, F.col("epoch")).otherwise(0)
    return runs.dead_run(v.runs.withColumn("val_loss", loss)).select("run", "best_epoch", "dead")


@query("rows_of_this_run", "E15", views="runs", sql="""
    WITH n AS (SELECT *, count(*) OVER (PARTITION BY run) // 2 AS m FROM runs)
    SELECT run, epoch FROM n WHERE run % 2 = 1 OR epoch >= m""")
def _(v):
    sizes = v.runs.groupBy("run").agg(F.expr("count(1) div 2").alias("m"))
    rows = v.runs.join(sizes, "run").select(
        "run", F.col("epoch").alias("row_no"),
        F.when((F.col("run") % 2 == 0) & (F.col("epoch") >= F.col("m")), F.col("epoch") - F.col("m"))
        .otherwise(F.col("epoch")).alias("epoch"), F.lit(0).alias("step"), "val_loss", "m")
    before = rows.where(F.col("row_no") < F.col("m")).drop("m")
    return runs.rows_of_this_run(rows.drop("m"), before).select("run", F.col("row_no").alias("epoch"))
