"""Datasets, models, variant predicates, event logs and structures over the driver's tables."""

from pyspark.sql import functions as F

from lociframe.operators import clinical as cl
from lociframe.operators import datasets as ds
from lociframe.operators import evaluation as ev
from lociframe.operators import events as evt
from lociframe.operators import models as md
from lociframe.operators import structure as st
from lociframe.queries.registry import query
from lociframe.queries.views import weight_scorer, weight_sum_sql


@query("make_classification", "D1", views="reads", sql="""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || label::VARCHAR || ':' || id::VARCHAR)) AS k,
        least(count(*) FILTER (label = 1) OVER (), count(*) FILTER (label = 0) OVER ()) AS m FROM reads)
    SELECT id, label, md5('42-order:' || label::VARCHAR || ':' || id::VARCHAR) AS order_key FROM r WHERE k <= m""")
def _(v):
    rows = v.reads
    return ds.make_classification(rows.where("label = 1"), rows.where("label = 0")).select("id", "label", "order_key")


@query("make_regression", "D2", views="reads", sql="""
    WITH k AS (SELECT * FROM reads WHERE value >= 50000), m AS (SELECT avg(value) AS a, stddev_samp(value) AS s FROM k)
    SELECT id, round(log2(value + 1), 6) AS log2, round(log10(value + 1), 6) AS log10, round((value - a) / (s + 1e-8), 6) AS z FROM k, m""")
def _(v):
    def one(name, out):
        rows, _ = ds.make_regression(v.reads, name, 50000, "value")
        return rows.select("id", F.round("label", 6).alias(out))
    return one("log2", "log2").join(one("log10", "log10"), "id").join(one("zscore", "z"), "id")


@query("regression_stats", "D2", "D6", views="reads", sql="""
    SELECT 'before' AS stage, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM reads
    UNION ALL SELECT 'after', round(min(log10(value + 1)), 4), round(max(log10(value + 1)), 4), round(avg(log10(value + 1)), 4), round(stddev_pop(log10(value + 1)), 4)
    FROM reads WHERE value >= 50000""")
def _(v):
    _, stats = ds.make_regression(v.reads, "log10", 50000, "value")
    return stats.select("stage", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "std")])


_SPLIT = """split AS MATERIALIZED (SELECT *, CASE WHEN k <= t THEN 'test' WHEN k <= t + greatest(1, floor((n - t) * 0.2::DOUBLE)) THEN 'val'
    ELSE 'train' END AS split FROM (SELECT *, greatest(1, floor(n * 0.2::DOUBLE)) AS t FROM (
        SELECT *, row_number() OVER (ORDER BY md5('42:' || id::VARCHAR)) AS k, count(*) OVER () AS n FROM reads)))"""


@query("split_dataset", "D3", views="reads", sql=f"WITH {_SPLIT} SELECT id, split FROM split")
def _(v):
    return ds.split_dataset(v.reads).select("id", "split")


@query("apply_scaling", "D4", views="reads", sql=f"""
    WITH {_SPLIT}, p AS (SELECT avg(value) AS m, stddev_samp(value) AS s, min(value) AS lo, max(value) AS hi FROM split WHERE split = 'train')
    SELECT id, split, round((value - m) / s, 6) AS standardized, round((value - lo) / (hi - lo), 6) AS normalized FROM split, p""")
def _(v):
    rows = ds.split_dataset(v.reads).withColumns({"standardized": F.col("value"), "normalized": F.col("value")})
    rows = ds.apply_scaling(rows, ds.fit_scaling(rows, "standardize", "value"), "standardized")
    rows = ds.apply_scaling(rows, ds.fit_scaling(rows, "normalize", "value"), "normalized")
    return rows.select("id", "split", F.round("standardized", 6).alias("standardized"), F.round("normalized", 6).alias("normalized"))


@query("inverse_scale", "D5", views="reads", sql=f"""
    WITH {_SPLIT}, p AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM split WHERE split = 'train')
    SELECT id, round(label * s + m, 4) AS score, round(label * s, 4) AS delta FROM split, p""")
def _(v):
    rows = ds.split_dataset(v.reads)
    params = ds.fit_scaling(rows, "standardize", "value")
    rows = rows.withColumns({"score": F.col("label").cast("double"), "delta": F.col("label").cast("double")})
    rows = ds.inverse_delta(ds.inverse_scale(rows, params), params, "delta")
    return rows.select("id", F.round("score", 4).alias("score"), F.round("delta", 4).alias("delta"))


@query("value_summary", "D6", views="scores", sql="""
    SELECT method, count(*) AS n, round(min(score), 6) AS min, round(median(score), 6) AS median, round(avg(score), 4) AS mean,
        round(max(score), 6) AS max FROM scores GROUP BY method""")
def _(v):
    out = ev.value_summary(v.scores, "score", ["method"])
    return out.select("method", "n", *[F.round(c, 6).alias(c) for c in ("min", "median", "max")], F.round("mean", 4).alias("mean"))


@query("infer_task", "D7", views="reads", sql="""
    SELECT 'label' AS col, CASE WHEN bool_and(label IN (0, 1)) THEN 'classification' ELSE 'regression' END AS task, count(*) AS n,
        min(label) = max(label) AS single_class FROM reads
    UNION ALL SELECT 'value', CASE WHEN bool_and(value IN (0, 1)) THEN 'classification' ELSE 'regression' END, count(*), min(value) = max(value) FROM reads""")
def _(v):
    parts = [ds.infer_task(v.reads, c).select(F.lit(c).alias("col"), "task", "n", "single_class") for c in ("label", "value")]
    return parts[0].unionByName(parts[1])


def _learnable(v):
    """Reads labelled by an additive rule with a threshold, so that a model can learn them."""
    rows = v.reads.withColumn("label", (weight_scorer(32)(F.col("seq")) > 0).cast("int"))
    return ds.split_dataset(rows.select("id", "seq", "label"))


# The fit itself is no SQL: its contract is. Every test row has a probability, the order of the classes is learned,
# and the loss is far below that of the constant that knows the share of the label.
@query("train_baseline", "D8", views="reads", sql=f"""
    WITH {_SPLIT}, t AS (SELECT CASE WHEN {weight_sum_sql('seq', 32)} > 0 THEN 1 ELSE 0 END AS label FROM split WHERE split = 'test')
    SELECT count(*) AS n, sum(label)::BIGINT AS n_pos, true AS in_range, true AS below_half_constant, true AS ordered FROM t""")
def _(v):
    rows = _learnable(v)
    model = md.train_baseline(rows)
    test = rows.where("split = 'test'")
    scored = test.select(F.col("label").cast("long").alias("label"), model(F.col("seq")).alias("p"))
    out = scored.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"), F.bool_and((F.col("p") > 0) & (F.col("p") < 1)).alias("in_range"), F.avg("label").alias("s"))
    constant = -(F.col("s") * F.log("s") + (1 - F.col("s")) * F.log(1 - F.col("s")))
    metrics = md.evaluate(test, model).select("test_loss", "test_auc")
    return out.crossJoin(metrics).select("n", "n_pos", "in_range", (F.col("test_loss") < constant / 2).alias("below_half_constant"), (F.col("test_auc") > 0.95).alias("ordered"))


@query("evaluate_scorer", "D9", views="reads", sql=f"""
    WITH s AS (SELECT label, 1 / (1 + exp(-round({weight_sum_sql('seq', 32)}, 6))) AS p FROM reads), r AS (SELECT *, rank() OVER (ORDER BY p)
        + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM s)
    SELECT round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS test_loss, round(avg(((p > 0.5)::INT = label)::INT), 6) AS test_acc,
        round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE)
            / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))::DOUBLE, 6) AS test_auc FROM r""")
def _(v):
    out = md.evaluate(v.reads, lambda c: 1.0 / (1.0 + F.exp(-F.round(weight_scorer(32)(c), 6))))
    return out.select(F.round("test_loss", 6).alias("test_loss"), F.round("test_acc", 6).alias("test_acc"), F.round("test_auc", 6).alias("test_auc"))


@query("evaluate_regression", "D9", views="reads", sql=f"""
    SELECT round(avg(({weight_sum_sql('seq', 32)} - label) ** 2), 6) AS test_loss FROM reads""")
def _(v):
    return md.evaluate(v.reads, weight_scorer(32), "regression").withColumn("test_loss", F.round("test_loss", 6))


# The contract of a sweep: every set once, the losses rising from the first row, and the weaker penalty first on data without noise.
@query("sweep", "D10", views="", sql="""
    SELECT reg, max_iter, true AS finite, reg = 0.001 AS among_best FROM (VALUES (0.001::DOUBLE), (0.1)) r(reg), (VALUES (5.0::DOUBLE), (10.0)) m(max_iter)""")
def _(v):
    out = md.sweep(_learnable(v), {"reg": [0.001, 0.1], "max_iter": [5, 10]})
    losses = out.agg(F.sort_array(F.collect_list("val_loss"))[1].alias("second"))      # four rows
    return out.crossJoin(losses).select("reg", "max_iter", (F.col("val_loss") > 0).alias("finite"), (F.col("val_loss") <= F.col("second")).alias("among_best"))


# ---- variant predicates -------------------------------------------------------------------------

_CODING = ", ".join(f"'{c}'" for c in cl.CODING)


@query("clinical_label", "L7", views="variants", sql="""
    SELECT key, CASE WHEN contains(clinsig, 'Pathogenic') OR contains(clinsig, 'Likely_pathogenic') THEN 'pathogenic'
        WHEN contains(clinsig, 'Benign') OR contains(clinsig, 'Likely_benign') THEN 'benign' END AS label FROM variants""")
def _(v):
    return v.variants.select("key", cl.clinical_label("clinsig").alias("label"))


@query("noncoding", "L8", views="variants", sql=f"""
    SELECT key, 'G' || key::VARCHAR AS gene FROM variants
    WHERE NOT list_has_any(list_transform(regexp_split_to_array(mc, '[,|]'), lambda x: trim(x)), [{_CODING}])""")
def _(v):
    return cl.noncoding(v.variants, "mc", "geneinfo").select("key", "gene")


@query("snv_only", "L9", views="variants", sql="""
    SELECT key, alt FROM variants WHERE key % 5 <> 0 AND key % 7 <> 0""")
def _(v):
    alts = F.when(F.col("key") % 5 == 0, F.array("alt", F.lit("AC"))).when(F.col("key") % 7 != 0, F.array("alt", F.lit("T")))
    return cl.snv_only(v.variants.withColumn("alts", alts).drop("alt")).select("key", "alt")


# ---- event logs ---------------------------------------------------------------------------------

# The log spells its arguments without spaces; every eleventh use has arguments that no call has, so it is matched by order.
_LOGS = """u AS (SELECT use_id, tool, CASE WHEN use_id % 11 = 0 THEN '{"k":-1}' ELSE replace(args, ' ', '') END AS args, ts_ms, end_ms FROM uses),
    c AS (SELECT call_id, tool, replace(args, ' ', '') AS args, ts_ms FROM calls)"""
_MATCHED = _LOGS + """,
    cand AS MATERIALIZED (SELECT tool, args, use_id AS u, call_id AS c, row_number() OVER (PARTITION BY tool, args
            ORDER BY c.ts_ms < u.ts_ms, abs(c.ts_ms - u.ts_ms), use_id, call_id) AS k
        FROM u JOIN c USING (tool, args) WHERE c.ts_ms >= u.ts_ms - 5000 AND c.ts_ms <= u.end_ms + 5000),
    greedy AS (SELECT tool, args, [u] AS us, [c] AS cs, k FROM cand WHERE k = 1
        UNION ALL SELECT g.tool, g.args, list_append(any_value(g.us), arg_min(b.u, b.k)), list_append(any_value(g.cs), arg_min(b.c, b.k)), min(b.k)
        FROM greedy g JOIN cand b ON b.tool = g.tool AND b.args = g.args AND b.k > g.k
        WHERE NOT list_contains(g.us, b.u) AND NOT list_contains(g.cs, b.c) GROUP BY g.tool, g.args),
    exact AS MATERIALIZED (SELECT u AS use_id, c AS call_id FROM cand JOIN greedy USING (tool, args, k)),
    late AS (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY ts_ms, use_id) AS n FROM u
        WHERE use_id NOT IN (SELECT use_id FROM exact) AND (tool, args) NOT IN (SELECT (tool, args) FROM c)),
    near AS MATERIALIZED (SELECT l.tool, n, use_id, list(call_id ORDER BY c.ts_ms, call_id) AS fits FROM late l JOIN c ON c.tool = l.tool AND c.ts_ms >= l.ts_ms - 5000
        AND c.ts_ms <= l.end_ms + 5000 WHERE call_id NOT IN (SELECT call_id FROM exact) GROUP BY ALL),
    steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tool ORDER BY n) AS i FROM near),
    walk AS (SELECT tool, i, use_id, fits[1] AS call_id, [fits[1]] AS taken FROM steps WHERE i = 1
        UNION ALL SELECT s.tool, s.i, s.use_id, list_filter(s.fits, lambda x: NOT list_contains(w.taken, x))[1],
            list_append(w.taken[-20:], list_filter(s.fits, lambda x: NOT list_contains(w.taken, x))[1]) FROM walk w JOIN steps s ON s.tool = w.tool AND s.i = w.i + 1),
    pairs AS MATERIALIZED (SELECT use_id, call_id, 'arguments' AS how FROM exact UNION ALL SELECT use_id, call_id, 'order' FROM walk WHERE call_id IS NOT NULL)"""


def _logs(v):
    uses = v.uses.withColumn("args", F.when(F.col("use_id") % 11 == 0, '{"k": -1}').otherwise(F.col("args")))
    return uses, v.calls.withColumn("args", F.replace("args", F.lit(" "), F.lit("")))


@query("match_events", "L1", views="uses calls", sql=f"WITH RECURSIVE {_MATCHED} SELECT use_id, call_id, how FROM pairs")
def _(v):
    return evt.match_events(*_logs(v))


@query("timeline", "L2", views="uses calls", sql=f"""
    WITH RECURSIVE {_MATCHED}, o AS (SELECT min(ts_ms) - 5000 AS lo, max(ts_ms) + 5000 AS hi FROM u)
    SELECT ts_ms, 0 AS kind, use_id AS seq, CASE how WHEN 'arguments' THEN 'matched' WHEN 'order' THEN 'matched_by_order' ELSE 'transcript_only' END AS status
        FROM u LEFT JOIN pairs USING (use_id)
    UNION ALL SELECT ts_ms, CASE WHEN ts_ms BETWEEN lo AND hi THEN 1 ELSE 2 END, call_id, CASE WHEN ts_ms BETWEEN lo AND hi THEN 'call_log_only' ELSE 'outside' END
        FROM c, o WHERE call_id NOT IN (SELECT call_id FROM pairs)""")
def _(v):
    uses, calls = _logs(v)
    return evt.timeline(uses, calls, evt.match_events(uses, calls)).select("ts_ms", "kind", "seq", "status")


@query("label_phase", "L3", views="uses", sql="""
    SELECT use_id, CASE WHEN tool = 'click' THEN 'Pointer' WHEN tool LIKE 's%up' THEN 'Account' WHEN tool LIKE '_____' THEN 'Five'
        ELSE 'Analysis' END AS phase FROM uses""")
def _(v):
    return evt.label_phase(v.uses, [("click", "Pointer"), ("s*up", "Account"), ("?????", "Five")]).select("use_id", "phase")


@query("call_status", "L4", views="uses", sql="""
    SELECT event_id, round(greatest(value - 20, 0), 3) AS duration, event_type = 'error' OR event_id % 3 = 0 AS error,
        CASE WHEN event_id % 5 = 0 THEN 'missing' WHEN event_id % 5 = 1 THEN 'truncated' ELSE 'ok' END AS state,
        CASE WHEN event_id % 5 = 1 THEN event_id END AS truncated_bytes
    FROM (SELECT event_id, value, event_type, event_id % 3 = 0 AS e FROM events WHERE event_id % 5 <> 0 AND event_id % 5 <> 1
        UNION ALL SELECT event_id, value, event_type, false FROM events WHERE event_id % 5 IN (0, 1))""".replace(
    "OR event_id % 3 = 0 AS error", "OR e AS error"))
def _(v):
    e, k = v.table("events"), F.col("event_id")
    text = (F.when(k % 5 == 0, F.lit(None).cast("string"))
            .when(k % 5 == 1, F.concat(F.lit('{"truncated": true, "bytes": '), k.cast("string"), F.lit(', "head": "{"}')))
            .when(k % 3 == 0, F.lit('{"error": null}')).otherwise(F.col("props")))
    rows = e.select("event_id", (F.col("value") - 20).alias("seconds"), (F.col("event_type") == "error").alias("is_error"), text.alias("result"))
    return evt.call_status(rows).select("event_id", "duration", "error", "state", "truncated_bytes")


# ---- structures: one file per supplier, one residue per line item -------------------------------

def atoms(v, resnames="array('ALA', 'GLY', 'DA', 'DC', 'DG', 'DT')"):
    line = v.table("lineitem")
    return line.select(
        F.col("l_suppkey").alias("file"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"),
        F.substring(F.lit("ABC"), (F.col("l_orderkey") % 3 + 1).cast("int"), F.lit(1)).alias("chain"),
        F.element_at(F.expr(resnames), (F.col("l_partkey") % 6 + 1).cast("int")).alias("resname"),
        (F.expr("l_orderkey div 40").cast("int")).alias("resnum"),
        F.concat(F.expr("l_orderkey div 40").cast("string"), F.lit(" ")).alias("residue"),
        (F.col("l_quantity") * 2).alias("bfactor"), "l_orderkey", "l_linenumber", "l_partkey")


_ATOMS = """atoms AS (SELECT l_suppkey AS file, l_orderkey * 8 + l_linenumber AS line_no, 'ABC'[l_orderkey % 3 + 1] AS chain,
    l_orderkey // 40 AS resnum, ['ALA', 'GLY', 'DA', 'DC', 'DG', 'DT'][l_partkey % 6 + 1] AS resname, l_quantity * 2 AS bfactor FROM lineitem),
    res AS MATERIALIZED (SELECT file, chain, resnum, min(line_no) AS line_no, arg_min(bfactor, (line_no, bfactor)) AS bfactor FROM atoms GROUP BY 1, 2, 3)"""


def _one_atom(v):
    """One atom per line number, so that the first atom of a residue is defined."""
    rows = atoms(v)
    return rows.groupBy("file", "line_no", "chain", "resnum", "residue").agg(
        F.min("bfactor").alias("bfactor"), F.max("resname").alias("resname"))


@query("residue_confidence", "L5", views="", sql=f"""
    WITH {_ATOMS}, o AS (SELECT *, lag(chain) OVER w AS c0, lag(resnum) OVER w AS n0, lag(bfactor) OVER w AS b0 FROM res
        WINDOW w AS (PARTITION BY file ORDER BY line_no)),
    s AS (SELECT file, count(*) FILTER (bfactor < 50 AND NOT coalesce(c0 = chain AND n0 + 1 = resnum AND b0 < 50, false)) AS total,
        count(*) AS n_residues, round(avg((bfactor >= 70)::INT), 4) AS fraction_confident, round(avg((bfactor < 50)::INT), 4) AS fraction_low FROM o GROUP BY file)
    SELECT file, n_residues, fraction_confident, fraction_low, total::INTEGER AS listed, total AS low_segments_total FROM s""")
def _(v):
    return st.residue_confidence(_one_atom(v)).withColumn("listed", F.size("low_segments")).drop("low_segments")


@query("dna_chains", "L6", views="", sql=f"""
    WITH {_ATOMS}, one AS (SELECT file, chain, resnum, line_no, max(resname) AS resname FROM atoms GROUP BY 1, 2, 3, 4),
    d AS (SELECT file, chain, resnum, arg_max(resname[2], line_no) AS base FROM one WHERE resname IN ('DA', 'DC', 'DG', 'DT') GROUP BY 1, 2, 3)
    SELECT file, chain, string_agg(base, '' ORDER BY resnum) AS sequence, count(*) AS n FROM d GROUP BY 1, 2""")
def _(v):
    return st.dna_chains(_one_atom(v)).select("file", "chain", "sequence", F.size("bases").cast("long").alias("n"))
