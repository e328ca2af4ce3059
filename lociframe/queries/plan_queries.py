"""The end-to-end analyses over the driver's tables."""

from pyspark.sql import functions as F

from lociframe.plans import loci, validation
from lociframe.queries.evaluation_queries import auc_sql
from lociframe.queries.motif_queries import genome_hits_sql, hits_sql, matrices, motif_table, null_sql, pwm_sql, spaced_sql
from lociframe.queries.registry import query
from lociframe.queries.sequence_queries import gc_negatives_sql, region_negatives_sql
from lociframe.queries.views import BIN, extraction_sql, has_only_acgt_sql, weight_scorer, weight_sum_sql
from lociframe.operators.motifs import null_distribution, log_odds, score_counts
from lociframe.operators.clinical import CODING

_CODING = ", ".join(f"'{c}'" for c in CODING)


def _rounded(width):
    """The additive scorer to nine digits."""
    return weight_scorer(width, digits=9)


def _score_sql(col, width):
    return f"round({weight_sum_sql(col, width)}, 9)"


@query("extract_loci", "P1", "I12", views="intervals chroms", sql=f"""
    WITH cut AS MATERIALIZED (SELECT id, chrom, ws, score, num, {extraction_sql('chroms', 'ws', '200')} AS s FROM (
        SELECT *, start + ("end" - start) // 2 - 100 AS ws FROM intervals) JOIN chroms USING (chrom))
    SELECT id, ws, ws + 200 AS we, md5(s) AS seq FROM cut WHERE s IS NOT NULL AND num <> 7 AND {has_only_acgt_sql('s')}""")
def _(v):
    peaks = v.intervals.withColumn("score", F.when(F.col("num") != 7, F.col("score")))
    out = loci.extract_loci(peaks, v.packed, v.contigs, BIN, 200)
    return out["windows"].select("id", "ws", "we", F.md5("seq").alias("seq"))


@query("extract_loci_negatives", "P1", "N1", "N2", views="intervals chroms contigs", sql=f"""
    WITH {gc_negatives_sql(200)}, w AS (SELECT least(floor(gc / 0.05::DOUBLE + 1e-9), 19)::BIGINT AS gc_bin, count(*) AS wanted, round(avg(gc), 9) AS positive_gc
        FROM (SELECT length(regexp_replace(seq, '[^GC]', '', 'g')) / 200.0::DOUBLE AS gc FROM pos_rows) GROUP BY 1),
    f AS (SELECT gc_bin, count(*) AS found, round(avg(gc), 9) AS negative_gc FROM picked GROUP BY 1)
    SELECT gc_bin, wanted, coalesce(found, 0) AS found, greatest(wanted - coalesce(found, 0), 0) AS missing, positive_gc, negative_gc FROM w LEFT JOIN f USING (gc_bin)""")
def _(v):
    report = loci.extract_loci(v.intervals, v.packed, v.contigs, BIN, 200, negatives="gc")["gc_report"]
    return report.withColumns({c: F.round(c, 9) for c in ("positive_gc", "negative_gc")})


# The negatives are shuffles, which no SQL can repeat: it gives the scores of the positives and the number of negatives.
@query("peak_set_validation", "P2", views="intervals chroms", sql=f"""
    WITH positive AS MATERIALIZED (SELECT id, substr(bases, (start + 1)::BIGINT, "end" - start) AS seq FROM intervals JOIN chroms USING (chrom) WHERE num >= 4),
    {hits_sql('positive', 5.0)}, w AS (SELECT id, substr(seq, i + 1, 24) AS win FROM (SELECT *, unnest(range(length(seq) - 23)) AS i FROM positive)),
    s AS (SELECT 'p' || id AS rid, 'weights' AS method, max({_score_sql('win', 24)}) AS score FROM w WHERE {has_only_acgt_sql('win')} GROUP BY id
        UNION ALL SELECT 'p' || p.id, 'alpha', coalesce(max(score), 0) FROM positive p LEFT JOIN hits h ON p.id = h.id AND motif = 'alpha' GROUP BY p.id)
    SELECT rid, method, round(score, 6) AS score FROM s UNION ALL SELECT 'negatives', method, count(*)::DOUBLE FROM s GROUP BY method""")
def _(v):
    peaks = v.intervals.withColumn("score", F.col("num").cast("double"))
    out = validation.peak_set_validation(
        peaks, v.packed, v.contigs, BIN, {"weights": _rounded(24)}, {"alpha": matrices(v)["alpha"]}, hit_threshold=5.0)
    scores = out["scores"].where("score is not null")
    negatives = scores.where("label = 0").groupBy("method").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return (scores.where("label = 1").select("rid", "method", F.round("score", 6).alias("score"))
            .unionByName(negatives.select(F.lit("negatives").alias("rid"), "method", "score")))


@query("peak_set_genomic", "P2", "N3", views="intervals chroms contigs genome", sql=f"""
    WITH peak AS (SELECT id, chrom, start, "end", num FROM intervals WHERE num >= 4), {region_negatives_sql('peak', 'intervals', 42)},
    s AS (SELECT 'p' || id AS id, 1 AS label, seq FROM positive WHERE seq <> '' UNION ALL SELECT 'n' || id, 0, seq FROM region),
    w AS (SELECT id, label, substr(seq, i + 1, 24) AS win FROM (SELECT *, unnest(range(length(seq) - 23)) AS i FROM s)),
    b AS (SELECT id, label, max({_score_sql('win', 24)}) AS score FROM w WHERE {has_only_acgt_sql('win')} GROUP BY id, label),
    m AS (SELECT *, 'weights' AS method, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id)) AS k,
        least(count(*) FILTER (label = 1) OVER (), count(*) FILTER (label = 0) OVER ()) AS least_n FROM b),
    k AS (SELECT method, label, score FROM m WHERE k <= least_n),
    aucs AS ({auc_sql('k', 'method', extra=', count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg')}) SELECT method, roc_auc AS auc, n_pos, n_neg FROM aucs""")
def _(v):
    peaks = v.intervals.withColumn("score", F.col("num").cast("double"))
    out = validation.peak_set_validation(peaks, v.packed, v.contigs, BIN, {"weights": _rounded(24)}, {}, mode="genomic", margin=0)
    return out["summary"].withColumn("auc", F.round("auc", 6))


_MERGED_TF = """m0 AS (SELECT *, max("end") OVER (PARTITION BY tf, chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
        FROM intervals),
    m1 AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY tf, chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM m0),
    m2 AS (SELECT tf, chrom, min(start) AS start, max("end") AS "end", max(num) AS num FROM m1 GROUP BY tf, chrom, g),
    m3 AS (SELECT *, tf || ':' || chrom || ':' || start::VARCHAR AS id, start + ("end" - start) // 2 - 12 AS ws FROM m2),
    wins AS MATERIALIZED (SELECT tf, id, num, s FROM (SELECT m3.*, {cut} AS s, length(bases) AS n FROM m3 JOIN chroms USING (chrom))
        WHERE s IS NOT NULL AND ws + 24 {op} n AND {ok})"""


def _merged_tf(op):
    return _MERGED_TF.format(cut=extraction_sql("chroms", "ws", "24"), op=op, ok=has_only_acgt_sql("s"))


@query("method_comparison", "P3", views="intervals chroms", sql=f"""
    WITH {_merged_tf('<=')}, sets AS (SELECT id, t.neg_set, CASE WHEN tf = 'R' THEN 1 ELSE 0 END AS label, {_score_sql('s', 24)} AS score
        FROM wins, (VALUES ('A'), ('N')) t(neg_set) WHERE tf = 'R' OR tf = neg_set),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY neg_set, label ORDER BY md5('42:' || id)) AS k,
        least(count(*) FILTER (label = 1) OVER (PARTITION BY neg_set), count(*) FILTER (label = 0) OVER (PARTITION BY neg_set)) AS m FROM sets) WHERE k <= m),
    aucs AS ({auc_sql('b', 'neg_set', extra=', count(*) FILTER (label = 1) AS n_pos')})
    SELECT 'weights' AS method, neg_set, roc_auc AS auc, n_pos FROM aucs""")
def _(v):
    out = validation.method_comparison(v.intervals, v.packed, v.contigs, BIN, {"weights": _rounded(24)}, "R", ["A", "N"])
    return out["summary"].select("method", "neg_set", F.round("auc", 6).alias("auc"), "n_pos")


@query("count_benchmark", "P4", views="intervals chroms", sql=f"""
    WITH {_merged_tf('<')}, c AS (SELECT cutoff::INTEGER AS cutoff, CASE WHEN num >= cutoff THEN 1 ELSE 0 END AS label, {_score_sql('s', 24)} AS score
        FROM wins, (VALUES (1), (3), (5), (8)) t(cutoff) WHERE tf = 'R'),
    k AS (SELECT * FROM (SELECT *, min(label) OVER (PARTITION BY cutoff) <> max(label) OVER (PARTITION BY cutoff) AS ok FROM c) WHERE ok),
    aucs AS ({auc_sql('k', 'cutoff', extra=', count(*) FILTER (label = 1) AS n_pos')}) SELECT 'weights' AS method, * FROM aucs""")
def _(v):
    out = validation.count_benchmark(v.intervals, v.packed, v.contigs, BIN, {"weights": _rounded(24)}, "R", ["A", "N"])
    return out["cutoffs"].select("method", "cutoff", F.round("roc_auc", 6).alias("roc_auc"), "n_pos")


@query("count_benchmark_regression", "P4", views="intervals chroms", sql=f"""
    WITH {_merged_tf('<')}, s AS (SELECT num, {_score_sql('s', 24)} AS score FROM wins WHERE tf = 'R'), r AS (SELECT *,
        rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rx,
        rank() OVER (ORDER BY num) + (count(*) OVER (PARTITION BY num) - 1) / 2.0::DOUBLE AS ry FROM s)
    SELECT 'weights' AS method, round(corr(score, num), 6) AS pearson_r, round(corr(rx, ry), 6) AS spearman_rho, count(*) AS n FROM r""")
def _(v):
    out = validation.count_benchmark(v.intervals, v.packed, v.contigs, BIN, {"weights": _rounded(24)}, "R", ["A", "N"])
    return out["regression"].select("method", F.round("pearson_r", 6).alias("pearson_r"), F.round("spearman_rho", 6).alias("spearman_rho"), "n")


def records(v):
    return v.variants.select("key", F.regexp_replace("chrom", "^chr", "").alias("chrom"), "pos", "ref", F.array("alt").alias("alts"),
                             "clinsig", "mc", "geneinfo", F.concat(F.lit("rs"), F.col("key").cast("string")).alias("rsid"))


_HITS = f"""l AS (SELECT v.*, clinsig = 'Pathogenic' AS path FROM variants v WHERE clinsig <> 'Uncertain_significance'
        AND NOT list_has_any(regexp_split_to_array(mc, '[,|]'), [{_CODING}])),
    h AS MATERIALIZED (SELECT l.* FROM l JOIN merged m ON l.chrom = m.chrom AND pos - 1 >= m.start AND pos - 1 < m."end" WHERE m.num >= 3)"""


def _variant_sql(width, middle):
    """The windows of the variants in peaks, ref and alt, with the variant at index middle."""
    return f"""(SELECT key, path, s, s[:{middle}] || alt || s[{middle + 2}:] AS a FROM (
        SELECT key, path, ref, alt, {extraction_sql('chroms', f'(pos - {middle + 1})', str(width))} AS s FROM h JOIN chroms USING (chrom))
        WHERE s IS NOT NULL AND s[{middle + 1}] = ref AND ref <> 'N' AND {has_only_acgt_sql('s')})"""


def _best_hit_sql(col):
    """The best placement of motif alpha on either strand of a window of eleven bases."""
    words = [pwm_sql("alpha", f"substr({col}, {i}, 6)", strand) for i in range(1, 7) for strand in (False, True)]
    return f"greatest({', '.join(words)})"


_SUMMARY = f"""a AS (SELECT *, abs(d) AS score FROM e),
    raw AS ({auc_sql('e', 'method', 'd').replace('ranked', 'ranked2')}),
    ab AS ({auc_sql('a', 'method')})
    SELECT method, ab.roc_auc AS auc_abs, raw.roc_auc AS auc_raw, round(median(score) FILTER (label = 1), 6) AS median_abs_path,
        round(median(score) FILTER (label = 0), 6) AS median_abs_benign, count(*) FILTER (label = 1) AS n_path, count(*) FILTER (label = 0) AS n_benign
    FROM a JOIN ab USING (method) JOIN raw USING (method) GROUP BY ALL"""


def _validated(v, motifs=None):
    """The summary of effects to nine digits."""
    out = validation.variant_validation(v.intervals, records(v), v.packed, v.contigs, BIN, {"weights": _rounded(24)}, motifs, min_confidence=3, digits=9)
    return out["summary"].select("method", *[F.round(c, 6).alias(c) for c in (
        "auc_abs", "auc_raw", "median_abs_path", "median_abs_benign")], "n_path", "n_benign")


@query("variant_validation", "P5", views="merged variants chroms", sql=f"""
    WITH {_HITS}, e AS (SELECT 'weights' AS method, path::INTEGER AS label, round({_score_sql('s', 24)} - {_score_sql('a', 24)}, 9) AS d FROM {_variant_sql(24, 12)}), {_SUMMARY}""")
def _(v):
    """Peaks merged and filtered, single-base non-coding variants joined, labelled, scored and evaluated."""
    return _validated(v)


@query("variant_validation_motif", "P5", "M6", "M10", views="merged variants chroms", sql=f"""
    WITH {_HITS}, e AS (SELECT 'weights' AS method, path::INTEGER AS label, round({_score_sql('s', 24)} - {_score_sql('a', 24)}, 9) AS d FROM {_variant_sql(24, 12)}
        UNION ALL SELECT 'alpha', path::INTEGER, round({_best_hit_sql('s')} - {_best_hit_sql('a')}, 9) FROM {_variant_sql(11, 5)}), {_SUMMARY}""")
def _(v):
    return _validated(v, {"alpha": matrices(v)["alpha"]})


@query("variant_validation_rows", "P5", "M10", views="merged variants chroms", sql=f"""
    WITH {_HITS}, w AS (SELECT key, {_score_sql('s', 24)} AS r, {_score_sql('a', 24)} AS t FROM {_variant_sql(24, 12)}),
    m AS (SELECT key, {_best_hit_sql('s')} AS r, {_best_hit_sql('a')} AS t FROM {_variant_sql(11, 5)})
    SELECT 'rs' || h.key::VARCHAR AS rsid, h.chrom, h.pos, CASE WHEN h.path THEN 'pathogenic' ELSE 'benign' END AS label,
        round(w.r, 6) + 0.0 AS weights_ref, round(w.t, 6) + 0.0 AS weights_alt, round(w.r - w.t, 6) + 0.0 AS weights_dd,
        round(m.r, 6) + 0.0 AS alpha_ref, round(m.t, 6) + 0.0 AS alpha_alt, round(m.r - m.t, 6) + 0.0 AS alpha_dd
    FROM h LEFT JOIN w USING (key) LEFT JOIN m USING (key)""")
def _(v):
    """The variants with the effects of every method, NULL where no window could be cut."""
    out = validation.variant_validation(v.intervals, records(v), v.packed, v.contigs, BIN, {"weights": _rounded(24)}, {"alpha": matrices(v)["alpha"]}, min_confidence=3)
    names = [f"{m}_{e}" for m in ("weights", "alpha") for e in ("ref", "alt", "dd")]
    return out["variants"].select("rsid", "chrom", "pos", "label", *[(F.round(n, 6) + 0.0).alias(n) for n in names])


@query("best_windows", "P6", views="intervals halo chroms", sql=f"""
    WITH p AS (SELECT id, chrom, start, "end", start + ("end" - start) // 2 - 40 AS ws FROM intervals),
    c AS MATERIALIZED (SELECT p.*, {extraction_sql('chroms', 'ws', '80')} AS seq FROM p JOIN chroms USING (chrom) WHERE ws + 80 < length(bases)),
    w AS (SELECT id, chrom, start, "end", i, substr(seq, i + 1, 24) AS win FROM (SELECT *, unnest(range(57)) AS i FROM c WHERE seq IS NOT NULL)),
    s AS (SELECT *, {_score_sql('win', 24)} AS x FROM w WHERE {has_only_acgt_sql('win')}),
    b AS (SELECT id, chrom, start, "end", arg_min(i, (-x, i)) AS i, arg_min(win, (-x, i)) AS sequence, round(max(x), 6) AS max_score, round(avg(x), 6) AS mean_score
        FROM s GROUP BY ALL)
    SELECT id, chrom || ':' || ((start + "end") // 2 - 40 + i)::VARCHAR || '-' || ((start + "end") // 2 - 16 + i)::VARCHAR AS best_peak,
        sequence, max_score, mean_score FROM b""")
def _(v):
    out = loci.best_windows(v.intervals.select("id", "chrom", "start", "end"), v.packed, v.contigs, BIN, _rounded(24), 80, 24)
    return out["windows"].where("sequence is not null").select(
        "id", "best_peak", "sequence", F.round("max_score", 6).alias("max_score"), F.round("mean_score", 6).alias("mean_score"))


@query("best_window_logo", "P6", "M22", views="intervals chroms", sql=f"""
    WITH p AS (SELECT id, chrom, start + ("end" - start) // 2 - 40 AS ws FROM intervals),
    c AS MATERIALIZED (SELECT p.*, {extraction_sql('chroms', 'ws', '80')} AS seq FROM p JOIN chroms USING (chrom) WHERE ws + 80 < length(bases)),
    w AS (SELECT id, i, substr(seq, i + 1, 24) AS win FROM (SELECT *, unnest(range(57)) AS i FROM c WHERE seq IS NOT NULL)),
    b AS (SELECT id, arg_min(win, (-x, i)) AS s FROM (SELECT *, {_score_sql('win', 24)} AS x FROM w WHERE {has_only_acgt_sql('win')}) GROUP BY id),
    n AS (SELECT pos, base, count(*) FILTER (substr(s, pos + 1, 1) = base) + 1.0 AS n FROM b, range(24) t(pos), (VALUES ('A'), ('C'), ('G'), ('T')) l(base) GROUP BY ALL),
    q AS (SELECT *, n / sum(n) OVER (PARTITION BY pos) AS prob FROM n)
    SELECT pos, base, round(prob, 6) AS prob, round(sum(prob * (log2(prob) + 2)) OVER (PARTITION BY pos), 6) AS bits,
        round(prob * sum(prob * (log2(prob) + 2)) OVER (PARTITION BY pos), 6) AS height FROM q""")
def _(v):
    out = loci.best_windows(v.intervals.select("id", "chrom", "start", "end"), v.packed, v.contigs, BIN, _rounded(24), 80, 24)
    return out["logo"].select("pos", "base", *[F.round(c, 6).alias(c) for c in ("prob", "bits", "height")])


@query("binding_track", "P7", "K5", views="halo", sql=f"""
    WITH w AS (SELECT chrom, off + i AS pos, substr(s, i + 1, 11) AS s FROM (SELECT chrom, off, s, unnest(range(length(s) - 10)) AS i FROM (
        SELECT chrom, bin * {BIN} + c * 256 AS off, substr(bases, (c * 256 + 1)::BIGINT, 266) AS s FROM halo, range({BIN // 256}) t(c)))),
    e AS (SELECT chrom, pos, CASE WHEN {has_only_acgt_sql('s')} THEN {_score_sql('s', 11)} END AS energy FROM w),
    m AS (SELECT chrom, pos, min(energy) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING) AS value,
        max(pos) OVER (PARTITION BY chrom) + 11 AS n FROM e)
    SELECT chrom, pos + 10 AS start, pos + 40 AS "end", round(value, 6) AS value FROM m WHERE pos % 30 = 0 AND pos + 50 <= n AND value IS NOT NULL""")
def _(v):
    track = loci.binding_track(v.packed, v.contigs, BIN, _rounded(11), 11, 50, 30)
    return track.withColumn("value", F.round("value", 6))


@query("motif_peaks", "P8", views="halo contigs", sql=f"""
    WITH RECURSIVE {genome_hits_sql('beta')}, {spaced_sql(4, 200)}
    SELECT chrom, pos + 3 - 100 AS start, pos + 3 + 100 AS "end", 'beta_hit_' || pos::VARCHAR AS name, round(score, 2) AS score, strand FROM chosen""")
def _(v):
    return loci.motif_peaks(v.packed, v.contigs, BIN, matrices(v), "beta")


@query("null_distribution", "M4", views="texts", sql=f"""
    WITH {hits_sql('texts')}, {null_sql()}, n AS (SELECT motif, iscore, count(*) AS n FROM hits GROUP BY ALL)
    SELECT n.motif, iscore, n.n, round(p, 9) AS p_value FROM n JOIN null_table t ON n.motif = t.motif AND n.iscore = t.s""")
def _(v):
    """P-values of the scores that the hits of all documents reach."""
    hits = score_counts(v.texts, matrices(v))
    return hits.join(null_distribution(log_odds(motif_table(v))), ["motif", "iscore"]).select(
        "motif", "iscore", "n", F.round("p_value", 9).alias("p_value"))
