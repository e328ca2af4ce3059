"""Motifs, scorers, effects and attributions over the driver's tables."""

import math

import numpy as np
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.operators import attribution as at
from lociframe.operators import effects as ef
from lociframe.operators import motifs as mo
from lociframe.operators.genome import contig_lengths, extract_regions, variant_windows, with_halo
from lociframe.operators.scorers import ExpressionScorer, FunctionScorer, WeightScorer, score, score_distinct
from lociframe.operators.tracks import best_spaced, window_minima
from lociframe.queries.registry import query
from lociframe.queries.views import BIN, MOTIFS, extraction_sql, has_only_acgt_sql, pair_scorer, pwm_scorer, weight, weight_scorer, weight_sum_sql

WIDTH = 6


def motif_table(v):
    """The two motifs of the views, as a table."""
    rows = [(n, p, b, float(x)) for n, m in MOTIFS.items() for p, row in enumerate(m) for b, x in zip("ACGT", row)]
    return v.spark.createDataFrame(rows, "motif string, pos long, base string, prob double")


def matrices(v):
    return mo.load_matrices(mo.log_odds(motif_table(v)))


def _lo(p):
    return math.log2((p + 0.01) / 0.26)


def pwm_sql(name, col, reverse=False, whole=False):
    """Log-odds of a window as one SQL expression, on its reverse complement when reverse."""
    terms = []
    for k, row in enumerate(MOTIFS[name]):
        at_ = WIDTH - k if reverse else k + 1
        values = [(round(_lo(p) * 100) if whole else repr(_lo(p))) for p in row]
        a, c, g, t = values[::-1] if reverse else values
        terms.append(f"CASE substr({col}, {at_}, 1) WHEN 'A' THEN {a} WHEN 'C' THEN {c} WHEN 'G' THEN {g} ELSE {t} END")
    kind = "BIGINT" if whole else "DOUBLE"
    return "(" + " + ".join(f"({t})::{kind}" for t in terms) + ")"


def windows_sql(table, width=WIDTH, name="wins"):
    """Windows cut from chunks of 256 bases, because substr walks a text from its start."""
    return (f"chunks AS MATERIALIZED (SELECT id, c * 256 AS off, substr(seq, (c * 256 + 1)::BIGINT, {255 + width}) AS s FROM "
            f"(SELECT id, seq, unnest(range(length(seq) // 256 + 1)) AS c FROM {table})), "
            f"{name} AS MATERIALIZED (SELECT * FROM (SELECT id, off + i AS win_start, substr(s, i + 1, {width}) AS win FROM "
            f"(SELECT id, off, s, unnest(range(length(s) - {width - 1})) AS i FROM chunks)) WHERE {has_only_acgt_sql('win')})")


def hits_sql(table, threshold=None):
    parts = []
    for name in MOTIFS:
        for strand in "+-":
            rev = strand == "-"
            text = "reverse(translate(win, 'ACGT', 'TGCA'))" if rev else "win"
            parts.append(f"SELECT id, '{name}' AS motif, win_start + 1 AS start, win_start + {WIDTH} AS stop, '{strand}' AS strand, "
                         f"{pwm_sql(name, 'win', rev)} AS score, {pwm_sql(name, 'win', rev, True)} AS iscore, {text} AS matched FROM wins")
    where = f" WHERE score >= {threshold}" if threshold is not None else ""
    return f"{windows_sql(table)}, hits AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(parts)}){where})"


# ---- motifs -------------------------------------------------------------------------------------

@query("scan_motifs", "M1", "M2", views="texts", sql=f"""
    WITH {hits_sql('texts', 7.0)} SELECT id, motif, start, stop, strand, round(score, 6) AS score, matched FROM hits""")
def _(v):
    hits = mo.scan_motifs(v.texts, matrices(v), threshold=7.0)
    return hits.select("id", "motif", "start", "stop", "strand", F.round("score", 6).alias("score"), "matched")


@query("best_strand", "M3", views="seqs", sql=f"""
    WITH {hits_sql('seqs')} SELECT id, motif, start, round(max(score), 6) AS score,
        CASE WHEN max(score) FILTER (strand = '+') >= max(score) THEN '+' ELSE '-' END AS strand
    FROM hits GROUP BY id, motif, start""")
def _(v):
    hits = mo.best_strand(mo.scan_motifs(v.seqs, matrices(v), matched=False))
    return hits.select("id", "motif", "start", F.round("score", 6).alias("score"), "strand")


_NULL = ", ".join(f"w{k}" for k in range(WIDTH))


def _null_sql(name):
    cols = [f"(VALUES {', '.join(f'({round(_lo(p) * 100)})' for p in row)}) w{k}(s{k})" for k, row in enumerate(MOTIFS[name])]
    total = " + ".join(f"s{k}" for k in range(WIDTH))
    return f"SELECT '{name}' AS motif, {total} AS s FROM {', '.join(cols)}"


def null_sql():
    """null_table (motif, s, p): the share of all words that score at least s."""
    return f"""words AS ({' UNION ALL '.join(_null_sql(n) for n in MOTIFS)}),
    null_counts AS (SELECT motif, s, count(*) AS n FROM words GROUP BY motif, s),
    null_table AS (SELECT motif, s, sum(n) OVER (PARTITION BY motif ORDER BY s DESC) / 4096.0::DOUBLE AS p FROM null_counts)"""


@query("hit_pvalues", "M4", views="texts", sql=f"""
    WITH {hits_sql('texts')}, {null_sql()}
    SELECT id, h.motif, start, strand, round(score, 6) AS score, round(p, 9) AS p_value
    FROM hits h JOIN null_table n ON h.motif = n.motif AND h.iscore = n.s WHERE p <= 0.001""")
def _(v):
    table = mo.log_odds(motif_table(v))
    hits = mo.scan_motifs(v.texts, matrices(v), matched=False, floors=mo.pvalue_floors(table, 1e-3))
    hits = mo.hit_pvalues(hits, table, 1e-3)
    return hits.select("id", "motif", "start", "strand", F.round("score", 6).alias("score"), F.round("p_value", 9).alias("p_value"))


@query("score_per_sequence", "M5", views="texts", sql=f"""
    WITH {hits_sql('texts', 7.5)} SELECT t.id, m.name AS motif, round(coalesce(max(score), 0), 6) AS best, round(coalesce(avg(score), 0), 6) AS mean
    FROM texts t CROSS JOIN (VALUES {', '.join(f"('{n}')" for n in MOTIFS)}) m(name) LEFT JOIN hits h ON t.id = h.id AND motif = m.name GROUP BY t.id, m.name""")
def _(v):
    parts = []
    for name, matrix in matrices(v).items():
        hits = mo.scan_motifs(v.texts, {name: matrix}, threshold=7.5, matched=False)
        best = mo.score_per_sequence(hits, v.texts).withColumnRenamed("score", "best")
        mean = mo.score_per_sequence(hits, v.texts, how="mean").withColumnRenamed("score", "mean")
        parts.append(best.join(mean, "id").select("id", F.lit(name).alias("motif"), F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean")))
    return reduce(DataFrame.unionByName, parts)


@query("score_at", "M6", views="reads", sql=f"""
    WITH {hits_sql('reads', 0.0)} SELECT r.id, m.name AS motif, round(coalesce(max(score), 0), 6) AS score
    FROM reads r CROSS JOIN (VALUES {', '.join(f"('{n}')" for n in MOTIFS)}) m(name)
    LEFT JOIN hits h ON r.id = h.id AND motif = m.name AND start <= 17 AND stop >= 17 GROUP BY r.id, m.name""")
def _(v):
    return reduce(DataFrame.unionByName, [
        mo.score_at(mo.scan_motifs(v.reads, {name: matrix}, threshold=0.0, matched=False), 17, v.reads)
        .select("id", F.lit(name).alias("motif"), F.round("score", 6).alias("score")) for name, matrix in matrices(v).items()])


@query("score_sequences", "M7", views="reads", sql=f"""
    WITH {windows_sql('reads')} SELECT id, any_value(w) AS weights, round(any_value(gc), 6) AS gc, any_value(cg) AS cg,
        round(greatest(max({pwm_sql('alpha', 'win')}), max({pwm_sql('alpha', 'win', True)})), 6) AS motif
    FROM wins JOIN (SELECT id, round({weight_sum_sql('seq', 32)}, 6) AS w,
        length(regexp_replace(seq, '[^GC]', '', 'g')) / 32.0::DOUBLE AS gc,
        (length(seq) - length(replace(seq, 'CG', '')))::DOUBLE / 2 AS cg FROM reads) USING (id) GROUP BY id""")
def _(v):
    gc = ExpressionScorer(lambda s: F.length(F.regexp_replace(s, "[^GC]", "")) / F.length(s))
    cg = FunctionScorer(lambda seqs: np.array([s.count("CG") for s in seqs], dtype=float))
    df = score(v.reads, weight_scorer(32), out="weights")
    df = score(score(df, gc, out="gc"), cg, out="cg")
    df = score_distinct(df, pwm_scorer("alpha"), out="motif")
    return df.select("id", *[F.round(c, 6).alias(c) for c in ("weights", "gc", "cg", "motif")])


@query("best_window", "M8", views="texts", sql=f"""
    WITH {windows_sql('texts', 24)}, s AS (SELECT id, win_start, win, round({weight_sum_sql('win', 24)}, 9) AS score FROM wins),
    b AS (SELECT id, arg_min(win_start, (-score, win_start)) AS best_idx, arg_min(win, (-score, win_start)) AS best_seq, round(max(score), 6) AS max_score,
        round(sum(score), 4) + 0.0 AS total, count(*) AS n_windows FROM s GROUP BY id)
    SELECT t.id, best_idx, best_seq, max_score, total, n_windows FROM texts t LEFT JOIN b USING (id)""")
def _(v):
    out = mo.best_window(v.texts, weight_scorer(24, digits=9), 24)
    return out.select("id", "best_idx", "best_seq", F.round("max_score", 6).alias("max_score"),
                      (F.round(F.col("mean_score") * F.col("n_windows"), 4) + 0.0).alias("total"), "n_windows")


@query("best_window_any_scorer", "M8", views="texts", sql=f"""
    WITH {windows_sql('texts', 20)}, s AS (SELECT id, win_start, length(regexp_replace(win, '[^GC]', '', 'g')) / 20.0::DOUBLE AS score FROM wins)
    SELECT id, arg_min(win_start, (-score, win_start)) AS best_idx, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score FROM s GROUP BY id""")
def _(v):
    """A Spark expression as the scorer: windows stream out of the texts."""
    from lociframe.functions.dna import gc_content
    out = mo.best_window(v.texts, ExpressionScorer(gc_content), 20).where("best_idx is not null")
    return out.select("id", "best_idx", F.round("max_score", 6).alias("max_score"), F.round("mean_score", 6).alias("mean_score"))


@query("variant_effect", "M10", views="variants chroms", sql=f"""
    WITH w AS (SELECT key, {extraction_sql('chroms', '(pos - 17)', '32')} AS s, ref, alt FROM variants JOIN chroms USING (chrom)),
    ok AS (SELECT key, s, s[:16] || alt || s[18:] AS a FROM w WHERE s IS NOT NULL AND s[17] = ref AND {has_only_acgt_sql('s')} AND ref <> 'N')
    SELECT key, round({weight_sum_sql('s', 32)}, 6) AS model_ref, round({weight_sum_sql('a', 32)}, 6) AS model_alt,
        round({weight_sum_sql('s', 32)} - {weight_sum_sql('a', 32)}, 6) AS model_dd,
        round({weight_sum_sql('a', 32)} - {weight_sum_sql('s', 32)}, 6) AS energy_dd FROM ok""")
def _(v):
    windows = variant_windows(v.variants, v.packed, v.contigs, 32, BIN, row_key=F.col("key")).where("status = 'ok'")
    model = weight_scorer(32)
    out = ef.variant_effect(windows, {"model": model, "energy": model}, kind={"energy": "energy"})
    return out.select("key", *[F.round(c, 6).alias(c) for c in ("model_ref", "model_alt", "model_dd", "energy_dd")])


@query("mutagenesis", "M11", views="seqs weights", sql="""
    WITH m AS (SELECT pos, base, weight - avg(weight) OVER (PARTITION BY pos) AS value FROM weights WHERE pos < 32)
    SELECT id, pos, base, round(value, 6) + 0.0 AS value FROM seqs, m""")
def _(v):
    return ef.mutagenesis(v.seqs, weight_scorer(32)).withColumn("value", F.round("value", 6) + 0.0)


@query("mutagenesis_raw", "M11", views="seqs weights", sql=f"""
    SELECT id, pos, base, round(y, 6) AS original, round(y + weight - o, 6) AS mutant FROM (
        SELECT s.id, w.pos, w.base, w.weight, r.weight AS o, {weight_sum_sql('s.seq', 32)} AS y
        FROM seqs s, weights w JOIN weights r USING (pos) WHERE pos BETWEEN 8 AND 15 AND r.base = substr(s.seq, pos + 1, 1))""")
def _(v):
    out = ef.mutagenesis(v.seqs, weight_scorer(32), start=8, end=16, raw=True)
    return out.withColumns({c: F.round(c, 6) for c in ("original", "mutant")})


@query("marginalize", "M12", views="reads", sql=f"""
    SELECT id, round({weight_sum_sql('seq', 32)}, 6) AS before, round({weight_sum_sql("(seq[:12] || 'CAAGTGC' || seq[20:])", 32)}, 6) AS after
    FROM reads""")
def _(v):
    out = ef.marginalize(v.reads, "CAAGTGC", weight_scorer(32))
    return out.select("id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query("mean_delta", "M12", views="reads", sql=f"""
    SELECT round(avg({weight_sum_sql("(seq[:3] || 'CAAGTGC' || seq[11:])", 32)} - {weight_sum_sql('seq', 32)}), 6) AS mean_delta,
        count(*) AS n FROM reads""")
def _(v):
    out = ef.mean_delta(ef.marginalize(v.reads, "CAAGTGC", weight_scorer(32), start=3))
    return out.withColumn("mean_delta", F.round("mean_delta", 6))


# For weights plus 0.7 per complementary pair at distance 3, pairs at distance 3 interact and others do not.
def _pair(a, b):
    return f"(CASE WHEN {b} = translate({a}, 'ACGT', 'TGCA') THEN 0.7::DOUBLE ELSE 0 END)"


_ALL_PAIRS = f"""p AS (SELECT unnest(range(0, 32)) AS p), b AS (SELECT * FROM (VALUES ('A'), ('C'), ('G'), ('T')) t(x)),
    e AS (SELECT id, i.p AS pos_i, ri AS ref_i, a.x AS base_i, j.p AS pos_j, rj AS ref_j, c.x AS base_j,
        round(CASE WHEN j.p = i.p + 3 THEN {_pair('a.x', 'c.x')} - {_pair('a.x', 'rj')} - {_pair('ri', 'c.x')} + {_pair('ri', 'rj')}
        ELSE 0 END, 6) + 0.0 AS delta_delta
        FROM seqs, p i JOIN p j ON i.p < j.p, b a, b c, LATERAL (SELECT substr(seq, i.p + 1, 1) AS ri, substr(seq, j.p + 1, 1) AS rj)
        WHERE a.x <> ri AND c.x <> rj)"""


@query("epistasis_all_pairs", "M13", views="seqs", sql=f"WITH {_ALL_PAIRS} SELECT * FROM e")
def _(v):
    return ef.epistasis2(v.seqs, pair_scorer(32)).drop("prediction").withColumn("delta_delta", F.round("delta_delta", 6) + 0.0)


_TOP_PAIRS = f"""
    WITH {_ALL_PAIRS} SELECT id, count(*) AS n, round(max(abs(delta_delta)), 6) AS largest FROM (SELECT *, row_number() OVER (
        PARTITION BY id ORDER BY abs(delta_delta) DESC) AS k FROM e WHERE abs(delta_delta) > 1e-6) WHERE k <= 20 GROUP BY id"""


@query("epistasis_all_top", "M13", views="seqs", sql=_TOP_PAIRS)
def _(v):
    top = ef.top_interactions(ef.epistasis2(v.seqs, pair_scorer(32)), n=20)
    return top.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs("delta_delta")), 6).alias("largest"))


# Pairwise terms leave no third-order term, so the scorer cubes the number of T. The region is the operator's own, the middle nine positions.
_TRIPLETS = """
    WITH p AS (SELECT unnest(range(12, 21)) AS p), b AS (SELECT * FROM (VALUES ('A'), ('C'), ('G'), ('T')) t(x)),
    t AS (SELECT id, i.p AS pos_i, j.p AS pos_j, k.p AS pos_k, substr(seq, i.p + 1, 1) AS ri, substr(seq, j.p + 1, 1) AS rj,
        substr(seq, k.p + 1, 1) AS rk FROM seqs, p i JOIN p j ON i.p < j.p JOIN p k ON j.p < k.p),
    e AS (SELECT *, (x.x = 'T')::INT - (ri = 'T')::INT AS di, (y.x = 'T')::INT - (rj = 'T')::INT AS dj,
        (z.x = 'T')::INT - (rk = 'T')::INT AS dk FROM t, b x, b y, b z WHERE x.x <> ri AND y.x <> rj AND z.x <> rk)
    SELECT id, pos_i, pos_j, pos_k, max(abs(6 * di * dj * dk))::DOUBLE AS size FROM e
    GROUP BY id, pos_i, pos_j, pos_k HAVING max(abs(6 * di * dj * dk)) > 0.01"""


@query("epistasis_default_triplets", "M14", views="seqs", sql=_TRIPLETS)
def _(v):
    cube = ExpressionScorer(lambda s: F.pow(F.length(s) - F.length(F.translate(s, "T", "")), F.lit(3)))
    return ef.epistasis3(v.seqs, cube).select("id", "pos_i", "pos_j", "pos_k", F.round(F.abs("interaction"), 6).alias("size"))


@query("strand_comparison", "M25", views="reads", sql=f"""
    SELECT id, round({weight_sum_sql('seq', 32)}, 6) AS forward,
        round({weight_sum_sql("reverse(translate(seq, 'ACGT', 'TGCA'))", 32)}, 6) AS reverse FROM reads""")
def _(v):
    out = ef.strand_comparison(v.reads, weight_scorer(32))
    return out.select("id", F.round("forward", 6).alias("forward"), F.round("reverse", 6).alias("reverse"))


# ---- matrices -----------------------------------------------------------------------------------

@query("pfm_information", "M22", views="reads", sql="""
    WITH c AS (SELECT p - 1 AS pos, b AS base, count(*) AS n FROM (SELECT unnest(range(1, 33)) AS p, seq FROM reads),
        LATERAL (SELECT substr(seq, p, 1) AS b) GROUP BY 1, 2),
    q AS (SELECT *, (n + 1) / (sum(n) OVER (PARTITION BY pos) + 4) AS prob FROM c)
    SELECT pos, base, round(prob, 6) AS prob, round(sum(prob * (log2(prob) + 2)) OVER (PARTITION BY pos), 6) AS bits FROM q""")
def _(v):
    out = mo.information(mo.pfm(v.reads), pseudocount=1.0)
    return out.select("pos", "base", F.round("prob", 6).alias("prob"), F.round("bits", 6).alias("bits"))


@query("pfm_contrast", "M23", views="reads", sql="""
    WITH r AS (SELECT seq, row_number() OVER (ORDER BY value DESC, md5('42:' || id)) AS hi,
        row_number() OVER (ORDER BY value, md5('42:' || id)) AS lo, greatest(count(*) OVER () // 10, 1) AS n FROM reads),
    c AS (SELECT p - 1 AS pos, substr(seq, p, 1) AS base, count(*) FILTER (hi <= n) AS t, count(*) FILTER (lo <= n) AS b, any_value(n) AS n
        FROM r, range(1, 33) g(p) GROUP BY 1, 2)
    SELECT pos, base, round(t / n, 6) AS top, round(b / n, 6) AS bottom, round(t / n - b / n, 6) + 0.0 AS difference FROM c""")
def _(v):
    out = mo.pfm_contrast(v.reads, score="value")
    return out.select("pos", "base", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"),
                      (F.round("difference", 6) + 0.0).alias("difference"))


@query("consensus", "M24", views="texts", sql=f"""
    WITH {windows_sql('texts', 8)}, c AS (SELECT id AS motif, p - 1 AS pos, substr(win, p, 1) AS base, count(*) AS n
        FROM wins, range(1, 9) t(p) GROUP BY ALL),
    b AS (SELECT motif, pos, arg_min(base, (-n, base)) AS base FROM c GROUP BY motif, pos)
    SELECT motif, string_agg(base, '' ORDER BY pos) AS consensus FROM b GROUP BY motif""")
def _(v):
    from lociframe.functions import dna
    wins = dna.tile(v.texts, "seq", 8, out="win").withColumnRenamed("id", "motif")
    return mo.consensus(mo.pfm(wins, "win", by=["motif"]))


# ---- attributions and filters -------------------------------------------------------------------

@query("attribute_references", "M15", views="reads weights", sql=f"""
    WITH r AS (SELECT *, reverse(seq) AS r1, seq[9:] || seq[:8] AS r2 FROM reads), l AS (SELECT id, p, substr(seq, p + 1, 1) AS b,
        substr(r1, p + 1, 1) AS b1, substr(r2, p + 1, 1) AS b2 FROM r, range(32) t(p))
    SELECT id, p AS pos, round(w.weight - (w1.weight + w2.weight) / 2, 6) + 0.0 AS value FROM l JOIN weights w ON w.pos = p AND w.base = b
    JOIN weights w1 ON w1.pos = p AND w1.base = b1 JOIN weights w2 ON w2.pos = p AND w2.base = b2""")
def _(v):
    rows = v.reads.withColumn("refs", F.array(F.reverse("seq"), F.concat(F.substring("seq", 9, 24), F.substring("seq", 1, 8))))
    out = at.long_attribution(at.attribute(rows, weight_scorer(32)))
    return out.withColumn("value", F.round("value", 6) + 0.0)


# Shuffles keep a sequence's bases, so under weights that do not depend on the position they explain all of its score.
@query("attribute_shuffles", "M15", views="reads", sql="SELECT id, 32::BIGINT AS n, 0.0::DOUBLE AS total FROM reads")
def _(v):
    rows = at.with_shuffles(v.reads, "id", 5)
    out = at.attribute(rows, WeightScorer([[0.125, 0.5, -0.25, 0.75]] * 32))
    out = at.attribution_sums(out.withColumn("n", F.size("attribution").cast("long")), keep=("n",))
    return out.withColumn("total", F.round("total", 6) + 0.0)


@query("input_x_weight", "M16", views="reads weights", sql="""
    SELECT id, pos, weight AS value FROM reads JOIN weights ON pos < 32 AND base = substr(seq, pos + 1, 1)""")
def _(v):
    return at.long_attribution(at.attribute(v.reads, weight_scorer(32), method="input_x_weight"))


def _seqlets(v):
    attributed = at.attribute(v.reads, weight_scorer(32), method="input_x_weight")
    return attributed, at.call_seqlets(attributed, max_p=0.05)


_SEQLETS = """value AS (SELECT id, pos, CASE substr(seq, pos + 1, 1) WHEN 'A' THEN (pos * 7) % 11 WHEN 'C' THEN (pos * 7 + 3) % 11 WHEN 'G' THEN (pos * 7 + 6) % 11 ELSE (pos * 7 + 9) % 11 END - 5 AS x
        FROM reads, range(32) t(pos)),
    total AS (SELECT id, pos, sum(x) OVER (PARTITION BY id ORDER BY pos) - x AS t, x FROM value),
    ends AS (SELECT id, pos, t FROM total UNION ALL SELECT id, 32, sum(x) FROM value GROUP BY id),
    span AS (SELECT a.id, a.pos AS s, b.pos AS e, b.pos - a.pos AS n, sign(b.t - a.t)::INT AS sign, abs(b.t - a.t) / 10.0::DOUBLE AS size
        FROM ends a JOIN ends b ON a.id = b.id AND b.pos - a.pos BETWEEN 5 AND 15 WHERE b.t <> a.t),
    sizes AS (SELECT n, sign, size, count(*) AS c FROM span GROUP BY ALL),
    tail AS (SELECT n, sign, size, sum(c) OVER (PARTITION BY n, sign ORDER BY size DESC) / sum(c) OVER (PARTITION BY n, sign) AS p FROM sizes),
    own AS MATERIALIZED (SELECT span.*, p FROM span JOIN tail USING (n, sign, size) WHERE p < 0.05),
    whole AS (SELECT a.id, a.s, a.e, a.n, a.sign, a.size, a.p FROM own a JOIN own b ON a.id = b.id AND a.sign = b.sign AND b.s >= a.s AND b.e <= a.e
        GROUP BY ALL HAVING count(*) = (a.n - 4) * (a.n - 3) // 2),
    good AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, -n, s, e) AS k FROM whole),
    greedy AS (SELECT id, [{'s': s, 'e': e}] AS taken, k FROM good WHERE k = 1
        UNION ALL SELECT g.id, list_append(any_value(g.taken), arg_min({'s': b.s, 'e': b.e}, b.k)), min(b.k) FROM greedy g JOIN good b ON b.id = g.id AND b.k > g.k
        WHERE len(list_filter(g.taken, lambda t: b.s < t.e AND b.e > t.s)) = 0 GROUP BY g.id),
    called AS MATERIALIZED (SELECT b.id, b.s AS start, b.e AS "end", b.size * b.sign AS attribution, b.p AS p_value FROM good b JOIN greedy g ON b.id = g.id AND b.k = g.k)"""


@query("call_seqlets", "M17", views="reads", sql=f"""
    WITH RECURSIVE {_SEQLETS} SELECT id, start, "end", round(attribution, 6) AS attribution, round(p_value, 6) AS p_value FROM called""")
def _(v):
    _, spans = _seqlets(v)
    return spans.withColumns({c: F.round(c, 6) for c in ("attribution", "p_value")})


@query("annotate_spans", "M18", views="reads", sql=f"""
    WITH RECURSIVE {_SEQLETS}, spans AS (SELECT c.id::VARCHAR || ':' || start::VARCHAR AS id, substr(seq, start + 1, "end" - start) AS seq FROM called c JOIN reads r ON c.id = r.id),
    {hits_sql('spans')}, {null_sql()},
    m AS (SELECT id, h.motif, 1 - pow(1 - min(p), count(*)) AS p FROM hits h JOIN null_table t ON h.motif = t.motif AND h.iscore = t.s GROUP BY id, h.motif),
    b AS (SELECT id, arg_min(motif, (p, motif)) AS motif, min(p) AS p FROM m GROUP BY id)
    SELECT motif AS name, count(*) AS count FROM b WHERE p < 0.05 GROUP BY motif""")
def _(v):
    attributed, spans = _seqlets(v)
    texts = spans.join(attributed.select("id", "seq"), "id").withColumn(
        "span_seq", F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    out = mo.annotate_spans(texts.drop("seq"), mo.log_odds(motif_table(v)), matrices(v), ["id", "start", "end"])
    return mo.top_motifs(out)


def _filters():
    """Two filters of width 5 and bias 0.125, weights by the rule of the views in whole eighths."""
    return at.Filters([[[weight(p + 3 * f, b) * 1.25 for b in range(4)] for p in range(5)] for f in range(2)], [0.125, 0.125])


def _act_sql(f, col):
    terms = [f"CASE substr({col}, {p + 1}, 1) WHEN 'A' THEN {weight(p + 3 * f, 0) * 1.25} WHEN 'C' THEN {weight(p + 3 * f, 1) * 1.25} "
             f"WHEN 'G' THEN {weight(p + 3 * f, 2) * 1.25} WHEN 'T' THEN {weight(p + 3 * f, 3) * 1.25} ELSE 0 END" for p in range(5)]
    return "(0.125 + " + " + ".join(f"({t})::DOUBLE" for t in terms) + ")"


_ACTS = f"""acts AS MATERIALIZED (SELECT id, f, i, CASE f WHEN 0 THEN {_act_sql(0, 'w')} ELSE {_act_sql(1, 'w')} END AS a, w
    FROM (SELECT id, off + i AS i, substr(s, i + 1, 5) AS w FROM (SELECT id, off, s, unnest(range(length(s) - 4)) AS i FROM (
        SELECT id, c * 256 AS off, substr(seq, (c * 256 + 1)::BIGINT, 260) AS s FROM (
            SELECT id, seq, unnest(range(length(seq) // 256 + 1)) AS c FROM texts)))), range(2) t(f)),
    hi AS (SELECT *, max(a) OVER (PARTITION BY f) AS m FROM acts)"""


@query("filter_summary", "M19", views="texts", sql=f"""
    WITH {_ACTS} SELECT f::INTEGER AS filter, round(any_value(m), 4) AS max_activation, count(*) FILTER (a >= m * 0.8::DOUBLE) AS num_activating
    FROM hi GROUP BY f""")
def _(v):
    return at.filter_summary(v.texts, _filters()).withColumn("max_activation", F.round("max_activation", 4))


@query("filter_pfm", "M20", views="texts", sql=f"""
    WITH {_ACTS}, k AS (SELECT *, row_number() OVER (PARTITION BY f, id ORDER BY i) AS r FROM hi WHERE a >= m * 0.8::DOUBLE)
    SELECT f::INTEGER AS filter, p - 1 AS pos, b.base, round(count(*) FILTER (substr(w, p, 1) = b.base) / count(*), 6) AS prob,
        count(*) AS coverage FROM k, range(1, 6) t(p), (VALUES ('A'), ('C'), ('G'), ('T')) b(base) WHERE r <= 10 GROUP BY ALL""")
def _(v):
    return at.filter_pfm(v.texts, _filters()).drop("nsites").withColumn("prob", F.round("prob", 6))


@query("top_subsequences", "M21", views="texts", sql=f"""
    WITH {_ACTS} SELECT f::INTEGER AS filter, rank, id, i AS start, round(a, 4) AS activation, w AS subsequence FROM (
        SELECT *, row_number() OVER (PARTITION BY f ORDER BY a DESC, id, i) AS rank FROM acts) WHERE rank <= 10""")
def _(v):
    return at.top_subsequences(v.texts, _filters()).withColumn("activation", F.round("activation", 4))


@query("scan_region", "M26", views="intervals chroms", sql=f"""
    WITH r AS (SELECT id, chrom, start, substr(bases, start + 1, "end" - start) AS seq FROM intervals JOIN chroms USING (chrom)),
    w AS (SELECT id, chrom, start + i AS start, start + i + 50 AS "end", substr(seq, i + 1, 50) AS sequence FROM (
        SELECT *, unnest(range(0, length(seq) - 49, 25)) AS i FROM r))
    SELECT id, chrom, start, "end", sequence, round({weight_sum_sql('sequence', 50)}, 6) AS prediction FROM w
    WHERE {has_only_acgt_sql('sequence')}""")
def _(v):
    regions = extract_regions(v.intervals.select("id", "chrom", "start", "end"), v.packed, BIN, "id").where(F.col("seq").isNotNull())
    out = at.scan_region(regions, weight_scorer(50))
    # Without references the attributions of an additive scorer add up to its score.
    total = F.aggregate("attribution", F.lit(0.0), lambda a, x: a + x)
    return out.select("id", "chrom", "start", "end", "sequence", F.round(total, 6).alias("prediction"))


def genome_hits_sql(name):
    """hits (chrom, pos, score, strand): the better strand of every window of the genome, away from the ends of its contig."""
    return f"""w AS (SELECT chrom, off + i AS pos, substr(s, i + 1, {WIDTH}) AS s FROM (SELECT chrom, off, s, unnest(range(256)) AS i FROM (
        SELECT chrom, bin * {BIN} + c * 256 AS off, substr(bases, (c * 256 + 1)::BIGINT, {255 + WIDTH}) AS s FROM halo, range({BIN // 256}) t(c)))),
    both_ AS (SELECT chrom, pos, {pwm_sql(name, 's')} AS f, {pwm_sql(name, 's', True)} AS r FROM w WHERE length(s) = {WIDTH} AND {has_only_acgt_sql('s')}),
    hits AS MATERIALIZED (SELECT chrom, pos, greatest(f, r) AS score, CASE WHEN f >= r THEN '+' ELSE '-' END AS strand FROM both_ JOIN contigs USING (chrom)
        WHERE pos >= 101 AND pos < length - {WIDTH} - 101)"""


def spaced_sql(n, distance):
    """chosen: per contig the n best hits, each at least `distance` from those before; scores to nine digits, ties to the larger place."""
    return f"""best AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY round(score, 9) DESC, pos DESC) AS k FROM hits
        QUALIFY k <= {(n - 1) * (2 * distance - 1) + 1}),
    greedy AS (SELECT chrom, 1 AS step, [pos] AS taken, k FROM best WHERE k = 1
        UNION ALL SELECT g.chrom, any_value(g.step) + 1, list_append(any_value(g.taken), arg_min(b.pos, b.k)), min(b.k) FROM greedy g JOIN best b ON b.chrom = g.chrom AND b.k > g.k
        WHERE g.step < {n} AND len(list_filter(g.taken, lambda t: abs(t - b.pos) < {distance})) = 0 GROUP BY g.chrom),
    chosen AS (SELECT b.* FROM best b JOIN greedy g ON b.chrom = g.chrom AND b.k = g.k)"""


@query("top_n_spaced", "I17", views="halo contigs", sql=f"""
    WITH RECURSIVE {genome_hits_sql('alpha')}, {spaced_sql(4, 200)} SELECT chrom, pos, round(score, 6) AS score, strand FROM chosen""")
def _(v):
    found = best_spaced(with_halo(v.packed, WIDTH - 1, BIN), matrices(v)["alpha"], 4, 200, BIN, 101, contig_lengths(v.packed, BIN))
    return found.withColumn("score", F.round("score", 6))


@query("window_min", "I18", views="halo", sql=f"""
    WITH w AS (SELECT chrom, off + i AS pos, substr(s, i + 1, 11) AS s FROM (SELECT chrom, off, s, unnest(range(length(s) - 10)) AS i FROM (
        SELECT chrom, bin * {BIN} + c * 256 AS off, substr(bases, (c * 256 + 1)::BIGINT, 266) AS s FROM halo, range({BIN // 256}) t(c)))),
    e AS (SELECT chrom, pos, CASE WHEN {has_only_acgt_sql('s')} THEN round({weight_sum_sql('s', 11)}, 6) END AS energy FROM w),
    m AS (SELECT chrom, pos, min(energy) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING) AS window_min,
        max(pos) OVER (PARTITION BY chrom) + 11 AS region_end FROM e)
    SELECT chrom, pos AS window_start, window_min FROM m WHERE pos % 20 = 0 AND pos + 24 <= region_end""")
def _(v):
    return window_minima(with_halo(v.packed, 23, BIN), weight_scorer(11, 6), 11, 24, 20, BIN)
