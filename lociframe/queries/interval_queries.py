"""Interval operators over the driver's tables."""

from pyspark.sql import functions as F

from lociframe.operators import intervals as iv
from lociframe.operators.sampling import sample_n
from lociframe.queries.registry import query


@query("merge_intervals", "I1", views="merged", sql='SELECT chrom, start, "end", num FROM merged')
def _(v):
    return iv.merge_intervals(v.intervals).select("chrom", "start", "end", "num")


@query("filter_confidence", "I2", views="merged",
       sql='SELECT chrom, start, "end", num FROM merged WHERE num >= 5')
def _(v):
    return iv.filter_confidence(iv.merge_intervals(v.intervals), 5).select("chrom", "start", "end", "num")


_EXCL = """excl AS MATERIALIZED (SELECT chrom, min(s) AS start, max(e) AS "end" FROM (
    SELECT *, sum(o) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chrom ORDER BY s, e
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o
        FROM (SELECT chrom, greatest(0, start - {pad}) AS s, "end" + {pad} AS e FROM {table})))
    GROUP BY chrom, g)"""


@query("exclusion_set", "I3", views="intervals",
       sql=f'WITH {_EXCL.format(pad=30, table="intervals")} SELECT chrom, start, "end" FROM excl')
def _(v):
    return iv.exclusion_set(v.intervals, 30)


@query("overlap_join", "I4", views="intervals placed", sql="""
    SELECT p.id, p.chrom, p.start, p."end", p.num, v.key, v.pos FROM intervals p JOIN placed v
    ON p.chrom = v.chrom AND v.pos - 1 >= p.start AND v.pos - 1 < p."end" """)
def _(v):
    points = v.variants.select("key", "chrom", "pos", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"))
    return iv.overlap_join(v.intervals, points).select("id", "chrom", "start", "end", "num", "key", "pos")


@query("exclude_overlaps", "I5", views="intervals", sql=f"""
    WITH {_EXCL.format(pad=10, table="(SELECT * FROM intervals WHERE tf = 'R')")}
    SELECT id, chrom, start, "end" FROM intervals i WHERE tf <> 'R' AND NOT EXISTS (
        SELECT 1 FROM excl x WHERE x.chrom = i.chrom AND x.start < i."end" AND i.start < x."end")""")
def _(v):
    excluded = iv.exclusion_set(v.intervals.where("tf = 'R'"), 10)
    rows = v.intervals.where("tf <> 'R'").select("id", "chrom", "start", "end")
    return iv.exclude_overlaps(rows, excluded)


@query("resolve_contig", "I6", views="intervals contigs", sql="""
    SELECT i.chrom AS contig, ltrim_chr AS name, count(*)::BIGINT AS n FROM (
        SELECT *, replace(chrom, 'chr', '') AS ltrim_chr FROM intervals) i GROUP BY 1, 2""")
def _(v):
    from lociframe.functions.contigs import resolve_contig
    bare = v.intervals.withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))
    names = resolve_contig(bare, v.contigs)
    return (bare.groupBy(F.col("chrom").alias("name")).agg(F.count(F.lit(1)).alias("n"))
            .join(names, "name").select("contig", "name", "n"))


def _centred(where, we):
    return f"""SELECT id, chrom, mid - 100 AS ws, {we} AS we FROM (
        SELECT i.*, start + ("end" - start) // 2 AS mid, length FROM intervals i JOIN contigs USING (chrom))
        WHERE mid - 100 >= 0 AND {where}"""


@query("center_windows", "I7", views="intervals", sql=_centred("mid + 100 <= length", "mid + 100"))
def _(v):
    return iv.center_windows(v.intervals, 200, v.contigs).select("id", "chrom", "ws", "we")


@query("center_windows_strict", "I8", views="intervals", sql=_centred("mid + 100 < length", "mid + 100"))
def _(v):
    return iv.center_windows(v.intervals, 200, v.contigs, "strict").select("id", "chrom", "ws", "we")


@query("center_windows_odd", "I8", views="intervals", sql=_centred("mid + 101 < length", "mid + 101"))
def _(v):
    return iv.center_windows(v.intervals, 201, v.contigs, "odd").select("id", "chrom", "ws", "we")


@query("cap_region", "I9", views="intervals", sql="""
    SELECT id, chrom, CASE WHEN "end" - start > 120 THEN (start + "end") // 2 - 60 ELSE start END AS start,
    CASE WHEN "end" - start > 120 THEN (start + "end") // 2 + 60 ELSE "end" END AS "end" FROM intervals""")
def _(v):
    return iv.cap_region(v.intervals, 120).select("id", "chrom", "start", "end")


@query("summit_window", "I10", views="intervals", sql="""
    SELECT id, chrom, c - 5 AS ws, c + 6 AS we FROM (
        SELECT *, coalesce(CASE WHEN num > 3 THEN start + 7 END, start + ("end" - start) // 2) AS c FROM intervals)""")
def _(v):
    rows = v.intervals.withColumn("summit", F.when(F.col("num") > 3, F.col("start") + 7))
    return iv.summit_window(rows, 11, "summit").select("id", "chrom", "ws", "we")


@query("sample_n", "I13", views="intervals",
       sql="SELECT id, chrom, start FROM intervals ORDER BY md5('42:' || id) LIMIT 500")
def _(v):
    return sample_n(v.intervals, 500, "id", 42).select("id", "chrom", "start")


@query("score_distribution", "I14", views="intervals",
       sql="SELECT num, count(*) AS n FROM intervals WHERE num >= 4 GROUP BY num")
def _(v):
    return iv.score_distribution(iv.filter_min_score(v.intervals, 4, "num"), "num")


@query("locate_best", "I16", views="intervals", sql="""
    SELECT id, b AS best_start, b + 24 AS best_end, chrom || ':' || b::VARCHAR || '-' || (b + 24)::VARCHAR AS best_peak
    FROM (SELECT *, (start + "end") // 2 - 100 + num * 3 AS b FROM intervals)""")
def _(v):
    rows = v.intervals.withColumn("best_idx", F.col("num") * 3)
    return iv.locate_best(rows, 200, 24).select("id", "best_start", "best_end", "best_peak")
