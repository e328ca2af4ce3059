"""Sequence functions, genome extraction and negative sets over the driver's tables."""

from pyspark.sql import functions as F

from lociframe.functions import dna
from lociframe.operators import genome as gn
from lociframe.operators import intervals as iv
from lociframe.operators import negatives as ng
from lociframe.queries.registry import query
from lociframe.session import stored
from lociframe.queries.views import BIN, extraction_sql, has_only_acgt_sql


def _n(col):
    return F.length(col).cast("long")


# ---- Q: functions of one sequence -------------------------------------------------------------

@query("validate_dna", "Q1", views="texts", sql="""
    SELECT count(*) AS n_rows, count(*) FILTER (bad) AS n_bad, min(id) FILTER (bad) AS first_bad,
        min(length(seq)) AS min_length, max(length(seq)) AS max_length,
        min(length(seq)) = max(length(seq)) AS one_length
    FROM (SELECT *, NOT regexp_full_match(seq, '[ACGTacgt]+') AS bad FROM texts)""")
def _(v):
    return dna.validate_dna(v.texts, "id")


@query("revcomp", "Q2", views="texts", sql="""
    SELECT id, md5(reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))) AS rc FROM texts""")
def _(v):
    return v.texts.select("id", F.md5(dna.revcomp("seq")).alias("rc"))


@query("one_hot", "Q3", views="reads", sql="""
    SELECT id, string_agg(CASE b WHEN 'A' THEN '1000' WHEN 'C' THEN '0100' WHEN 'G' THEN '0010'
        WHEN 'T' THEN '0001' ELSE '0000' END, '' ORDER BY p) AS bits, any_value(seq) AS decoded
    FROM (SELECT id, seq, unnest(range(1, 33)) AS p, substr(seq, p, 1) AS b FROM reads) GROUP BY id""")
def _(v):
    hot = v.reads.select("id", dna.one_hot("seq").alias("hot"))
    return hot.select("id", F.array_join(F.transform("hot", lambda x: x.cast("int").cast("string")), "").alias("bits"),
                      dna.from_one_hot("hot").alias("decoded"))


@query("pad_and_trim", "Q4", views="texts", sql="""
    SELECT id, md5(rpad(seq, (SELECT max(length(seq)) FROM texts)::INTEGER, 'N')) AS padded,
        CASE WHEN length(seq) >= 500 THEN substr(seq, (length(seq) - 500) // 2 + 1, 500) END AS middle FROM texts""")
def _(v):
    longest = v.texts.agg(F.max(F.length("seq"))).scalar()
    return v.texts.select("id", F.md5(dna.pad_n("seq", longest)).alias("padded"),
                          dna.center_trim("seq", 500).alias("middle"))


@query("gc_content", "Q5", views="texts", sql="""
    SELECT id, round(CASE WHEN length(seq) = 0 THEN 0.0
        ELSE length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) END, 6) AS gc FROM texts""")
def _(v):
    return v.texts.select("id", F.round(dna.gc_content("seq"), 6).alias("gc"))


@query("add_context", "Q6", views="reads", sql="SELECT id, 'CACTGC' || seq || 'TTGA' AS seq FROM reads")
def _(v):
    return v.reads.select("id", dna.add_context("seq", "CACTGC", "TTGA", 42).alias("seq"))


@query("kmer_counts", "Q7", views="texts", sql=f"""
    SELECT id, kmer, count(*) AS n FROM (
        SELECT id, substr(seq, unnest(range(1, length(seq) - 1)), 3) AS kmer FROM texts)
    WHERE {has_only_acgt_sql('kmer')} GROUP BY id, kmer""")
def _(v):
    return dna.kmer_counts(v.texts, "id", "seq", 3)


@query("substitute", "Q8", views="reads", sql="""
    SELECT id, seq[:16] || 'GAT' || seq[20:] AS seq FROM reads""")
def _(v):
    return v.reads.select("id", dna.substitute("seq", 16, F.lit("NNN"), F.lit("GAT")).alias("seq"))


@query("insert_motif", "Q9", views="reads", sql="""
    SELECT id, seq[:12] || 'CAAGTGC' || seq[20:] AS centred, seq[:3] || 'CAAGTGC' || seq[11:] AS at_three FROM reads""")
def _(v):
    return v.reads.select("id", dna.insert_motif("seq", "CAAGTGC").alias("centred"),
                          dna.insert_motif("seq", "CAAGTGC", 3).alias("at_three"))


@query("expand_n", "Q10", views="seqs", sql="""
    SELECT id, k::BIGINT AS variant, seq[:4] || 'ACGT'[(k // 16) + 1] || seq[6:9] || 'ACGT'[(k // 4) % 4 + 1]
        || 'ACGT'[k % 4 + 1] || seq[12:] AS expanded FROM seqs, range(64) t(k)""")
def _(v):
    masked = v.seqs.withColumn("seq", F.concat(F.substring("seq", 1, 4), F.lit("N"), F.substring("seq", 6, 4),
                                               F.lit("NN"), F.expr("substring(seq, 12)")))
    return dna.expand_n(masked, "seq").select("id", "variant", "expanded")


@query("substitution_list", "Q11", views="seqs reads", sql="""
    SELECT id, string_agg(lower(a) || 'C' || p::VARCHAR || lower(b), ',' ORDER BY p) AS mutations FROM (
        SELECT r.id, unnest(range(1, 33)) AS p, substr(s.seq, p, 1) AS a, substr(r.seq, p, 1) AS b
        FROM reads r JOIN seqs s ON s.id = r.id // 8) WHERE a <> b GROUP BY id""")
def _(v):
    # The templates grow with the data, and their size is not known beforehand: joined by a shuffle, as plain text.
    strand = v.seqs.select(F.col("id").alias("template"), F.col("seq").alias("strand"))
    rows = v.reads.select("id", "seq", F.expr("id div 8").alias("template")).join(strand.hint("merge"), "template").where("strand <> seq")
    bases = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda p: F.struct(p.alias("resnum"), F.substring(F.col("strand"), p, F.lit(1)).alias("base")))
    return rows.select("id", dna.substitution_list(bases, "seq", F.lit("C")).alias("mutations"))


@query("add_revcomp", "Q12", views="reads", sql="""
    SELECT id, false AS is_rc, seq FROM reads
    UNION ALL SELECT id, true, reverse(translate(seq, 'ACGT', 'TGCA')) FROM reads""")
def _(v):
    return dna.add_revcomp(v.reads.select("id", "seq")).select("id", "is_rc", "seq")


@query("tile", "I15", views="texts", sql=f"""
    SELECT id, win_start, win FROM (
        SELECT id, win_start, substr(seq, win_start + 1, 50) AS win FROM (
            SELECT *, unnest(range(0, length(seq) - 49, 25)) AS win_start FROM texts))
    WHERE {has_only_acgt_sql('win')}""")
def _(v):
    return dna.tile(v.texts, "seq", 50, 25).select("id", F.col("win_start").cast("long").alias("win_start"), "win")


# ---- I11, I12: sequences out of the genome -----------------------------------------------------

@query("extract_windows", "I11", views="intervals chroms", sql=f"""
    SELECT id, ws, {extraction_sql('chroms', 'ws', '200')} AS seq FROM (
        SELECT *, start + ("end" - start) // 2 - 100 AS ws FROM intervals) JOIN chroms USING (chrom)""")
def _(v):
    windows = iv.center_windows(v.intervals, 200, v.contigs, keep_all=True)
    cut = gn.extract_windows(windows, v.packed, 200, BIN, row_key=F.col("id"))
    return cut.select("id", "ws", "seq")


@query("extract_regions", "I11", views="intervals chroms", sql="""
    SELECT id, start, substr(bases, start + 1, "end" - start) AS seq FROM intervals JOIN chroms USING (chrom)""")
def _(v):
    return gn.extract_regions(v.intervals.select("id", "chrom", "start", "end"), v.packed, BIN, "id").select(
        "id", "start", "seq")


@query("filter_report", "I12", views="intervals chroms", sql=f"""
    WITH cut AS MATERIALIZED (SELECT num, {extraction_sql('chroms', 'ws', '200')} AS s FROM (
        SELECT *, start + ("end" - start) // 2 - 100 AS ws FROM intervals) JOIN chroms USING (chrom))
    SELECT reason, count(*) AS n FROM (SELECT CASE WHEN s IS NULL THEN 'bounds'
        WHEN num = 7 THEN 'score' WHEN NOT {has_only_acgt_sql('s')} THEN 'non_acgt' ELSE 'kept' END AS reason
    FROM cut) GROUP BY reason""")
def _(v):
    peaks = v.intervals.withColumn("score", F.when(F.col("num") != 7, F.col("score")))
    windows = iv.center_windows(peaks, 200, v.contigs, keep_all=True)
    return iv.filter_report(gn.extract_windows(windows, v.packed, 200, BIN, row_key=F.col("id")))


@query("parse_variants", "S7", views="variants", sql="""
    SELECT key, CASE WHEN key % 7 <> 0 THEN chrom END AS chrom, CASE WHEN key % 7 <> 0 THEN pos END AS pos,
        CASE WHEN key % 7 <> 0 THEN ref END AS ref, CASE WHEN key % 7 <> 0 THEN alt END AS alt FROM variants""")
def _(v):
    text = F.concat_ws(":", "chrom", F.col("pos").cast("string"), F.concat("ref", F.when(F.col("key") % 7 == 0, "-").otherwise(">"), "alt"))
    return gn.parse_variants(v.variants.select("key", text.alias("variant"))).drop("variant")


@query("variant_windows", "M9", views="variants chroms", sql=f"""
    SELECT key, status, CASE WHEN status = 'ok' THEN w END AS ref_window,
        CASE WHEN status = 'ok' THEN w[:12] || alt || w[14:] END AS alt_window FROM (
        SELECT *, CASE WHEN ref = 'N' THEN 'invalid' WHEN key % 13 = 0 THEN 'unsupported'
            WHEN key % 17 = 0 THEN 'unknown_chrom' WHEN w IS NULL THEN 'out_of_bounds'
            WHEN w[13] <> ref THEN 'ref_mismatch' WHEN NOT {has_only_acgt_sql('w')} THEN 'contains_n'
            ELSE 'ok' END AS status
        FROM (SELECT key, pos, ref, alt, {extraction_sql('chroms', '(pos - 13)', '24')} AS w
              FROM variants JOIN chroms USING (chrom)))""")
def _(v):
    rows = v.variants.select(
        "key", F.when(F.col("key") % 17 == 0, "chrUn").when(F.col("key") % 2 == 0, F.expr("substring(chrom, 4)"))
        .otherwise(F.col("chrom")).alias("chrom"), "pos", "ref",
        F.when(F.col("key") % 13 == 0, F.concat("alt", F.lit("A"))).otherwise(F.col("alt")).alias("alt"))
    out = gn.variant_windows(rows, v.packed, v.contigs, 24, BIN, row_key=F.col("key"))
    return out.select("key", "status", "ref_window", "alt_window")


# ---- N: negative sets --------------------------------------------------------------------------

def positive_windows(v, width, *keep):
    """The windows of the peaks that hold only A, C, G, T, with the columns to keep, which alone are shuffled."""
    windows = iv.center_windows(v.intervals, width, v.contigs).select(*keep, "chrom", "ws", "we")
    cut = gn.extract_windows(windows, v.packed, width, BIN)
    return cut.where(dna.is_acgt("seq"))


def gc_negatives_sql(width):
    """CTEs of the GC-matched draw: a grid per contig, less what the peaks and windows block, the first of each bin by hash."""
    bin_of = "least(floor(gc / 0.05::DOUBLE + 1e-9), 19)::BIGINT"
    share = f"length(regexp_replace(seq, '[^GC]', '', 'g')) / {width}.0::DOUBLE"
    return f"""pos_rows AS MATERIALIZED (SELECT * FROM (SELECT chrom, ws, {extraction_sql('chroms', 'ws', str(width))} AS seq FROM (
            SELECT *, start + ("end" - start) // 2 - {width // 2} AS ws FROM intervals) JOIN chroms USING (chrom)) WHERE {has_only_acgt_sql('seq')}),
        need AS (SELECT {bin_of} AS gc_bin, count(*) AS quota FROM (SELECT {share} AS gc FROM pos_rows) GROUP BY 1),
        padded AS (SELECT chrom, start - {width} AS s, "end" + {width} AS e FROM intervals UNION ALL SELECT chrom, ws - {width}, ws + {2 * width} FROM pos_rows),
        blocked AS MATERIALIZED (SELECT chrom, min(s) AS s, max(e) AS e FROM (SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
            SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM padded)) GROUP BY chrom, island),
        {', '.join(_phase_sql(width, k, bin_of, share) for k in range(4))},
        picked AS MATERIALIZED (SELECT *, start + {width} AS "end" FROM taken3)"""


def _phase_sql(width, k, bin_of, share):
    """CTEs of one phase: taken<k> holds all windows so far."""
    before = f"taken{k - 1}" if k else "(SELECT * FROM grid0 WHERE false)"
    clear = "" if not k else f" ASOF LEFT JOIN {before} t ON g.chrom = t.chrom AND g.start + {width} > t.start"
    unhurt = "" if not k else f" AND (t.start IS NULL OR t.start + {width} <= g.start)"
    taken = "" if not k else f"SELECT chrom, start, seq, gc, gc_bin FROM {before} UNION ALL "
    found = f"(SELECT gc_bin, count(*) AS n FROM {before} GROUP BY gc_bin)" if k else "(SELECT gc_bin, 0 AS n FROM need)"
    return f"""grid{k} AS (SELECT chrom, unnest(range((('0x' || substr(md5('42:' || chrom), 1, 8))::BIGINT + {k * width // 4}) % {width}, length - {width} + 1, {width})) AS start FROM contigs),
        free{k} AS (SELECT g.chrom, g.start FROM grid{k} g ASOF LEFT JOIN blocked b ON g.chrom = b.chrom AND g.start + {width} > b.s{clear} WHERE (b.e IS NULL OR b.e <= g.start){unhurt}),
        cut{k} AS (SELECT chrom, start, {extraction_sql('chroms', 'start', str(width))} AS seq FROM free{k} JOIN chroms USING (chrom)),
        binned{k} AS (SELECT *, {bin_of} AS gc_bin FROM (SELECT *, {share} AS gc FROM cut{k} WHERE {has_only_acgt_sql('seq')})),
        taken{k} AS MATERIALIZED ({taken}SELECT chrom, start, seq, gc, gc_bin FROM (SELECT *, row_number() OVER (PARTITION BY gc_bin ORDER BY md5('42:' || chrom || ':' || start::VARCHAR)) AS k
            FROM binned{k}) JOIN need USING (gc_bin) LEFT JOIN {found} f USING (gc_bin) WHERE k <= quota - coalesce(n, 0))"""


@query("gc_matched_negatives", "N1", views="intervals chroms contigs", sql=f"""
    WITH {gc_negatives_sql(24)} SELECT chrom, start, "end", seq, round(gc, 6) AS gc FROM picked""")
def _(v):
    positives = stored(positive_windows(v, 24))
    picked, _ = ng.gc_matched_negatives(v.packed, positives, v.intervals, 24, BIN)
    return picked.select("chrom", "start", "end", "seq", F.round("gc", 6).alias("gc"))


@query("gc_report", "N2", views="intervals chroms", sql=f"""
    WITH cut AS MATERIALIZED (SELECT tf, {extraction_sql('chroms', 'ws', '200')} AS seq FROM (
        SELECT *, start + ("end" - start) // 2 - 100 AS ws FROM intervals) JOIN chroms USING (chrom)),
    g AS (SELECT tf, length(regexp_replace(seq, '[^GC]', '', 'g')) / 200.0::DOUBLE AS gc FROM cut
          WHERE {has_only_acgt_sql('seq')}),
    b AS (SELECT least(floor(gc / 0.05::DOUBLE + 1e-9), 19)::BIGINT AS gc_bin, count(*) FILTER (tf = 'R') AS wanted,
        count(*) FILTER (tf = 'A') AS found, round(avg(gc) FILTER (tf = 'R'), 6) AS positive_gc,
        round(avg(gc) FILTER (tf = 'A'), 6) AS negative_gc FROM g WHERE tf <> 'N' GROUP BY 1)
    SELECT gc_bin, wanted, found, greatest(wanted - found, 0) AS missing, positive_gc, negative_gc FROM b""")
def _(v):
    rows = positive_windows(v, 200, "tf")
    report = ng.gc_report(rows.where("tf = 'R'"), rows.where("tf = 'A'"))
    return report.withColumns({c: F.round(c, 6) for c in ("positive_gc", "negative_gc")})


def region_negatives_sql(peaks, excluded, seed):
    """CTEs positive (id, seq) and region: for each the first of 200 hashed draws that is free, near in GC, and its N filled."""
    number = "('0x' || substr(md5('{0}:{1}:' || id || ':' || attempt::VARCHAR), 1, 12))::BIGINT".format
    gc = "length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq)::DOUBLE"
    letters = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
    return f"""positive AS MATERIALIZED (SELECT id, substr(bases, (start + 1)::BIGINT, "end" - start) AS seq FROM {peaks} JOIN chroms USING (chrom)),
        blocked AS MATERIALIZED (SELECT chrom, min(start) AS s, max("end") AS e FROM (SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
            SELECT chrom, start, "end", CASE WHEN start <= max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                THEN 0 ELSE 1 END AS opens FROM {excluded})) GROUP BY chrom, island),
        usable AS (SELECT list({{'chrom': chrom, 'length': length}} ORDER BY chrom, length) AS l FROM contigs WHERE chrom IN (SELECT chrom FROM blocked)),
        wide AS MATERIALIZED (SELECT chrom, bin, seq || coalesce(lead(seq) OVER (PARTITION BY chrom ORDER BY bin), '') AS bases FROM genome),
        placed AS (SELECT id, len, attempt, c.chrom AS chrom, c.length AS size, {number(seed, 'start')} % greatest(1, c.length - len) AS start FROM (
            SELECT id, length(seq) AS len, attempt::BIGINT AS attempt, l[{number(seed, 'contig')} % len(l) + 1] AS c FROM positive, usable, range(200) t(attempt))),
        drawn AS (SELECT id, attempt, chrom, start, least(start + len, size) AS "end" FROM placed),
        clear AS (SELECT d.* FROM drawn d ASOF LEFT JOIN blocked b ON d.chrom = b.chrom AND d."end" > b.s WHERE b.e IS NULL OR b.e <= d.start),
        read AS (SELECT c.*, substr(bases, start % {BIN} + 1, "end" - start) AS seq FROM clear c JOIN wide w ON c.chrom = w.chrom AND c.start // {BIN} = w.bin),
        judged AS (SELECT r.*, abs({gc.replace('seq', 'r.seq')} - {gc.replace('seq', 'p.seq')}) <= 0.05 AS gc_ok FROM read r JOIN positive p USING (id)
            WHERE (length(r.seq) - length(replace(r.seq, 'N', ''))) / length(r.seq)::DOUBLE <= 0.1),
        first AS MATERIALIZED (SELECT id, arg_min({{'chrom': chrom, 'start': start, 'end': "end", 'seq': seq, 'gc_ok': gc_ok, 'attempt': attempt}}, (NOT gc_ok, attempt)) AS b FROM judged GROUP BY id),
        region AS MATERIALIZED (SELECT id, any_value(b.chrom) AS chrom, any_value(b.start) AS start, any_value(b."end") AS "end", any_value(b.gc_ok) AS gc_ok, any_value(b.attempt) AS attempt,
            string_agg(CASE WHEN i = 1 THEN p ELSE translate(substr(md5('{seed}:' || id || ':' || (i - 1)::VARCHAR), 1, 1), {letters}) || p END, '' ORDER BY i) AS seq
            FROM (SELECT id, b, unnest(string_split(b.seq, 'N')) AS p, generate_subscripts(string_split(b.seq, 'N'), 1) AS i FROM first) GROUP BY id)"""


@query("matched_region_negatives", "N3", views="intervals chroms contigs genome", sql=f"""
    WITH peak AS (SELECT id, chrom, start, "end" FROM intervals), {region_negatives_sql('peak', 'intervals', 43)}
    SELECT id, chrom, start, "end", gc_ok, attempt::INTEGER AS attempt, md5(seq) AS seq FROM region""")
def _(v):
    peaks = gn.extract_regions(v.intervals.select("id", "chrom", "start", "end"), v.packed, BIN, "id")
    return ng.matched_region_negatives(stored(peaks.where(F.col("seq").isNotNull())), v.packed, v.contigs, iv.exclusion_set(v.intervals, 0), BIN, longest=300
                                       ).select("id", "chrom", "start", "end", "gc_ok", "attempt", F.md5("seq").alias("seq"))


# What a shuffle must keep: its ends and every pair of neighbours, so the SQL counts the originals; and of all places, most change.
@query("dinuc_shuffle", "N4", views="texts", sql="""
    WITH l AS (SELECT id, upper(seq) AS seq, string_split(upper(seq), '') AS l FROM texts), p AS (SELECT id, l[i] || l[i + 1] AS pair, count(*) AS n
        FROM (SELECT id, l, unnest(range(1, len(l))) AS i FROM l) GROUP BY ALL)
    SELECT id, shuffle, seq[1] AS first, seq[-1:] AS last, length(seq) AS length, pair, n, true AS moved FROM l JOIN p USING (id), (VALUES (0), (1)) s(shuffle)""")
def _(v):
    rows = stored(ng.dinuc_shuffle(v.texts.withColumn("was", F.upper("seq")), "id", n=2).withColumn("key", F.concat_ws(":", "id", "shuffle")))
    pairs = dna.kmer_counts(rows, "key", "seq", 2, skip_n=False).withColumnRenamed("kmer", "pair")
    changed = F.size(F.filter(F.zip_with(F.split("seq", ""), F.split("was", ""), lambda a, b: a != b), lambda x: x))
    share = rows.groupBy("shuffle").agg((F.sum(changed) > 0.4 * F.sum(F.length("seq"))).alias("moved"))
    ends = rows.select("key", "id", "shuffle", F.substring("seq", 1, 1).alias("first"), F.substring("seq", -1, 1).alias("last"), _n("seq").alias("length"))
    return ends.join(pairs, "key").drop("key").join(F.broadcast(share), "shuffle")      # two rows


@query("fill_n", "N5", views="texts", sql="""
    SELECT id, md5(string_agg(CASE WHEN i = 1 THEN p ELSE translate(substr(md5('9:' || id::VARCHAR || ':' || (i - 1)::VARCHAR), 1, 1),
        '0123456789abcdef', 'ACGTACGTACGTACGT') || p END, '' ORDER BY i)) AS seq
    FROM (SELECT id, unnest(string_split(seq, 'N')) AS p, generate_subscripts(string_split(seq, 'N'), 1) AS i FROM texts)
    GROUP BY id""")
def _(v):
    return v.texts.select("id", F.md5(dna.fill_n("seq", "id", 9)).alias("seq"))


@query("random_sequences", "N6", views="", sql="""
    SELECT o_orderkey AS id, substr(translate(md5('7:' || o_orderkey::VARCHAR || ':0') || md5('7:' || o_orderkey::VARCHAR || ':1'),
        '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 50) AS seq FROM orders""")
def _(v):
    return v.table("orders").select(F.col("o_orderkey").alias("id"), dna.random_dna("o_orderkey", 50, 7).alias("seq"))
