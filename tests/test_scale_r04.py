"""What the findings of round 4 asked for: small files and shuffles, and work by the batch."""

import random
from pathlib import Path

import numpy as np
import pytest
from lociframe import session
from lociframe.operators import effects as ef
from lociframe.operators import intervals as iv
from lociframe.operators import motifs as mo
from lociframe.operators import negatives as ng
from lociframe.operators.scorers import PairScorer
from lociframe.plans import validation
from lociframe.queries import views
from lociframe.queries.sequence_queries import positive_windows
from lociframe.sources import packed
from pyspark.sql import functions as F

WIDTH = 64


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def contig(seed, n, letters="ACGT"):
    r = random.Random(seed)
    return "".join(r.choice(letters) for _ in range(n))


def genome_of(spark, contigs):
    rows = [(c, k // WIDTH, s[k:k + WIDTH]) for c, s in contigs.items() for k in range(0, len(s), WIDTH)]
    return spark.createDataFrame(rows, "chrom string, bin long, seq string").repartition(3)


def test_a_packed_base_takes_two_bits_and_other_letters_come_back(spark, tmp_path):
    s = contig(1, 64 * 300 + 7)
    s = s[:1000] + "N" * 200 + s[1200:1300] + "RYnN" + s[1304:]
    own = packed.pack_genome(genome_of(spark, {"chr1": s}), str(tmp_path), WIDTH, slab_bins=50, halo=100)
    assert sum(f.stat().st_size for f in Path(tmp_path).iterdir()) < 0.3 * len(s)
    at = spark.createDataFrame([(k, "chr1", k) for k in range(900, 1400, 3)], "id long, chrom string, s long")
    assert all(r["b"] == s[r["s"]:r["s"] + 40].upper() for r in own.cut(at, "s", F.col("s") + 40, "b").collect())


def test_windows_are_dealt_without_where_they_stand(spark, tmp_path):
    own = packed.pack_genome(genome_of(spark, {"chr1": contig(2, 640)}), str(tmp_path), WIDTH, slab_bins=4, halo=100)
    at = spark.createDataFrame([(1, "chr1", 5)], "id long, chrom string, s long")
    above, below = plan(own.cut(at, "s", F.col("s") + 9, "b")).split("RepartitionByExpression", 1)
    assert "_packed_place" in above and "_packed" not in below


def test_what_a_stored_step_shuffled_is_removed(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = files.getAllFiles().size()
    kept = session.stored(spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).count().repartition(7, "k"))
    assert files.getAllFiles().size() <= before and kept.count() == 1000
    assert spark.conf.get(session.CLEANUP) == "false"


def test_merging_reads_the_intervals_once(spark):
    df = spark.createDataFrame([("a", 1, 5, 1), ("a", 4, 9, 2), ("a", 65_000, 70_000, 3), ("a", 69_000, 140_000, 4), (None, 3, 4, 5)], "chrom string, start long, end long, num int")
    merged = iv.merge_intervals(df)
    assert "LogicalRDD" not in plan(merged)
    assert sorted(map(tuple, merged.collect())) == [("a", 1, 9, 2), ("a", 65_000, 140_000, 4)]


def test_line_items_are_not_dealt_by_contig_and_windows_hold_what_is_asked_for(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        v = views.Views(spark, "/root/testdata/sf0.001")
        assert "BroadcastHashJoin" in v.intervals._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(positive_windows(v, 24).columns) == ["chrom", "seq", "we", "ws"]


def test_matched_regions_of_a_packed_genome_are_those_of_the_table(spark, tmp_path, monkeypatch):
    contigs = {"chr1": contig(3, 64 * 150 + 9, "ACGT" * 9 + "N"), "chr2": contig(4, 64 * 60, "ACGGCT"), "chr3_x": contig(5, 640)}
    genome = genome_of(spark, contigs)
    own = packed.pack_genome(genome, str(tmp_path), WIDTH, slab_bins=8, halo=300)
    lengths = spark.createDataFrame([(c, len(s)) for c, s in contigs.items()], "chrom string, length long")
    r = random.Random(6)
    peaks = [("chr1", a, a + r.randrange(5, 90)) for a in (r.randrange(9000) for _ in range(60))] + [("chr2", 100, 1900), ("chr3_x", 1, 50)]
    peaks += [("chr1", 9400, None), ("chr1", None, 50), (None, 3, 9)]
    excluded = iv.exclusion_set(spark.createDataFrame(peaks, "chrom string, start long, end long"), 0)
    texts = [(f"p{i}", contigs["chr1"][100 * i:100 * i + r.randrange(20, 60)]) for i in range(40)] + [("p3", contigs["chr1"][300:350]), ("at", "AT" * 20), (None, "ACGT" * 6)]
    positives = spark.createDataFrame(texts, "id string, seq string")
    seen, kept = [], session.stored
    monkeypatch.setattr(ng, "stored", lambda df: seen.append(plan(df)) or kept(df))
    out = [sorted(map(tuple, ng.matched_region_negatives(positives, g, lengths, excluded, WIDTH, longest=60).collect())) for g in (genome, own)]
    assert out[0] == out[1] and len(out[0]) > 30
    rounds = [p for p in seen if "attempt" in p]
    assert any("_near" in p for p in rounds)            # the table's
    assert sum("_near" not in p and "_m_number" in p for p in rounds) >= 2


def test_the_positives_of_a_peak_set_are_stored_once(spark, tmp_path, monkeypatch):
    own = packed.pack_genome(genome_of(spark, {"chr1": contig(7, 6400)}), str(tmp_path), WIDTH, slab_bins=8, halo=300)
    peaks = spark.createDataFrame([(f"p{i}", "chr1", 60 * i + 5, 60 * i + 55, 5.0) for i in range(40)], "id string, chrom string, start long, end long, score double")
    lengths = spark.createDataFrame([("chr1", 6400)], "chrom string, length long")
    seen, kept = [], session.stored
    monkeypatch.setattr(validation, "stored", lambda df: seen.append(df) or kept(df))
    out = validation.peak_set_validation(peaks, own, lengths, WIDTH, {"w": views.weight_scorer(24)}, max_region=100)
    assert out["scores"].count() == 80 and sum("seq" in df.columns for df in seen) == 2
    assert not any("rid" in df.columns and "seq" in df.columns for df in seen)


def test_nine_changes_of_a_pair_are_one_row_of_python(spark):
    terms = [(0, 1, 3, 2, .75), (3, 2, 0, 1, .5), (2, 2, 2, 2, .125), (1, 3, 5, 0, -1.5)]
    scorer = PairScorer(np.random.default_rng(5).integers(-8, 9, (8, 4)) / 4, terms)
    out = ef.epistasis2(spark.createDataFrame([(1, "ACGTTGCA")], "id long, seq string"), scorer)
    assert "posexplode(_change" in plan(out)
    seqs, places = ["ACGTTGCA", "acgttgca", "ACGNTGCA", "ACG"], np.array([0, 2, 3, 5, 9])
    first, second = np.triu_indices(5, 1)
    got = scorer.double_scores(seqs, places, first, second)
    for i, s in enumerate(seqs):
        for p, (a, b) in enumerate(zip(places[first], places[second])):
            for x in range(3):
                for y in range(3):
                    if max(a, b) >= len(s) or s[a] == "N" or s[b] == "N":
                        continue
                    text = list(s.upper())
                    text[a], text[b] = ("ACGT"[("ACGT".index(text[k]) + 1 + step) % 4] for k, step in ((a, x), (b, y)))
                    want = scorer.batch(["".join(text)])[0]
                    assert got[i, p, x, y] == pytest.approx(want, nan_ok=True)


def test_letters_are_counted_by_the_batch(spark):
    df = spark.createDataFrame([("a", 1, "ACG"), ("a", 1, "aNGT"), (None, 1, "T"), (None, 1, "G"), ("b", None, "N"), ("b", 2, ""), ("b", 2, None)], "m string, k int, seq string")
    out = mo.pfm(df, by=["m", "k"])
    assert "MapInArrow" in plan(out) and "posexplode" not in plan(out)
    got = {(r["m"], r["k"], r["pos"], r["base"]): (r["n"], r["prob"]) for r in out.collect()}
    assert len(got) == 4 * (4 + 1 + 1)
    assert got["a", 1, 0, "A"] == (2, 1.0) and got["a", 1, 1, "C"] == (1, 1.0) and got["a", 1, 3, "T"] == (1, 1.0) and got[None, 1, 0, "T"] == (1, .5)
    assert got["b", None, 0, "A"] == (0, None)
    wide = spark.createDataFrame([("x", "ACGT" * 500), *[(f"s{i}", "C") for i in range(50)]], "m string, seq string").coalesce(1)
    assert mo.pfm(wide, by=["m"]).where("n > 0").count() == 2050
