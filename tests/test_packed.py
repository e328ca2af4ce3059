"""The packed genome gives what the table gives, without moving its bases."""

import random

import pytest
from lociframe.operators import genome as gn
from lociframe.operators import negatives as ng
from lociframe.sources import packed
from pyspark.sql import functions as F

WIDTH = 64


def bases(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("ACGTacgtN") for _ in range(n))


@pytest.fixture(scope="module")
def contigs():
    return {"chr1": bases(1, 64 * 40 + 13), "chr2": bases(2, 64 * 9), "chr3": bases(3, 20)}


@pytest.fixture(scope="module")
def genome(spark, contigs):
    rows = [(c, k // WIDTH, s[k:k + WIDTH]) for c, s in contigs.items() for k in range(0, len(s), WIDTH)]
    return spark.createDataFrame(rows, "chrom string, bin long, seq string").repartition(3)


@pytest.fixture(scope="module")
def pack(genome, tmp_path_factory):
    return packed.pack_genome(genome, str(tmp_path_factory.mktemp("genome")), WIDTH, slab_bins=4, halo=100)


def windows(spark, n, seed, width):
    r = random.Random(seed)
    rows = [(i, r.choice(["chr1", "chr1", "chr2", "chr3", "chrX", None]), r.choice([None, -1, r.randrange(2700), r.randrange(600), r.randrange(25)]), {"k": i}) for i in range(n)]
    rows += rows[:20]       # repeated rows
    return spark.createDataFrame(rows, "id long, chrom string, ws long, info map<string,int>").withColumn("we", F.col("ws") + width)


def answers(df):
    return sorted((r["id"], r["chrom"] or "", r["ws"] if r["ws"] is not None else -9, r["seq"] or "", r["info"]["k"]) for r in df.collect())


@pytest.mark.parametrize("width", [1, 24, 65, 101])
def test_windows_equal_those_of_the_table(spark, contigs, genome, pack, width):
    df = windows(spark, 300, width, width)
    got = answers(gn.extract_windows(df, pack, width, WIDTH, row_key=F.col("id")))
    assert got == answers(gn.extract_windows(df, genome, width, WIDTH, row_key=F.col("id")))
    assert any(len(g[3]) == width and g[3] == contigs[g[1]][g[2]:g[2] + width].upper() for g in got if g[3])


def test_regions_of_any_length_equal_those_of_the_table(spark, genome, pack):
    r = random.Random(8)
    rows = [(i, r.choice(["chr1", "chr2", "chrX"]), a, a + r.choice([0, 1, 30, 90, 700, 2000])) for i, a in enumerate(r.randrange(-5, 2600) for _ in range(150))]
    df = spark.createDataFrame(rows, "id long, chrom string, start long, end long")
    both = [sorted((x["id"], x["seq"] or "") for x in gn.extract_regions(df, g, WIDTH, "id").collect()) for g in (genome, pack)]
    assert both[0] == both[1]


@pytest.mark.parametrize("halo", [0, 1, 63, 64])
def test_bins_equal_the_table_with_its_halo(genome, pack, halo):
    both = [sorted((r["chrom"], r["bin"], bytes(r["bases"])) for r in gn.with_halo(g, halo, WIDTH).collect()) for g in (genome, pack)]
    assert both[0] == both[1]


def test_holes_end_runs(spark, genome, tmp_path):
    holes = genome.where(~((F.col("chrom") == "chr1") & F.col("bin").isin(3, 8, 17, 18)))
    own = packed.pack_genome(holes, str(tmp_path), WIDTH, slab_bins=4, halo=100)
    for width in (10, 65):
        df = windows(spark, 200, 5, width)
        assert answers(gn.extract_windows(df, own, width, WIDTH, row_key=F.col("id"))) == answers(gn.extract_windows(df, holes, width, WIDTH, row_key=F.col("id")))


def test_no_base_is_shuffled(spark, pack):
    plan = gn.extract_windows(windows(spark, 50, 1, 24), pack, 24, WIDTH)._jdf.queryExecution().executedPlan().toString()
    assert "bases" not in plan and "SortMergeJoin" not in plan


def test_few_variants_read_little_of_a_genome(spark, tmp_path):
    """44 variants ask for less than 1 % of 40 million bases."""
    one = "ACGT" * 2048
    big = spark.range(5000).select(F.lit("chr1").alias("chrom"), F.col("id").alias("bin"), F.lit(one).alias("seq"))
    own = packed.pack_genome(big, str(tmp_path), 8192)
    r = random.Random(2)
    variants = spark.createDataFrame([(k, "1", p, one[(p - 1) % 8192], "N") for k, p in enumerate(r.randrange(1000, 40_000_000) for _ in range(44))], "key long, chrom string, pos long, ref string, alt string")
    variants = variants.withColumn("alt", F.translate("ref", "ACGT", "CGTA"))
    lengths = gn.contig_lengths(big, 8192)
    out = gn.variant_windows(variants, own, lengths, 200, 8192)
    assert out.where("status = 'ok'").count() == 44
    placed = variants.select(F.lit("chr1").alias("chrom"), (F.col("pos") - 101).alias("ws"))
    assert packed.bytes_asked(own, placed, "ws", F.col("ws") + 200) < 0.02 * 5000 * 8192
    packed_gap, packed.GAP = packed.GAP, 0
    try:
        assert packed.bytes_asked(own, placed, "ws", F.col("ws") + 200) < 0.01 * 5000 * 8192
    finally:
        packed.GAP = packed_gap


def test_negatives_equal_those_of_the_table(spark, genome, pack, rows):
    df = spark.createDataFrame([(i, "chr1", 64 * i + 5) for i in range(0, 12, 3)], "id long, chrom string, ws long").withColumn("we", F.col("ws") + 8)
    out = []
    for g in (genome, pack):
        positives = gn.extract_windows(df, genome, 8, WIDTH).where("seq is not null")
        peaks = df.select("chrom", F.col("ws").alias("start"), F.col("we").alias("end"))
        negatives, report = ng.gc_matched_negatives(g, positives, peaks, 8, WIDTH)
        out.append((rows(negatives, "chrom", "start", "seq"), rows(report, "gc_bin", "wanted", "found")))
    assert out[0] == out[1] and out[0][0]


def test_all_bins_are_read_by_several_tasks(spark, pack):
    """The runs are some small rows, which adaptive execution would read in one task."""
    tasks = gn.with_halo(pack, 10, WIDTH).select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks == min(pack.runs.count(), spark.sparkContext.defaultParallelism) > 1


def test_no_region_of_a_packed_genome_is_joined_with_its_table(spark, pack):
    df = spark.createDataFrame([("a", "chr1", 3, 40), ("b", "chr1", 5, 900)], "id string, chrom string, start long, end long")
    plan = gn.extract_regions(df, pack, WIDTH, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "bin#" in plan and "ExistingRDD[chrom" not in plan.replace("ExistingRDD[id", "") and "_bases" not in plan


def test_bases_are_made_after_the_bins_are_dealt(spark, tmp_path, monkeypatch):
    """The packed genome of the driver's tables and their variants move no bases and need no table of them."""
    from lociframe.queries import views
    v = views.Views(spark, "/root/testdata/sf0.001")
    plans, kept = [], packed.stored
    monkeypatch.setattr(packed, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    made = packed.pack_genome(v._bins(), str(tmp_path / "made"), views.BIN, bases=views._bin_bases())
    above, below = plans[0].split("Repartition", 1)
    assert "md5" in above and "md5" not in below
    plain = packed.pack_genome(v._genome(), str(tmp_path / "plain"), views.BIN)
    for halo in (0, 9):
        assert sorted(map(tuple, made.bins(halo).collect())) == sorted(map(tuple, plain.bins(halo).collect()))
    monkeypatch.setattr(views, "stored", lambda df: pytest.fail("the genome is stored"))
    at = v.variants.where("key % 11 <> 0").select("key", "chrom", "ref", (F.col("pos") - 1).alias("s"))
    found = plain.cut(at, "s", F.col("s") + 1, "b")
    assert found.where("b = ref").count() == found.count() > 0
    assert made.runs.select("file").distinct().count() > 1
