import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lociframe.functions import dna
from lociframe.operators import genome as gn
from lociframe.operators import negatives as ng

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(expr.alias("x")).first()["x"]


def test_scalar_functions(spark):
    assert one(spark, dna.revcomp("s"), s="AACGn") == "nCGTT"
    assert one(spark, dna.gc_content("s"), s="") == 0.0
    assert one(spark, dna.gc_content("s"), s="GATN") == 0.25
    assert one(spark, dna.one_hot("s"), s="aN") == [1, 0, 0, 0, 0, 0, 0, 0]
    assert one(spark, dna.from_one_hot(dna.one_hot("s")), s="GATTACA") == "GATTACA"
    assert one(spark, dna.pad_n("s", 6), s="ACG") == "ACGNNN"
    assert one(spark, dna.pad_n("s", 2), s="ACG") == "ACG"
    assert one(spark, dna.center_trim("s", 3), s="AACGTT") == "ACG"
    assert one(spark, dna.center_trim("s", 9), s="AACGTT") is None
    assert one(spark, dna.substitute("s", 2, F.lit("GT"), F.lit("AA")), s="ACGTC") == "ACAAC"
    assert one(spark, dna.insert_motif("s", "gg"), s="AAAAA") == "AGGAA"
    assert one(spark, dna.insert_motif("s", "gg", 4), s="AAAAA") is None
    assert one(spark, dna.add_context("s", "CA", "TT", 6), s="GG") == "CAGGTT"
    for bad in ("GN", "GGG"):
        with pytest.raises(Exception, match="letters other|length is not"):
            one(spark, dna.add_context("s", "CA", "TT", 6), s=bad)


def test_expand_n_gives_every_sequence_once(spark):
    got = [r["expanded"] for r in dna.expand_n(spark.createDataFrame([("NANN",)], "s string"), "s").collect()]
    assert sorted(got) == sorted("".join((a, "A", b, c)) for a, b, c in itertools.product("ACGT", repeat=3))
    assert dna.expand_n(spark.createDataFrame([("acgt",)], "s string"), "s").collect()[0]["expanded"] == "ACGT"


@pytest.mark.parametrize("width, step", [(3, 1), (5, 4), (700, 7), (20, 25)])
def test_tiles_equal_a_loop_over_chunk_borders(spark, width, step):
    rng = random.Random(width)
    seqs = ["".join(rng.choice("ACGTN" if rng.random() < 0.05 else "ACGT") for _ in range(n)) for n in (0, 2, 5, 699, 1500, 20000)]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    got = sorted((r["id"], r["win_start"], r["win"]) for r in dna.tile(df, "seq", width, step).collect())
    want = [(i, k, s[k:k + width]) for i, s in enumerate(seqs) for k in range(0, len(s) - width + 1, step)
            if not set(s[k:k + width]) - set("ACGT")]
    assert got == want


def test_validation_names_the_first_offender(spark):
    df = spark.createDataFrame([(1, "ACG"), (2, "acgt"), (3, ""), (4, "ANG")], "id int, seq string")
    row = dna.validate_dna(df, "id").first()
    assert (row["n_bad"], row["first_bad"], row["one_length"]) == (2, 3, False)


def test_substitutions_of_both_strands(spark):
    df = spark.createDataFrame([([(1, "A"), (2, "C")], [(3, "G"), (4, "T")], "AG"), ([(1, "A"), (2, "C")], [(3, "G"), (4, "T")], "AC")],
                               "f array<struct<resnum:int,base:string>>, r array<struct<resnum:int,base:string>>, t string")
    got = [x["m"] for x in df.select(dna.duplex_substitutions("f", F.lit("B"), "r", F.lit("C"), "t").alias("m")).collect()]
    assert got == ["cB2g,gC3c;", None]


@pytest.fixture(scope="module")
def small_genome(spark):
    rng = random.Random(3)
    text = {"chr1": "".join(rng.choice("ACGT") for _ in range(300)), "chr2": "".join(rng.choice("ACGT") for _ in range(77))}
    text["chr1"] = text["chr1"][:150] + "N" + text["chr1"][151:]
    bins = [(c, b, s[b * 32:(b + 1) * 32].lower()) for c, s in text.items() for b in range(-(-len(s) // 32))]
    return text, spark.createDataFrame(bins, "chrom string, bin long, seq string")


def test_extraction_equals_slicing(spark, small_genome):
    text, genome = small_genome
    places = [(i, c, s) for i, (c, s) in enumerate((c, s) for c in ("chr1", "chr2", "chrX") for s in range(-3, 310, 7))]
    df = spark.createDataFrame(places, "id long, chrom string, ws long")
    for hot in (None, 2):
        got = {r["id"]: r["seq"] for r in gn.extract_windows(df, genome, 21, 32, row_key=F.col("id"), hot_rows=hot).collect()}
        for i, c, s in places:
            want = text.get(c, "")[s:s + 21] if s >= 0 else ""
            assert got[i] == (want if len(want) == 21 else None)
    regions = [(i, c, s, s + n) for i, (c, s, n) in enumerate((c, s, n) for c in ("chr1", "chr2") for s in (0, 5, 60) for n in (1, 30, 100))]
    got = {r["id"]: r["seq"] for r in gn.extract_regions(spark.createDataFrame(regions, "id long, chrom string, start long, end long"), genome, 32, "id").collect()}
    assert got == {i: text[c][s:e] if e <= len(text[c]) else None for i, c, s, e in regions}


def test_variant_statuses(spark, small_genome):
    text, genome = small_genome
    s = text["chr1"]
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}

    def snv(pos, chrom="chr1"):
        return f"{chrom}:{pos}:{s[pos - 1]}>{other[s[pos - 1]]}"
    cases = {snv(100): "ok", snv(100, "1"): "ok", f"chr1:100:{other[s[99]]}>{s[99]}": "ref_mismatch", f"chr1:100:{s[99]}>AA": "unsupported",
             snv(3): "out_of_bounds", snv(100, "chr9"): "unknown_chrom", "chr1-100-A-C": "invalid", "chr1:1x:A>C": "invalid",
             f"chr1:100:{s[99]}>N": "invalid", snv(145): "contains_n", snv(298): "out_of_bounds"}
    df = gn.parse_variants(spark.createDataFrame([(t,) for t in cases], "variant string"))
    lengths = spark.createDataFrame([(c, len(t)) for c, t in text.items()], "chrom string, length long")
    got = {r["variant"]: r for r in gn.variant_windows(df, genome, lengths, 20, 32, row_key=F.col("variant")).collect()}
    assert {k: r["status"] for k, r in got.items()} == cases
    ok = got[snv(100)]
    assert ok["ref_window"] == s[89:109] and ok["alt_window"] == s[89:99] + other[s[99]] + s[100:109]
    assert all((r["ref_window"] is None) == (r["status"] != "ok") for r in got.values())


def dinucs(s):
    return Counter(zip(s, s[1:]))


def test_shuffles_keep_pairs_and_ends(spark):
    rng = random.Random(1)
    seqs = [(i, "".join(rng.choice("ACGTN" if i % 5 == 0 else "ACGT") for _ in range(rng.randrange(1, 200)))) for i in range(60)]
    df = spark.createDataFrame(seqs, "id long, seq string")
    got = sorted((r["id"], r["shuffle"], r["seq"]) for r in ng.dinuc_shuffle(df, "id", 3).collect())
    again = sorted((r["id"], r["shuffle"], r["seq"]) for r in ng.dinuc_shuffle(df.repartition(7), "id", 3).collect())
    assert got == again
    for i, _, s in got:
        assert dinucs(s) == dinucs(seqs[i][1]) and s[0] == seqs[i][1][0] and s[-1] == seqs[i][1][-1]
    assert sum(s != seqs[i][1] for i, _, s in got) > 120


def test_gc_matched_negatives_hold_their_contract(spark):
    rng = random.Random(2)
    text = {c: "".join(rng.choice("GGCAT" if (k // 400) % 2 else "AATCG") for k in range(30_000)) for c in ("chr1", "chr2", "chr3")}
    genome = spark.createDataFrame([(c, b, s[b * 512:(b + 1) * 512]) for c, s in text.items() for b in range(-(-len(s) // 512))],
                                   "chrom string, bin long, seq string")
    spots = [(c, s) for c in ("chr1", "chr2") for s in range(1000, 29_000, 700)]
    peaks = spark.createDataFrame([(c, s - 20, s + 60) for c, s in spots], "chrom string, start long, end long")
    pos = spark.createDataFrame([(c, s, s + 40, text[c][s:s + 40]) for c, s in spots], "chrom string, ws long, we long, seq string")
    picked, report = ng.gc_matched_negatives(genome, pos, peaks, 40, 512, seed=5)
    rows = sorted((r["chrom"], r["start"], r["end"], r["seq"]) for r in picked.collect())
    assert rows == sorted((r["chrom"], r["start"], r["end"], r["seq"]) for r in ng.gc_matched_negatives(
        genome.repartition(5), pos, peaks, 40, 512, seed=5)[0].collect())
    assert all(text[c][s:e] == q and e - s == 40 and c != "chr3" for c, s, e, q in rows)
    assert all(e1 <= s2 for (c1, _, e1, _), (c2, s2, _, _) in zip(rows, rows[1:]) if c1 == c2)
    assert not any(c == c2 and s < p + 100 and p - 60 < e for c, s, e, _ in rows for c2, p in spots)

    def gc_bins(seqs):
        return Counter(min(int((q.count("G") + q.count("C")) / 40 / 0.05 + 1e-9), 19) for q in seqs)
    want, found = gc_bins(text[c][s:s + 40] for c, s in spots), gc_bins(q for *_, q in rows)
    for r in report.collect():
        assert (r["wanted"], r["found"]) == (want[r["gc_bin"]], found[r["gc_bin"]])
        assert r["missing"] == r["wanted"] - r["found"] >= 0
    assert sum(found.values()) > 0.8 * len(spots)


def test_matched_regions_hold_their_contract(spark, small_genome):
    rng = random.Random(6)
    text = "".join(rng.choice("ACGT") for _ in range(20_000))
    genome = spark.createDataFrame([("chr1", b, text[b * 512:(b + 1) * 512]) for b in range(40)] + [("chr1_alt", 0, text[:512])],
                                   "chrom string, bin long, seq string")
    lengths = spark.createDataFrame([("chr1", 20_000), ("chr1_alt", 512)], "chrom string, length long")
    pos = spark.createDataFrame([(i, text[i * 300:i * 300 + 50 + i]) for i in range(20)], "id long, seq string")
    excluded = spark.createDataFrame([("chr1", 0, 6000)], "chrom string, start long, end long")
    got = ng.matched_region_negatives(pos, genome, lengths, excluded, 512, tries=30, first_tries=2).collect()
    at_once = ng.matched_region_negatives(pos, genome, lengths, excluded, 512, tries=30, first_tries=30).collect()
    assert sorted(got) == sorted(at_once)
    assert len(got) == 20
    for r in got:
        assert r["chrom"] == "chr1" and r["start"] >= 6000 and r["end"] - r["start"] == 50 + r["id"]
        assert r["seq"] == text[r["start"]:r["end"]]
        gc = (r["seq"].count("G") + r["seq"].count("C")) / len(r["seq"])
        assert r["gc_ok"] == (abs(gc - r["target_gc"]) <= 0.05)
    assert sum(r["gc_ok"] for r in got) >= 19


def test_random_and_filled_sequences(spark):
    rows = ng.random_sequences(spark, 200, 70, 1).collect()
    assert all(len(r["seq"]) == 70 and not set(r["seq"]) - set("ACGT") for r in rows) and len({r["seq"] for r in rows}) == 200
    got = one(spark, dna.fill_n("s", F.lit(1), 2), s="NANNT")
    assert got[1] == "A" and got[4] == "T" and not set(got) - set("ACGT")


def test_windows_wider_than_a_bin_and_repeated_regions(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(500))
    genome = spark.createDataFrame([("c", b, text[b * 64:(b + 1) * 64]) for b in range(8)], "chrom string, bin long, seq string")
    starts = [0, 1, 63, 64, 200, 430, 431, -1]
    df = spark.createDataFrame([(i, "c", s) for i, s in enumerate(starts)] + [(0, "c", 0)], "id long, chrom string, ws long")
    got = sorted((r["id"], r["seq"]) for r in gn.extract_windows(df, genome, 70, 64).collect())
    want = sorted([(i, text[s:s + 70] if 0 <= s and s + 70 <= 500 else None) for i, s in enumerate(starts)] + [(0, text[:70])])
    assert got == want
    regions = [(1, "c", 10, 200), (1, "c", 10, 200), (1, "c", 300, 310), (2, "c", 490, 510)]
    out = gn.extract_regions(spark.createDataFrame(regions, "id long, chrom string, start long, end long"), genome, 64, "id")
    assert sorted((r["id"], r["start"], r["seq"] or "") for r in out.collect()) == [(1, 10, text[10:200]), (1, 10, text[10:200]), (1, 300, text[300:310]), (2, 490, "")]


def test_shuffles_are_uniform_over_all_walks():
    """Every text with the ends and the pairs of a short one is as likely as any other."""
    from collections import Counter
    from itertools import permutations

    import numpy as np
    from lociframe.operators.negatives import euler_shuffles

    def pairs(t):
        return sorted(zip(t, t[1:]))
    for word in ("ACAGATAC", "AACGACGTA", "GATTACAGAT"):
        walks = {"".join(p) for p in permutations(word) if p[0] == word[0] and p[-1] == word[-1] and pairs("".join(p)) == pairs(word)}
        n = 400 * len(walks)
        got = Counter(euler_shuffles([word] * n, np.arange(n, dtype=np.uint64) * np.uint64(977)))
        assert set(got) == walks
        chi = sum((c - 400) ** 2 / 400 for c in got.values())
        assert chi < len(walks) + 5 * (2 * len(walks)) ** 0.5 + 5, (word, chi)


def test_a_shuffle_depends_on_its_code_alone():
    import random

    import numpy as np
    from lociframe.operators.negatives import euler_shuffles
    r = random.Random(6)
    texts = ["".join(r.choice("ACGTNé日") for _ in range(r.randint(0, 200))) for _ in range(80)] + ["", "A", "AC", "AAAA", "ACGT" * 500]
    codes = np.array([r.getrandbits(64) for _ in texts], np.uint64)
    whole = euler_shuffles(texts, codes)
    assert whole == [euler_shuffles([t], codes[i:i + 1])[0] for i, t in enumerate(texts)]
    for a, b in zip(texts, whole):
        assert sorted(zip(a, a[1:])) == sorted(zip(b, b[1:])) and a[:1] == b[:1] and a[-1:] == b[-1:]
    assert sum(a != b for a, b in zip(texts, whole)) > 70


def test_shuffles_of_many_letters_and_of_long_texts_walked_alone():
    import numpy as np
    from lociframe.operators.negatives import euler_shuffles
    r = random.Random(8)
    wide = "".join(chr(0x4E00 + r.randrange(6000)) for _ in range(20_000))
    texts = [wide, "ACGT" * 9, "".join(r.choice("ACGT") for _ in range(30_000)), wide[:9_000], "ACGGTCA"]
    codes = np.arange(5, dtype=np.uint64) * np.uint64(977)
    whole = euler_shuffles(texts, codes)
    assert whole == [euler_shuffles([t], codes[i:i + 1])[0] for i, t in enumerate(texts)] and whole[2] != texts[2]
    for a, b in zip(texts, whole):
        assert sorted(zip(a, a[1:])) == sorted(zip(b, b[1:])) and a[0] == b[0] and a[-1] == b[-1]


def test_a_letter_of_a_shuffle_costs_one_short_sort():
    """Each text's edges are sorted once, in rows; a sort of all letters of a batch, once per draw, took some ten times as long."""
    import time

    import numpy as np
    from lociframe.operators.negatives import euler_shuffles
    r = random.Random(9)
    texts, codes = ["".join(r.choices("ACGT", k=32)) for _ in range(30_000)], np.arange(30_000, dtype=np.uint64)
    t0 = time.process_time()
    euler_shuffles(texts, codes)
    took, t0 = time.process_time() - t0, time.process_time()
    np.lexsort((np.arange(960_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.repeat(np.arange(120_000), 8)))
    assert took < 4 * (time.process_time() - t0)


def test_templates_of_unknown_size_are_not_broadcast(spark):
    from lociframe.queries import QUERIES
    plan = QUERIES["substitution_list"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_regions_of_known_length_are_cut_in_one_pass(spark, tmp_path):
    from lociframe.sources.packed import pack_genome
    genome = spark.createDataFrame([("chr1", b, "ACGGT" * 102 + "AC") for b in range(6)], "chrom string, bin long, seq string")
    packed = pack_genome(genome, str(tmp_path / "genome"), 512, slab_bins=8, halo=1024)
    df = spark.createDataFrame([(i, "chr1", 37 * i, 37 * i + n) for i, n in enumerate([0, 1, 300, 600, 5, -4])], "id long, chrom string, start long, end long")
    once = gn.extract_regions(df, packed, 512, "id", longest=600)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, gn.extract_regions(df, packed, 512, "id").select(*once.columns).collect()))
    assert "Union" not in once._jdf.queryExecution().toString()


def test_negatives_are_drawn_from_the_gaps(spark, tmp_path, monkeypatch):
    """The free windows of one contig-wide merged interval and of many small ones, without a scan of the genome or a broadcast of lists."""
    from lociframe.sources.packed import PackedGenome, pack_genome
    width, size, seed = 7, 64, 3
    blocks = [(-20, 5), (40, 41), (55, 63), (64, 300), (310, 317), (318, 324), (630, 700)]
    blocked = spark.createDataFrame([("c", a, b) for a, b in blocks], "chrom string, start long, end long")
    bins = spark.createDataFrame([("c", b) for b in range(10)] + [("d", 0)], "chrom string, bin long")
    for shift in range(0, width, 3):
        out = gn.free_windows(bins, blocked, width, size, seed, shift)
        got = sorted(tuple(r) for r in out.collect())
        at = {c: (int(__import__("hashlib").md5(f"{seed}:{c}".encode()).hexdigest()[:8], 16) + shift) % width for c in "cd"}
        want = [("c", s, s + width) for s in range(640) if s % width == at["c"] and not any(a < s + width and b > s for a, b in blocks)]
        assert got == want + [("d", s, s + width) for s in range(size) if s % width == at["d"]]
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().toString()
    text = "".join(random.Random(4).choice("ACGT") for _ in range(5120))
    packed = pack_genome(spark.createDataFrame([("c", b, text[b * 512:(b + 1) * 512]) for b in range(10)], "chrom string, bin long, seq string"),
                         str(tmp_path / "genome"), 512, slab_bins=8, halo=1024)
    monkeypatch.setattr(PackedGenome, "bins", lambda *_: pytest.fail("the whole genome is read"))
    pos = spark.createDataFrame([("c", 100, 120, text[100:120])], "chrom string, ws long, we long, seq string")
    peaks = spark.createDataFrame([("c", 90, 4000)], "chrom string, start long, end long")
    picked, _ = ng.gc_matched_negatives(packed, pos, peaks, 20, 512)
    assert [(r["seq"], r["end"] - r["start"]) for r in picked.collect()] == [(text[r["start"]:r["end"]], 20) for r in picked.collect()] and picked.count() == 1


def test_draws_move_no_row_by_its_group(spark):
    """The cut of a group is one row: neither the hashes nor the rows are shuffled by the few groups."""
    from lociframe.operators.sampling import take_by_hash
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(4000).withColumn("g", F.col("id") % 2)
        quotas = spark.createDataFrame([(0, 10), (1, 700)], "g long, quota long")
        out = take_by_hash(df, "id", 3, quotas, by=["g"])
        plan = out._jdf.queryExecution().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(g" not in plan
        assert {r["g"]: r["count"] for r in out.groupBy("g").count().collect()} == {0: 10, 1: 700}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
