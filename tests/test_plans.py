import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import genome as gn
from lociframe.operators.scorers import WeightScorer
from lociframe.plans import loci, validation

BIN = 256
RNG = random.Random(21)
MOTIF = "TTGACCGA"


@pytest.fixture(scope="module")
def world(spark):
    """Two contigs with planted motifs every 500 bases, and peaks on them."""
    text = {c: [RNG.choice("ACGT") for _ in range(30_000)] for c in ("chr1", "chr2")}
    spots = [(c, s) for c in text for s in range(1000, 29_000, 500)]
    for c, s in spots:
        text[c][s:s + len(MOTIF)] = MOTIF
    text = {c: "".join(t) for c, t in text.items()}
    genome = spark.createDataFrame([(c, b, t[b * BIN:(b + 1) * BIN]) for c, t in text.items() for b in range(-(-len(t) // BIN))],
                                   "chrom string, bin long, seq string").cache()
    return text, spots, genome, gn.contig_lengths(genome, BIN)


def scorer():
    return WeightScorer([[1.0 if b == m else -1.0 for b in "ACGT"] for m in MOTIF])


def test_lengths(world):
    assert {r["chrom"]: r["length"] for r in world[3].collect()} == {"chr1": 30_000, "chr2": 30_000}


def test_loci_with_report_and_negatives(spark, world):
    text, spots, genome, lengths = world
    peaks = spark.createDataFrame([(i, c, s - 30, s + 38, 1.0 if i % 10 else None) for i, (c, s) in enumerate(spots)]
                                  + [(900, "chrX", 5, 9, 1.0), (901, "chr1", 0, 4, None)], "id long, chrom string, start long, end long, score double")
    out = loci.extract_loci(peaks, genome, lengths, BIN, 40, negatives="gc")
    report = {r["reason"]: r["n"] for r in out["report"].collect()}
    missing = sum(i % 10 == 0 for i in range(len(spots)))
    assert report == {"bounds": 2, "score": missing, "kept": len(spots) - missing}
    for r in out["windows"].collect():
        assert r["seq"] == text[r["chrom"]][r["ws"]:r["we"]]
    assert out["gc_report"].agg(F.sum("missing")).first()[0] <= 3
    shuffled = loci.extract_loci(peaks, genome, lengths, BIN, 40, negatives="shuffle", max_sequences=20)
    assert shuffled["negatives"].count() == shuffled["windows"].count() <= 20


def test_best_windows_find_the_planted_motif(spark, world):
    text, spots, genome, lengths = world
    peaks = spark.createDataFrame([(i, c, s - 30, s + 38) for i, (c, s) in enumerate(spots)], "id long, chrom string, start long, end long")
    out = loci.best_windows(peaks, genome, lengths, BIN, scorer(), 60, len(MOTIF))
    got = {r["id"]: r for r in out["windows"].collect()}
    for i, (c, s) in enumerate(spots):
        assert got[i]["sequence"] == MOTIF and got[i]["best_peak"] == f"{c}:{s}-{s + len(MOTIF)}" and got[i]["max_score"] == len(MOTIF)
    assert min(r["bits"] for r in out["logo"].collect()) > 1.5


def test_motif_peaks_and_track(spark, world):
    text, spots, genome, lengths = world
    matrix = scorer().weights
    got = loci.motif_peaks(genome, lengths, BIN, {"m": matrix}, "m", n=4, width=200).collect()
    assert len(got) == 8 and all(r["score"] == len(MOTIF) and r["end"] - r["start"] == 200 for r in got)
    best = {(c, s) for c, s in spots} | {(c, i) for c in text for i in range(30_000) if text[c].startswith(MOTIF, i)}
    assert all((r["chrom"], r["start"] + 100 - 4) in best or r["strand"] == "-" for r in got)
    w = scorer()
    track = loci.binding_track(genome, lengths, BIN, lambda c: -w(c), len(MOTIF), 20, 10).collect()
    low = [r for r in track if r["value"] == -len(MOTIF)]
    assert {(c, s) for c, s in spots if not any(r["chrom"] == c and abs(r["start"] - s) < 25 for r in low)} == set()
    ordered = sorted((r["chrom"], r["start"], r["end"]) for r in track)
    assert all(a[2] <= b[1] for a, b in zip(ordered, ordered[1:]) if a[0] == b[0])


def test_peak_sets_tell_planted_from_shuffled_and_genomic(spark, world):
    text, spots, genome, lengths = world
    peaks = spark.createDataFrame([(i, c, s - 60, s + 60, 5.0) for i, (c, s) in enumerate(spots)], "id long, chrom string, start long, end long, score double")
    for mode in ("shuffle", "genomic"):
        few = peaks if mode == "shuffle" else peaks.where("id % 4 = 0")
        out = validation.peak_set_validation(few, genome, lengths, BIN, {"w": scorer()}, {"m": scorer().weights}, mode=mode,
                                             window=len(MOTIF), tries=60)
        auc = {r["method"]: (r["auc"], r["n_pos"] == r["n_neg"]) for r in out["summary"].collect()}
        assert set(auc) == {"w", "m"} and all(a > .95 and same for a, same in auc.values()), (mode, auc)
        assert out["negatives"].count() > 0.8 * out["positives"].count()


def test_method_comparison_and_count_benchmark(spark, world):
    text, spots, genome, lengths = world
    rows = [("P", c, s - 30, s + 38, 1 + i % 6) for i, (c, s) in enumerate(spots)]
    rows += [("N1", c, s + 150, s + 220, 1) for c, s in spots] + [("N2", c, s + 270, s + 320, 2) for c, s in spots]
    peaks = spark.createDataFrame(rows, "tf string, chrom string, start long, end long, num long")
    w = len(MOTIF)
    out = validation.method_comparison(peaks, genome, lengths, BIN, {"w": scorer()}, "P", ["N1", "N2"], width=w, n_per_tf=40)
    got = {r["neg_set"]: (r["auc"], r["n_pos"], r["n_neg"]) for r in out["summary"].collect()}
    assert set(got) == {"N1", "N2"} and all(a > .97 and p == n <= 40 for a, p, n in got.values())
    assert out["pivot"].columns == ["method", "N1", "N2"]
    bench = validation.count_benchmark(peaks, genome, lengths, BIN, {"w": scorer()}, "P", ["N1"], width=w)
    assert {r["cutoff"] for r in bench["cutoffs"].collect()} == {3, 5}
    assert bench["negatives"].first()["auc"] > .97 and bench["bins"].count() == 6


def test_variant_validation(spark, world):
    text, spots, genome, lengths = world
    peaks = spark.createDataFrame([(c, s - 20, s + 28, 2) for c, s in spots] + [(c, s - 10, s + 40, 4) for c, s in spots],
                                  "chrom string, start long, end long, num long")
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    recs = []
    for i, (c, s) in enumerate(spots):
        for pos, sig in ((s + 4, "Pathogenic"), (s + 20, "Benign"), (s + 300, "Benign"), (s + 22, "Uncertain_significance")):
            ref = text[c][pos]
            recs.append((c[3:], pos + 1, ref, [other[ref]], sig, "SO:0001583|missense_variant" if i % 9 == 0 else None, "G:1", f"rs{len(recs)}"))
    records = spark.createDataFrame(recs, "chrom string, pos long, ref string, alts array<string>, clinsig string, mc string, geneinfo string, rsid string")
    out = validation.variant_validation(peaks, records, genome, lengths, BIN, {"w": scorer()}, {"m": scorer().weights}, min_confidence=3, width=len(MOTIF))
    n = sum(i % 9 != 0 for i in range(len(spots)))
    got = {r["method"]: r for r in out["summary"].collect()}
    assert set(got) == {"w", "m"} and all((r["n_path"], r["n_benign"]) == (n, n) for r in got.values())
    assert got["w"]["median_abs_path"] == 2.0 and got["m"]["auc_abs"] > .6 and 0 <= got["m"]["mwu_p"] < .01
    assert out["variants"].where("peak_num <> 4").count() == 0
    with pytest.raises(ValueError, match="cannot be applied"):
        validation.variant_validation(peaks, records, genome, lengths, BIN, {"w": scorer()}, min_confidence=3, problem="line 1 has no 4th column")
