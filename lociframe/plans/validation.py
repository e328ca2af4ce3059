"""Validations of scorers: against negative sets, other factors, counts, and disease variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions import dna
from lociframe.functions.contigs import contig_key
from lociframe.operators import clinical as cl
from lociframe.operators import effects as ef
from lociframe.operators import evaluation as ev
from lociframe.operators import genome as gn
from lociframe.operators import intervals as iv
from lociframe.operators import motifs as mo
from lociframe.operators import negatives as ng
from lociframe.operators.scorers import PwmScorer
from lociframe.operators.sampling import sample_n, take_by_hash
from lociframe.session import stored


def variant_validation(peaks: DataFrame, records: DataFrame, genome: DataFrame, lengths: DataFrame, bin_width: int,
                       scorers: dict, matrices: dict | None = None, min_confidence: float = 1, width: int = 24,
                       problem: str | None = None, energies: DataFrame | None = None,
                       digits: int | None = None) -> dict[str, DataFrame]:
    """How well effects tell pathogenic from benign non-coding single-base variants in peaks.

    peaks: chrom, start, end, num; records: chrom, pos, ref, alts, clinsig, mc, geneinfo, rsid. scorers
    see windows of the given width; a motif (matrices) is scored as the best hit covering the variant in a
    window of 2w - 1; energies (chrom, pos, ref, alt, score) are joined as they are and keep NULLs; of several for one
    variant the least counts. Returns variants with <method>_ref, <method>_alt and <method>_dd (energy_dd for energies),
    effects (one row per variant and method, rounded to `digits` where given, so that ties are those of the rounded
    values) and summary.
    """
    merged = iv.filter_confidence(iv.merge_intervals(peaks), min_confidence, problem)
    # Cheap filters first: they leave few records for the join.
    labelled = (cl.noncoding(cl.snv_only(records), "mc", "geneinfo")
                .withColumn("label", cl.clinical_label("clinsig")).where(F.col("label").isNotNull()))
    points = labelled.withColumns({"start": F.col("pos") - 1, "end": F.col("pos"), "contig": contig_key("chrom")}).drop("chrom")
    regions = merged.withColumn("contig", contig_key("chrom"))
    inside = iv.overlap_join(points, regions, ["contig"], suffix="_peak").select(
        "chrom", "pos", "ref", "alt", "clinsig", "label", "gene", "mc", "rsid", F.col("num").alias("peak_num"))
    # A row key of its own: records may repeat, and their ids may be empty. Given once, as the table is stored.
    hits = stored(inside.withColumn("vid", F.monotonically_increasing_id()))

    def windows(w):
        return gn.variant_windows(hits, genome, lengths, w, bin_width, row_key=F.col("vid")).where("status = 'ok'")

    out, parts = hits, []

    def take(scored: DataFrame, names: Sequence[str]) -> None:
        """Effect columns for the variants, and their rows for the evaluation."""
        nonlocal out
        columns = [f"{name}_{end}" for name in names for end in ("ref", "alt", "dd")]
        kept = stored(scored.select("vid", "label", *columns))
        parts.append(ev.long_scores(kept, {name: f"{name}_dd" for name in names}, ["vid", "label"]))
        out = out.join(kept.drop("label"), "vid", "left")

    if scorers:
        take(ef.variant_effect(windows(width), scorers), list(scorers))
    for name, matrix in (matrices or {}).items():
        # Every placement in a window of 2w - 1 covers its centre, so the best one in the row is the best covering hit.
        pairs = windows(mo.window_length_at(len(matrix)))
        scored = ef.variant_effect(pairs, {name: PwmScorer(matrix)}, kind={name: "motif"})
        take(scored.withColumns({f"{name}_{end}": F.coalesce(f"{name}_{end}", F.lit(0.0)) for end in ("ref", "alt")}), [name])
    if energies is not None:
        joined = hits.join(energies.select("chrom", "pos", "ref", "alt", F.col("score").alias("energy_dd")), ["chrom", "pos", "ref", "alt"], "left")
        kept = joined.groupBy("vid", "label").agg(F.min("energy_dd").alias("energy_dd"))
        parts.append(kept.select("vid", "label", F.lit("energy").alias("method"), F.col("energy_dd").alias("score")))
        out = out.join(kept.drop("label"), "vid", "left")
    effects = parts[0]
    for part in parts[1:]:
        effects = effects.unionByName(part)
    if digits is not None:
        effects = effects.withColumn("score", F.round("score", digits))
    effects = stored(effects.withColumn("label", (F.col("label") == "pathogenic").cast("int")))
    return {"variants": out.drop("vid"), "effects": effects, "summary": ev.effect_summary(effects)}


def _windows_of(peaks: DataFrame, genome, lengths, bin_width, width, policy, n, seed) -> DataFrame:
    """Merged peaks per factor, at most n of each, cut to windows: tf, id, num, seq."""
    merged = iv.merge_intervals(peaks, by=("tf", "chrom")).withColumn(
        "id", F.concat_ws(":", "tf", "chrom", F.col("start").cast("string")))
    if n is not None:
        quotas = merged.select("tf").distinct().withColumn("quota", F.lit(n).cast("long"))
        merged = take_by_hash(merged, "id", seed, quotas, by=["tf"])
    placed = iv.center_windows(merged, width, lengths, policy)
    # Merged peaks of a factor are disjoint, so a bin holds a bounded number of windows.
    cut = gn.extract_windows(placed, genome, width, bin_width, hot_rows=None)
    return cut.where(dna.is_acgt("seq")).select("tf", "id", "num", "seq")


def _scores(rows: DataFrame, scorers: dict, keep: Sequence[str]) -> DataFrame:
    scored = rows
    for name, scorer in scorers.items():
        scored = scored.withColumn(f"_{name}", scorer(F.col("seq")))
    return ev.long_scores(scored, {name: f"_{name}" for name in scorers}, keep)


def _against(scores: DataFrame, pos_tf: str, neg_tfs: Sequence[str]) -> DataFrame:
    """Each negative factor's rows with the positive factor's rows repeated for it."""
    sets = F.when(F.col("tf") == pos_tf, F.array(*[F.lit(t) for t in neg_tfs])).otherwise(F.array("tf"))
    return (scores.where(F.col("tf").isin(pos_tf, *neg_tfs)).withColumn("neg_set", F.explode(sets))
            .withColumn("label", (F.col("tf") == pos_tf).cast("int")))


def method_comparison(peaks: DataFrame, genome: DataFrame, lengths: DataFrame, bin_width: int, scorers: dict,
                      pos_tf: str, neg_tfs: Sequence[str], n_per_tf: int | None = None, width: int = 24, seed=42,
                      least: int = 10) -> dict[str, DataFrame]:
    """AUC of every method for one factor's peaks against each other factor's, on balanced classes.

    peaks: tf, chrom, start, end, num. Returns scores, summary and pivot (methods x negative factors).
    """
    wanted = peaks.where(F.col("tf").isin(pos_tf, *neg_tfs))
    rows = _windows_of(wanted, genome, lengths, bin_width, width, "inside", n_per_tf, seed)
    scores = stored(_scores(rows, scorers, ["tf", "id", "num"]))
    summary = ev.method_auc(_against(scores, pos_tf, neg_tfs), "id", least, seed=seed)
    return {"scores": scores, "summary": summary, "pivot": ev.auc_pivot(summary, values=list(neg_tfs))}


def count_benchmark(peaks: DataFrame, genome: DataFrame, lengths: DataFrame, bin_width: int, scorers: dict, pos_tf: str,
                    neg_tfs: Sequence[str], cutoffs: Sequence[int] = (1, 3, 5, 8), width: int = 24,
                    max_sequences: int | None = None, seed=42) -> dict[str, DataFrame]:
    """Scores against peak counts: AUC per cutoff, correlations, bins, and AUC against other factors."""
    wanted = peaks.where(F.col("tf").isin(pos_tf, *neg_tfs))
    rows = _windows_of(wanted, genome, lengths, bin_width, width, "strict", max_sequences, seed)
    scores = stored(_scores(rows, scorers, ["tf", "id", "num"]))
    own = scores.where(F.col("tf") == pos_tf)
    versus = ev.method_auc(_against(scores, pos_tf, neg_tfs), "id", 1, seed=seed)
    return {"cutoffs": ev.auc_by_cutoff(own, cutoffs), "regression": ev.score_regression(own),
            "bins": ev.binned_scores(own), "negatives": versus}


def peak_set_validation(peaks: DataFrame, genome: DataFrame, lengths: DataFrame, bin_width: int, scorers: dict,
                        matrices: dict | None = None, score_min: float = 4, max_positives: int | None = None,
                        max_region: int = 2000, window: int = 24, mode: str = "shuffle", hit_threshold: float = 0.0,
                        key: str = "id", seed=42, tries: int = 200, least: int = 5,
                        margin: int = 1000) -> dict[str, DataFrame]:
    """AUC of methods for confident peaks against shuffled or length- and GC-matched regions.

    Model scorers give the best window of a region, a motif the best hit of at least hit_threshold or
    0. Genomic negatives keep `margin` bases away from all peaks. Returns positives, negatives, scores and summary.
    """
    strong = iv.filter_min_score(peaks, score_min)
    if max_positives is not None:
        strong = sample_n(strong, max_positives, key, seed)
    capped = iv.cap_region(strong.select(key, "chrom", "start", "end", "score"), max_region)
    regions = gn.extract_regions(capped, genome, bin_width, key, longest=max_region)
    positives = stored(regions.where((F.translate("seq", "ACGTN", "") == "") & (F.col("seq") != "")))
    if mode == "shuffle":
        negatives = ng.dinuc_shuffle(positives, key, 1, seed).select(key, "seq")
    elif mode == "genomic":
        excluded = iv.exclusion_set(peaks, margin)
        negatives = ng.matched_region_negatives(positives, genome, lengths, excluded, bin_width, key, seed, tries=tries, longest=max_region)
    else:
        raise ValueError(f"unknown mode {mode!r}: shuffle or genomic")
    negatives = stored(negatives)       # the positives are stored already
    both = (positives.select(F.concat(F.lit("p"), F.col(key).cast("string")).alias("rid"), F.lit(1).alias("label"), "seq")
            .unionByName(negatives.select(F.concat(F.lit("n"), F.col(key).cast("string")).alias("rid"), F.lit(0).alias("label"), "seq")))
    parts = []
    for name, scorer in scorers.items():
        best = mo.best_window(both, scorer, window, "rid")
        parts.append(best.select("rid", "label", F.lit(name).alias("method"), F.col("max_score").alias("score")))
    for name, matrix in (matrices or {}).items():
        hits = mo.scan_motifs(both, {name: matrix}, ["rid"], threshold=hit_threshold, matched=False)
        best = mo.score_per_sequence(hits, both, "rid")
        parts.append(best.join(both.select("rid", "label"), "rid").select("rid", "label", F.lit(name).alias("method"), "score"))
    scores = parts[0]
    for part in parts[1:]:
        scores = scores.unionByName(part)
    scores = stored(scores)
    summary = ev.method_auc(scores.withColumn("neg_set", F.lit(mode)), "rid", least, seed=seed)
    return {"positives": positives, "negatives": negatives, "scores": scores, "summary": summary.drop("neg_set")}
