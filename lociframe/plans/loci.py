"""Loci, best windows, tracks and motif peaks of a genome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.functions import dna
from lociframe.operators import genome as gn
from lociframe.operators import intervals as iv
from lociframe.operators import motifs as mo
from lociframe.operators import negatives as ng
from lociframe.operators.sampling import sample_n
from lociframe.operators.scorers import Scorer
from lociframe.operators.tracks import best_spaced, window_minima
from lociframe.session import stored
from lociframe.sources.packed import PackedGenome


def extract_loci(peaks: DataFrame, genome: DataFrame, lengths: DataFrame, bin_width: int, width: int = 200,
                 max_sequences: int | None = None, score: str | None = "score", negatives: str | None = None,
                 variants: DataFrame | None = None, key: str = "id", seed=42) -> dict[str, DataFrame]:
    """Windows of one width around peaks, with a report of what was left out and why.

    Returns windows and report; negatives and gc_report for negatives = "gc", negatives for
    "shuffle"; variants (windows with a status) for a table of parsed variants.
    """
    chosen = peaks if max_sequences is None else sample_n(peaks, max_sequences, key, seed)
    placed = iv.center_windows(chosen, width, lengths, keep_all=True)
    cut = gn.extract_windows(placed, genome, width, bin_width, row_key=F.col(key))
    # Read for the windows, the report and the negatives.
    judged = stored(iv.filter_reason(cut, score))
    out = {
        "windows": judged.where("reason is null").drop("reason", "in_bounds"),
        "report": judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n")),
    }
    if negatives == "gc":
        out["negatives"], out["gc_report"] = ng.gc_matched_negatives(genome, out["windows"], peaks, width, bin_width, seed)
    elif negatives == "shuffle":
        out["negatives"] = ng.dinuc_shuffle(out["windows"], key, 1, seed)
    if variants is not None:
        out["variants"] = gn.variant_windows(variants, genome, lengths, width, bin_width)
    return out


def best_windows(peaks: DataFrame, genome: DataFrame, lengths: DataFrame, bin_width: int, scorer, in_window: int,
                 width: int, key: str = "id") -> dict[str, DataFrame]:
    """The best window of each peak with its genomic position, and the information matrix of those windows."""
    placed = iv.center_windows(peaks, in_window, lengths, "odd" if in_window % 2 else "strict")
    cut = gn.extract_windows(placed, genome, in_window, bin_width, row_key=F.col(key)).where(F.col("seq").isNotNull())
    best = mo.best_window(cut, scorer, width, key)
    located = stored(iv.locate_best(best, in_window, width).select(
        key, "chrom", "start", "end", "best_peak", F.col("best_seq").alias("sequence"), "max_score", "mean_score"))
    logo = mo.information(mo.pfm(located.where(F.col("sequence").isNotNull()), "sequence"), pseudocount=1.0)
    return {"windows": located, "logo": logo}


def binding_track(genome: DataFrame, lengths: DataFrame, bin_width: int, scorer, placed: int, width: int,
                  step: int) -> DataFrame:
    """A track of the lowest placement score per window, over whole contigs.

    Every placement is scored once, though windows overlap. A batch scorer works inside the scan of the genome, without a row per
    placement; a scorer that is only a Column expression, or windows wider than a bin or the packed halo, go through window_min.
    """
    reach = genome.halo if isinstance(genome, PackedGenome) else bin_width
    if isinstance(scorer, Scorer) and width - 1 <= reach:
        return iv.track_intervals(window_minima(gn.with_halo(genome, width - 1, bin_width), scorer, placed, width, step, bin_width),
                                  lengths, width, step)
    bins = gn.with_halo(genome, placed - 1, bin_width).withColumn("bases", F.col("bases").cast("string"))
    tiles = dna.tile(bins, "bases", placed, skip_n=False)
    placements = tiles.select("chrom", (F.col("bin") * bin_width + F.col("win_start")).alias("pos"),
                              scorer(F.col("win")).alias("energy"))
    ends = lengths.select("chrom", F.col("length").alias("region_end"))
    return iv.track_intervals(iv.window_min(placements, width, placed, step, ends=ends), lengths, width, step)


def motif_peaks(genome: DataFrame, lengths: DataFrame, bin_width: int, matrices: dict, name: str, n: int = 4,
                width: int = 200) -> DataFrame:
    """BED rows of the n best hits of a motif per contig, at least one width apart and away from the ends."""
    w = len(matrices[name])
    best = best_spaced(gn.with_halo(genome, w - 1, bin_width), matrices[name], n, width, bin_width, width // 2 + 1, lengths)
    centre = F.col("pos") + w // 2
    return best.select("chrom", (centre - width // 2).alias("start"), (centre + width // 2).alias("end"),
                       F.concat(F.lit(f"{name}_hit_"), F.col("pos").cast("string")).alias("name"),
                       F.round("score", 2).alias("score"), "strand")
