"""Interval operators. Intervals are chrom, start, end with 0-based half-open coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.joins import HOT_ROWS, grid_join, join_few, spread_join
from lociframe.session import stored

MERGE_BITS = 16   # merge bins of 65,536 bp
JOIN_BITS = 14    # overlap bins of 16,384 bp


def _bin(col, bits: int) -> Column:
    """Floor division by 2^bits, exact for every long, negative ones included."""
    col = F.col(col) if isinstance(col, str) else col
    return F.shiftright(col.cast("long"), bits)


def _half(col) -> Column:
    return F.shiftright(col.cast("long"), 1)


def midpoint() -> Column:
    return F.col("start") + _half(F.col("end") - F.col("start"))


def merge_intervals(df: DataFrame, by: Sequence[str] = ("chrom",), value: str | None = "num",
                    bits: int = MERGE_BITS) -> DataFrame:
    """Merge overlapping and book-ended intervals, keeping the largest value of each group.

    Two levels, so that no task ever holds a whole contig. Copies of one start are
    reduced to the longest (map side); the rest are merged inside fixed bins, where a window sees
    at most 2^bits rows; then one row per bin carries the furthest end and the start of the group
    that reaches it across the bin borders, and the islands that touch the carried end take
    that start.
    """
    by = list(by)
    best = [F.max(value).alias(value)] if value else []
    starts = (df.groupBy(*by, F.col("start").cast("long").alias("start"))
              .agg(F.max(F.col("end").cast("long")).alias("end"), *best)
              .withColumn("_bin", _bin("start", bits)))

    inside = Window.partitionBy(*by, "_bin").orderBy("start")
    reach = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    islands = (starts
               .withColumn("_opens", F.when(F.col("start") <= reach, 0).otherwise(1))
               .withColumn("_island", F.sum("_opens").over(inside))
               .groupBy(*by, "_bin", "_island")
               .agg(F.min("start").alias("start"), F.max("end").alias("end"), *best))
    islands = stored(islands.select(*by, "_bin", "start", "end", *([value] if value else [])))   # read twice below; else all intervals would be shuffled for both

    across = Window.partitionBy(*by).orderBy("_bin")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    bins = (islands.groupBy(*by, "_bin")
            .agg(F.max("end").alias("_bin_end"), F.max("start").alias("_last"))
            .withColumn("_carry", F.max("_bin_end").over(earlier))
            .withColumn("_opened", F.when(F.col("_carry").isNull() | (F.col("_last") > F.col("_carry")),
                                          F.col("_last")))
            .withColumn("_anchor", F.last("_opened", ignorenulls=True).over(earlier))
            .select(*by, "_bin", "_carry", "_anchor"))

    group = F.when(F.col("start") <= F.col("_carry"), F.col("_anchor")).otherwise(F.col("start"))
    return (islands.join(bins, [*by, "_bin"])
            .withColumn("_group", group)
            .groupBy(*by, "_group")
            .agg(F.min("start").alias("start"), F.max("end").alias("end"), *best)
            .drop("_group"))


def filter_confidence(merged: DataFrame, minimum: float, problem: str | None = None) -> DataFrame:
    """Merged intervals with num >= minimum.

    problem is what read_peaks says about a count column that is not numeric; with a minimum above
    1 it is an error, because the threshold could not be applied.
    """
    if minimum > 1 and problem:
        raise ValueError(f"peak confidence >= {minimum:g} cannot be applied: {problem}")
    return merged.where(F.col("num") >= minimum)


def exclusion_set(df: DataFrame, pad: int, clip: bool = True) -> DataFrame:
    """Intervals widened by pad on both sides and merged; start is kept at 0 or above when clip."""
    start = F.col("start") - pad
    padded = df.select("chrom", (F.greatest(F.lit(0).cast("long"), start) if clip else start)
                       .alias("start"), (F.col("end") + pad).alias("end"))
    return merge_intervals(padded, value=None)


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str] = ("chrom",),
                 suffix: str = "_right", bits: int = JOIN_BITS,
                 row_key: Column | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """All pairs of overlapping rows of two interval tables.

    Both sides are repeated for the bins they touch and joined on (keys, bin); a pair is kept only
    in the bin of the larger start, so it appears once. Bins with many rows on either side are cut on that side.
    Right columns other than the keys get the suffix where the names clash.
    """
    on = list(on)
    clash = [c for c in right.columns if c in left.columns and c not in on]
    right = right.withColumnsRenamed({c: c + suffix for c in clash})
    r_start, r_end = (c + suffix if c in clash else c for c in ("start", "end"))

    def binned(df, start, end):
        last = F.greatest(F.col(start), F.col(end) - 1)
        return df.withColumn("_bin", F.explode(F.sequence(_bin(start, bits), _bin(last, bits))))

    pairs = grid_join(binned(left, "start", "end"), binned(right, r_start, r_end), [*on, "_bin"],
                      left_key=row_key, hot_rows=hot_rows)
    return pairs.where(
        (F.col("start") < F.col(r_end)) & (F.col(r_start) < F.col("end"))
        & (F.col("_bin") == _bin(F.greatest("start", r_start), bits))).drop("_bin")


def interval_index(merged: DataFrame, reach: int, bits: int = JOIN_BITS) -> DataFrame:
    """One row per (chrom, bin) with the disjoint intervals an interval starting there can touch, in order.

    reach is the longest such interval. The intervals must not overlap each other (merge_intervals),
    so a list holds at most (2^bits + reach) entries.
    """
    first = _bin(F.col("start") - reach, bits)
    last = _bin(F.greatest(F.col("start"), F.col("end") - 1), bits)
    return (merged.select("chrom", "start", "end", F.explode(F.sequence(first, last)).alias("_bin"))
            .groupBy("chrom", "_bin")
            .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_near")))


def touches(near: str, start: str, end: str) -> Column:
    """Whether [start, end) touches one of the disjoint intervals of a sorted list; a missing list has none.

    A binary search counts the intervals that start before `end`; the last of them ends last, so it alone is looked at.
    """
    halvings = F.sequence(F.length(F.bin(F.size(near).cast("long"))) - 1, F.lit(0), F.lit(-1))
    before = F.aggregate(halvings, F.lit(0), lambda n, k: F.when(
        F.get(near, n + F.call_function("shiftleft", F.lit(1), k) - 1)["start"] < F.col(end),
        n + F.call_function("shiftleft", F.lit(1), k)).otherwise(n))
    return F.col(near).isNotNull() & F.coalesce(F.get(near, before - 1)["end"] > F.col(start), F.lit(False))


def exclude_overlaps(df: DataFrame, excluded: DataFrame, longest: int | None = None,
                     bits: int = JOIN_BITS, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Rows of df that touch none of the excluded intervals (disjoint, as exclusion_set returns).

    Each row searches one list, that of its start's bin, so no pairs are produced. longest is the
    length no row exceeds, where the caller knows it; without it, rows longer than a bin are
    checked piece by piece.
    """
    reach = longest or 1 << bits
    if longest:      # small bins, and so short lists, for short rows
        bits = min(bits, max(8, int(longest).bit_length() + 2))
    index = interval_index(excluded, reach, bits)
    cols = df.columns
    width = F.col("end") - F.col("start")

    def hits(rows, start, end):
        looked = spread_join(rows.withColumn("_bin", _bin(start, bits)), index, ["chrom", "_bin"],
                             "left", hot_rows=hot_rows)
        return looked.withColumn("_hit", touches("_near", start, end)).drop("_near", "_bin")

    if longest:
        return hits(df, "start", "end").where(~F.col("_hit")).select(*cols)
    narrow = hits(df.where(width <= reach), "start", "end").where(~F.col("_hit")).select(*cols)
    pieces = F.ceil(width / reach).cast("long")
    wide = (df.where(width > reach).withColumn("_n", pieces)
            .withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
            .withColumn("_from", F.col("start") + F.col("_piece") * reach)
            .withColumn("_to", F.least(F.col("end"), F.col("_from") + reach)))
    clean = (hits(wide, "_from", "_to").groupBy(*cols, "_n")
             .agg(F.max("_hit").alias("_hit"), F.count(F.lit(1)).alias("_rows"))
             .where(~F.col("_hit"))
             .withColumn("_copy", F.explode(F.expr("sequence(1, _rows div _n)")))
             .select(*cols))
    return narrow.unionByName(clean)


def center_windows(df: DataFrame, width: int, lengths: DataFrame, policy: str = "inside",
                   keep_all: bool = False) -> DataFrame:
    """Windows of one width centred on the interval midpoints, with columns ws and we.

    policy "inside": [mid - w//2, +w), kept when it lies inside the contig.
    policy "strict": [mid - w//2, mid + w//2), dropped when it ends at or after the contig's end; an
    odd width yields nothing, because the window is one base short.
    policy "odd": [mid - w//2, mid + w//2 + w%2), dropped when it ends at or after the contig's end.
    keep_all keeps the dropped rows with in_bounds false instead.
    """
    half = width // 2
    ws = midpoint() - half
    joined = join_few(df, lengths.select("chrom", F.col("length").alias("_length")), "chrom", "left")
    if policy == "inside":
        we = ws + width
        ok = (F.col("ws") >= 0) & (F.col("we") <= F.col("_length"))
    elif policy == "strict":
        we = ws + 2 * half
        ok = (F.col("ws") >= 0) & (F.col("we") < F.col("_length")) & F.lit(2 * half == width)
    elif policy == "odd":
        we = ws + width
        ok = (F.col("ws") >= 0) & (F.col("we") < F.col("_length"))
    else:
        raise ValueError(f"unknown policy {policy!r}: inside, strict or odd")
    out = (joined.withColumn("ws", ws).withColumn("we", we)
           .withColumn("in_bounds", F.coalesce(ok, F.lit(False))).drop("_length"))
    return out if keep_all else out.where("in_bounds").drop("in_bounds")


def cap_region(df: DataFrame, max_len: int) -> DataFrame:
    """Regions longer than max_len become the max_len bases around their middle."""
    mid = _half(F.col("start") + F.col("end"))
    wide = F.col("end") - F.col("start") > max_len
    return df.withColumns({
        "start": F.when(wide, mid - max_len // 2).otherwise(F.col("start")),
        "end": F.when(wide, mid + max_len // 2).otherwise(F.col("end"))})


def summit_window(df: DataFrame, width: int, summit: str | None = None) -> DataFrame:
    """Windows ws, we of one width around a summit column, around the midpoint where it is NULL."""
    centre = F.coalesce(F.col(summit).cast("long"), midpoint()) if summit else midpoint()
    ws = centre - width // 2
    return df.withColumn("ws", ws).withColumn("we", ws + width)


def filter_min_score(df: DataFrame, minimum: float, score: str = "score") -> DataFrame:
    return df.where(F.col(score) >= minimum)


def score_distribution(df: DataFrame, score: str = "score") -> DataFrame:
    """Rows per distinct score, ordered by score."""
    return df.groupBy(score).agg(F.count(F.lit(1)).alias("n")).orderBy(score)


def filter_reason(df: DataFrame, score: str | None = "score", seq: str = "seq") -> DataFrame:
    """Adds reason: bounds, then score (NULL), then non_acgt; NULL for a row that passes.

    df comes from center_windows(keep_all=True) followed by extract_sequences.
    """
    from lociframe.functions.dna import is_acgt
    reason = F.when(~F.col("in_bounds"), "bounds")
    if score:
        reason = reason.when(F.col(score).isNull() | F.isnan(F.col(score)), "score")
    return df.withColumn("reason", reason.when(
        ~F.coalesce(is_acgt(seq), F.lit(False)), "non_acgt"))


def filter_report(df: DataFrame, score: str | None = "score", seq: str = "seq") -> DataFrame:
    """Counts per reason, kept rows under "kept"."""
    return (filter_reason(df, score, seq)
            .groupBy(F.coalesce(F.col("reason"), F.lit("kept")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("n")))


def locate_best(df: DataFrame, seq_length: int, width: int, best: str = "best_idx") -> DataFrame:
    """Genomic position of the best window of a sequence cut around the region's middle."""
    start = _half(F.col("start") + F.col("end")) - seq_length // 2 + F.col(best)
    return (df.withColumn("best_start", start).withColumn("best_end", start + width)
            .withColumn("best_peak", F.concat(F.col("chrom"), F.lit(":"), F.col("best_start").cast("string"),
                                              F.lit("-"), F.col("best_end").cast("string"))))


def top_n_spaced(hits: DataFrame, n: int, distance: int, by: str = "chrom", pos: str = "pos",
                 score: str = "score", margin: int = 0, lengths: DataFrame | None = None,
                 width: int = 0) -> DataFrame:
    """The n best hits per contig that lie at least distance apart, chosen from the best down.

    Ties of score go to the larger position. hits holds one row per position. A chosen hit
    blocks at most 2*distance - 1 positions, so the greedy choice never looks beyond rank
    (n-1)*(2*distance-1) + 1: only that many rows per contig leave the ranking, a bound set by the
    arguments and not by the data, and Spark applies it before the shuffle (window group limit).
    """
    if margin:
        if lengths is None:
            raise ValueError("margin needs the contig lengths")
        hits = (join_few(hits, lengths.select(F.col("chrom").alias(by), F.col("length").alias("_length")), by)
                .where((F.col(pos) >= margin) & (F.col(pos) < F.col("_length") - width - margin))
                .drop("_length"))
    bound = (n - 1) * (2 * distance - 1) + 1
    order = Window.partitionBy(by).orderBy(F.desc(score), F.desc(pos))
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= bound)

    def choose(pdf):
        chosen = []
        for row, at in zip(pdf.sort_values("rank").index, pdf.sort_values("rank")[pos]):
            if all(abs(at - other) >= distance for _, other in chosen):
                chosen.append((row, at))
                if len(chosen) == n:
                    break
        return pdf.loc[[row for row, _ in chosen]]

    return best.groupBy(by).applyInPandas(choose, best.schema).drop("rank")


def window_min(placements: DataFrame, width: int, placed: int, step: int, start: int = 0,
               by: str = "chrom", pos: str = "pos", value: str = "energy",
               ends: DataFrame | None = None) -> DataFrame:
    """Lowest placement value inside each window of a track; NULL where no placement has a value.

    A window starting at p covers the placements p .. p + width - placed. Windows start every step
    bases from start and end at the region's end; ends gives it per contig, otherwise the last
    placement does. A placement goes to the few windows that cover it and the minimum is taken
    before the shuffle, so neither a contig nor its placements are ever sorted.
    """
    span = width - placed
    if span < 0:
        raise ValueError("the window is shorter than the placement")
    at = F.col(pos).cast("long")
    last = F.expr(f"({pos} - {start}) div {step}") * step + start
    first = F.greatest(F.lit(start).cast("long"),
                       F.expr(f"({pos} - {span} - {start} + {step} - 1) div {step}") * step + start)
    covering = F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long")))
    windows = (placements.where(at >= start)
               .select(by, F.nanvl(F.col(value), F.lit(None)).alias(value), F.explode(covering).alias("window_start"))
               .groupBy(by, "window_start").agg(F.min(value).alias("window_min")))
    if ends is None:
        ends = placements.groupBy(by).agg((F.max(at) + placed).alias("region_end"))
    return (windows.join(ends, by).where(F.col("window_start") + width <= F.col("region_end"))
            .select(by, "window_start", "window_min"))


def track_intervals(windows: DataFrame, lengths: DataFrame, width: int, step: int,
                    value: str = "window_min") -> DataFrame:
    """Non-overlapping intervals for a track: the window itself when width <= step, otherwise the
    step-wide bin centred on it, cut at the contig's end; empty ones and NULL or NaN values dropped."""
    if width <= step:
        lo, hi = F.col("window_start"), F.col("window_start") + width
    else:
        lo = F.col("window_start") + (width - step) // 2
        hi = lo + step
    return (join_few(windows, lengths.select("chrom", "length"), "chrom")
            .select("chrom", lo.alias("start"), F.least(hi, F.col("length")).alias("end"),
                    F.col(value).alias("value"))
            .where((F.col("start") < F.col("end")) & F.col("value").isNotNull()
                   & ~F.isnan("value")))
