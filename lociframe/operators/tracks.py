"""Tracks and spaced hits of a whole genome, worked out inside the tasks that read it.

bins is (chrom, bin, bases): bins of one width, as binary, each followed by the first bases of the next one
(genome.with_halo). A task joins the bins of a batch, an N between them, scores every place once and keeps only windows or
best places, so no base becomes a row and nothing is shuffled by place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.operators.intervals import top_n_spaced
from lociframe.operators.joins import join_few
from lociframe.operators.motifs import _chunks, _joined, strand_scores
from lociframe.operators.scorers import CODES, Scorer

CALL_WINDOWS = 100_000   # placements handed at once to a scorer that takes strings
STATE_ROWS = 1_000_000   # best places a task holds before it gives them out


def sliding_minimum(values: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k values in a row; len(values) - k + 1 of them.

    The minimum up to each place of its block of k and the minimum from each place to the end of its block: a window is the end of one
    block and the head of the next, so two comparisons a place do, whatever k is. NaN counts as infinity.
    """
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0)
    blocks = np.full((-(-len(values) // k), k), np.inf)
    flat = blocks.reshape(-1)
    flat[:len(values)] = values
    flat[np.isnan(flat)] = np.inf
    head = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(tail[:n], head[k - 1:k - 1 + n])


def _scores(scorer: Scorer, data: np.ndarray, placed: int) -> np.ndarray:
    """The scorer's value of every `placed` letters in a row; NaN where it has none."""
    if hasattr(scorer, "sliding") and scorer.length == placed:
        return scorer.sliding(CODES[data])
    text, n = data.tobytes().decode("ascii", "replace"), max(len(data) - placed + 1, 0)
    out = np.full(n, np.nan)
    for at in range(0, n, CALL_WINDOWS):
        out[at:at + CALL_WINDOWS] = scorer.batch([text[i:i + placed] for i in range(at, min(n, at + CALL_WINDOWS))])
    return out


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [b.decode("ascii", "replace").upper() for b in batch.column("bases").to_pylist()]


def _places(starts: np.ndarray, offsets: np.ndarray, first: np.ndarray, count: np.ndarray, step: int):
    """Row, index in the joined text and position of count[i] places from first[i] on, every `step`, for each bin i."""
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    pos = first[row] + nth * step
    return row, starts[row] + pos - offsets[row], pos


def window_minima(bins: DataFrame, scorer: Scorer, placed: int, width: int, step: int, bin_width: int, start: int = 0) -> DataFrame:
    """(chrom, window_start, window_min): the lowest score over the placements inside each window of a track.

    A window starting at p covers the placements p .. p + width - placed; windows start every step bases from start and lie
    whole in the contig. A window none of whose placements has a score (NULL or NaN) has NULL. A halo of width - 1
    bases is needed; one row per window leaves the task that read its bin, and nothing is shuffled. Bins whose next one is
    missing have no windows over their end. No bins give no rows; other columns of bins are left out.
    """
    span = width - placed
    if span < 0:
        raise ValueError("the window is shorter than the placement")
    chrom_type = bins.schema["chrom"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers = _texts(batch), batch.column("bin").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in _chunks(texts):
                data, starts = _joined(texts[lo:hi])
                low = sliding_minimum(_scores(scorer, data, placed), span + 1)
                offsets = numbers[lo:hi] * bin_width
                sizes = np.array([len(t) for t in texts[lo:hi]], dtype=np.int64)
                first = np.maximum(-(-(offsets - start) // step), 0) * step + start
                # Windows that begin in the bin itself and end inside its bases.
                stop = offsets + np.minimum(bin_width, sizes - width + 1)
                count = np.maximum(-(-(stop - first) // step), 0)
                row, at, pos = _places(starts, offsets, first, count, step)
                if len(row):
                    value = low[at]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("chrom").take(pa.array(row + lo)), pa.array(pos), pa.array(value, mask=np.isinf(value))],
                        ["chrom", "window_start", "window_min"])

    return (bins.where(F.col("bases").isNotNull()).select("chrom", "bin", "bases")
            .mapInArrow(run, f"chrom {chrom_type}, window_start long, window_min double"))


def best_places(bins: DataFrame, matrix: np.ndarray, most: int, bin_width: int, margin: int = 0, lengths: DataFrame | None = None,
                digits: int = 9) -> DataFrame:
    """(chrom, pos, score, strand): the `most` best places of a motif that each task found on each contig.

    A place has the better of its strands, the forward one on ties, its score rounded to `digits`, so that sums equal on paper
    tie; of equal scores the larger position is better. The state of a contig is a set of at most `most` places: a batch adds those it
    finds above the least of them, by partial selection, and two states merge the same way. So a task gives out at most
    `most` rows per contig (or, where it reads very many contigs, per contig and time that its state was full), whatever it
    read. With margin, places below it or within it of the contig's end are left out, as in top_n_spaced. A halo of
    len(matrix) - 1 bases is needed.
    """
    matrix = np.asarray(matrix, dtype=float)
    w = len(matrix)
    chrom_type = bins.schema["chrom"].dataType.simpleString()
    rows = bins.where(F.col("bases").isNotNull()).select("chrom", "bin", "bases")
    if margin and lengths is None:
        raise ValueError("margin needs the contig lengths")
    if margin:
        rows = join_few(rows, lengths.select("chrom", F.col("length").cast("long").alias("_length")), "chrom")
    schema = pa.schema([("chrom", pa.string()), ("pos", pa.int64()), ("score", pa.float64()), ("strand", pa.string())])

    def best(pos, score, minus):
        if len(pos) > most:
            least = np.partition(score, len(score) - most)[len(score) - most]
            keep = score >= least
            pos, score, minus = pos[keep], score[keep], minus[keep]
            order = np.lexsort((-pos, -score))[:most]
            pos, score, minus = pos[order], score[order], minus[order]
        return pos, score, minus

    def given(state):
        for chrom, (pos, score, minus) in state.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([chrom] * len(pos), pa.string()), pa.array(pos), pa.array(score), pa.array(np.where(minus, "-", "+"), pa.string())],
                schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        held = 0
        for batch in batches:
            texts, numbers = _texts(batch), batch.column("bin").to_numpy(zero_copy_only=False).astype(np.int64)
            names = batch.column("chrom").to_pylist()
            ends = np.array(batch.column("_length").to_pylist(), dtype=np.int64) - w - margin if margin else None
            for lo, hi in _chunks(texts):
                data, starts = _joined(texts[lo:hi])
                fwd, rev = strand_scores(CODES[data], matrix)
                value, minus = np.round(np.fmax(fwd, rev), digits) + 0.0, rev > fwd
                offsets = numbers[lo:hi] * bin_width
                sizes = np.array([len(t) for t in texts[lo:hi]], dtype=np.int64)
                first, stop = offsets, offsets + np.minimum(bin_width, sizes - w + 1)
                if margin:
                    first, stop = np.maximum(first, margin), np.minimum(stop, ends[lo:hi])
                found: dict = {}
                for i in range(hi - lo):
                    if stop[i] > first[i]:
                        found.setdefault(names[lo + i], []).append(i)
                for chrom, of in found.items():
                    of = np.array(of)
                    _, at, pos = _places(starts[of], offsets[of], first[of], (stop - first)[of], 1)
                    old = state.get(chrom)
                    floor = old[1].min() if old is not None and len(old[1]) == most else -np.inf
                    ok = value[at] >= floor          # false for NaN, a place with another letter
                    new = best(pos[ok], value[at[ok]], minus[at[ok]])
                    if old is not None:
                        new = best(*(np.concatenate(pair) for pair in zip(old, new)))
                    held += len(new[0]) - (0 if old is None else len(old[0]))
                    state[chrom] = new
                if held > STATE_ROWS:
                    yield from given(state)
                    state, held = {}, 0
        yield from given(state)

    return rows.mapInArrow(run, f"chrom {chrom_type}, pos long, score double, strand string")


def best_spaced(bins: DataFrame, matrix: np.ndarray, n: int, distance: int, bin_width: int, margin: int = 0,
                lengths: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """The n best places of a motif per contig that lie at least distance apart, chosen from the best down.

    A chosen place blocks at most 2 * distance - 1 positions, so the choice never looks beyond the
    (n - 1) * (2 * distance - 1) + 1 best: only these leave the scan. Ties go to the larger position.
    """
    most = (n - 1) * (2 * distance - 1) + 1
    return top_n_spaced(best_places(bins, matrix, most, bin_width, margin, lengths, digits), n, distance)
