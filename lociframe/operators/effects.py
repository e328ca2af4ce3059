"""Effects of changed bases: variants, saturation mutagenesis, marginalisation, epistasis.

All scores a row needs are computed in that row, so none of these operators shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions import dna
from lociframe.operators.scorers import CODES, edited, put

BASES = "ACGT"
EDITS = 1 << 18   # changed sequences scored at once in a task
TRIPLETS = 128    # triplets of one row
KNOWN_BLOCKS = 64  # tables of triplets that a task keeps
TEXT_BYTES = 4 << 20      # bytes of changed sequences made at once
STRETCH = 16      # partners of a position that one row holds, which bounds an Arrow batch


def _positions(col: Column, positions: Sequence[int] | None) -> Column:
    if positions is not None:
        return F.array(*[F.lit(int(p)) for p in sorted(set(positions))])
    return F.sequence(F.lit(0), F.length(col) - 1)


def _bases() -> Column:
    return F.array(*[F.lit(b) for b in BASES])


def variant_effect(df: DataFrame, scorers: dict, ref: str = "ref_window", alt: str = "alt_window",
                   kind: dict[str, str] | None = None) -> DataFrame:
    """Adds <name>_ref, <name>_alt and <name>_dd for each scorer.

    A model or motif effect is ref - alt, an energy effect (kind[name] == "energy") alt - ref. A
    motif's score that is NULL counts as 0 in its effect (kind "motif"); other NULLs stay NULL.
    """
    kind = kind or {}
    for name, scorer in scorers.items():
        df = df.withColumns({f"{name}_ref": scorer(F.col(ref)), f"{name}_alt": scorer(F.col(alt))})
    effects = {}
    for name in scorers:
        r, a = F.col(f"{name}_ref"), F.col(f"{name}_alt")
        if kind.get(name) == "motif":
            effects[f"{name}_dd"] = F.coalesce(r, F.lit(0.0)) - F.coalesce(a, F.lit(0.0))
        else:
            effects[f"{name}_dd"] = a - r if kind.get(name) == "energy" else r - a
    return df.withColumns(effects)


def mutagenesis(df: DataFrame, scorer, key: str = "id", col: str = "seq", start: int = 0, end: int | None = None,
                raw: bool = False) -> DataFrame:
    """Every base at every position of [start, end): key, pos, base, value.

    value is the change of the score, centred over the four bases of the position; raw gives the
    original and the mutant score instead.
    """
    seq, pos = F.col(col), F.col("pos")
    stop = F.length(seq) if end is None else F.least(F.length(seq), F.lit(end))
    rows = (df.select(key, col, *([scorer(seq).alias("original")] if raw else []))
            .where(stop > start)
            .withColumn("pos", F.explode(F.sequence(F.lit(start), stop - 1)))
            .withColumn("_y", scorer.over(F.transform(_bases(), lambda b: put(seq, pos, b)))))
    mean = (F.get("_y", F.lit(0)) + F.get("_y", F.lit(1)) + F.get("_y", F.lit(2)) + F.get("_y", F.lit(3))) / 4
    out = rows.withColumn("_m", mean).select(
        key, F.col("pos").cast("long").alias("pos"), *(["original"] if raw else []), "_m",
        F.explode(F.arrays_zip(_bases().alias("base"), F.col("_y").alias("y"))).alias("x"))
    if raw:
        return out.select(key, "pos", F.col("x.base").alias("base"), "original", F.col("x.y").alias("mutant"))
    return out.select(key, "pos", F.col("x.base").alias("base"), (F.col("x.y") - F.col("_m")).alias("value"))


def marginalize(df: DataFrame, motif: str, scorer, col: str = "seq", start: int | None = None) -> DataFrame:
    """Adds before, after and delta of putting the motif into each background (NULL where it does
    not fit). mean_delta(df) is their mean."""
    return (df.withColumn("before", scorer(F.col(col)))
            .withColumn("after", scorer(dna.insert_motif(col, motif, start)))
            .withColumn("delta", F.col("after") - F.col("before")))


def mean_delta(df: DataFrame, delta: str = "delta") -> DataFrame:
    return df.agg(F.avg(delta).alias("mean_delta"), F.count(delta).alias("n"))


def _singles(df: DataFrame, scorer, places: Column, key: str, col: str) -> DataFrame:
    """One row per sequence: its places, their bases as numbers (-1 for other letters), its score and, for the n-th place and base b,
    the score with that base there at 4n + b. Scored once, and shared by all pairs or triplets of the sequence."""
    seq = F.col(col)
    rows = df.select(key, col, places.alias("_p"))
    rows = rows.withColumn("_c", F.transform("_p", lambda p: F.instr(F.lit(BASES), F.upper(F.substring(seq, p + 1, F.lit(1)))) - 1))
    edits = F.flatten(F.transform("_p", lambda p: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda b: F.array(p * 4 + b))))
    return edited(rows, scorer, seq, edits, 1, "_one").withColumn("_y", scorer(seq))


def _stretches(rows: DataFrame, after: str) -> DataFrame:
    """A row for every STRETCH places after the place numbered `after`: the first and the last of their numbers."""
    first = F.col(after) + 1
    last = F.size("_p") - 1
    starts = F.when(first <= last, F.sequence(first, last, F.lit(STRETCH)))
    return rows.withColumn("_from", F.explode(starts)).withColumn("_to", F.least(F.col("_from") + STRETCH - 1, F.size("_p") - 1))


def _other(code: Column, turn) -> Column:
    """The base `turn` steps after a base."""
    return (code + turn) % 4


def epistasis2(df: DataFrame, scorer, positions: Sequence[int] | None = None, key: str = "id",
               col: str = "seq") -> DataFrame:
    """Pairwise epistasis y_ij - y_i - y_j + y for all non-reference bases of each position pair.

    The original and the singles are scored once per sequence; of a pair only the nine double changes are. A scorer that knows how its
    score changes works on all pairs of a batch, EDITS changes at a time; any other one on rows of one position and
    at most STRETCH partners. Positions beyond the end or with a letter other than A, C, G, T (in either case) form no pairs.
    """
    if hasattr(scorer, "edit_scores"):
        return _pairs_by_difference(df, scorer, positions, key, col)
    seq, ni, i = F.col(col), F.col("_ni"), F.col("pos_i")
    places = _positions(seq, positions)
    rows = _singles(df, scorer, F.filter(places, lambda p: (p >= 0) & (p < F.length(seq))), key, col)
    rows = _stretches(rows.select("*", F.posexplode("_p").alias("_ni", "pos_i")), "_ni").withColumn("_ri", F.get("_c", ni))
    turns = F.sequence(F.lit(0), F.lit(8))
    pairs = F.flatten(F.transform(F.sequence("_from", "_to"), lambda n: F.transform(
        F.filter(turns, lambda t: (F.get("_c", n) >= 0) & (F.col("_ri") >= 0)), lambda t: F.struct(
            n.alias("n"), F.get("_p", n).alias("j"), F.get("_c", n).alias("rj"),
            _other(F.col("_ri"), F.floor(t / 3).cast("int") + 1).alias("a"), _other(F.get("_c", n), t % 3 + 1).alias("b")))))
    rows = rows.withColumn("_e", pairs)
    both = F.transform("_e", lambda e: F.array(i * 4 + e["a"], e["j"] * 4 + e["b"]))
    rows = edited(rows, scorer, seq, both, 2, "_two").withColumn("_x", F.explode(F.arrays_zip(F.col("_e").alias("e"), F.col("_two").alias("y"))))
    e = F.col("_x.e")

    def letter(code):
        return F.substring(F.lit(BASES), code + 1, F.lit(1))

    prediction = F.col("_x.y")
    return rows.select(
        key, i.cast("long").alias("pos_i"), F.substring(seq, i + 1, F.lit(1)).alias("ref_i"), letter(e["a"]).alias("base_i"),
        e["j"].cast("long").alias("pos_j"), F.substring(seq, e["j"] + 1, F.lit(1)).alias("ref_j"), letter(e["b"]).alias("base_j"),
        prediction.alias("prediction"),
        (prediction - F.get("_one", ni * 4 + e["a"]) - F.get("_one", e["n"] * 4 + e["b"]) + F.col("_y")).alias("delta_delta"))


def _by_length(texts: list[str | None], most) -> list[tuple[int, list[int]]]:
    """The texts of a batch by their length, at most most(length) of them together: (length, their numbers)."""
    groups: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        if t:
            groups.setdefault(len(t), []).append(i)
    return [(n, rows[at:at + most(n)]) for n, rows in groups.items() for at in range(0, len(rows), most(n))]


def _letters(data: np.ndarray, n: int = 1) -> pa.Array:
    """Bytes as texts of n letters."""
    return pa.Array.from_buffers(pa.string(), len(data), [None, pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * np.int32(n)), pa.py_buffer(np.ascontiguousarray(data, dtype=np.uint8))])


def _pairs_by_difference(df: DataFrame, scorer, positions: Sequence[int] | None, key: str, col: str) -> DataFrame:
    """epistasis2 for a scorer with edit_scores, inside the task that reads the sequences.

    Python gives a row per pair of places with the scores of its nine changes; they become rows of their own in the JVM, as a row costs far more than a score.
    """
    asked = None if positions is None else np.array(sorted(set(int(p) for p in positions)), dtype=np.int64)
    letter = np.frombuffer(BASES.encode(), dtype=np.uint8)

    def places_of(length):
        return np.arange(length) if asked is None else asked[(asked >= 0) & (asked < length)]

    def most(length):
        n = len(places_of(length))
        return max(1, EDITS // max(1, 9 * n * (n - 1) // 2))

    def doubles(own, codes, places, first, second):
        """Scores of the nine changes of each pair of each sequence."""
        if hasattr(scorer, "double_scores"):
            return scorer.double_scores(own, places, first, second).reshape(len(own), len(first), 9)
        row, i, j = np.repeat(np.arange(len(own)), 9 * len(first)), np.tile(np.repeat(first, 9), len(own)), np.tile(np.repeat(second, 9), len(own))
        t = np.tile(np.arange(9), len(own) * len(first))
        bases = np.stack([(codes[row, i] + 1 + t // 3) % 4, (codes[row, j] + 1 + t % 3) % 4], axis=1)
        return scorer.edit_scores(own, row, np.stack([places[i], places[j]], axis=1), bases).reshape(len(own), len(first), 9)

    def numbers(values):
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * np.int32(9)), pa.array(values.reshape(-1), from_pandas=True))

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for length, some in _by_length(texts, most):
                places, own = places_of(length), [texts[i] for i in some]
                n, m = len(places), len(own)
                if n < 2:
                    continue
                raw = np.frombuffer("".join(own).encode("ascii", "replace"), dtype=np.uint8).reshape(m, length)[:, places]
                codes = CODES[raw].astype(np.int64)
                y = np.asarray(scorer.batch(own), dtype=float)
                single = np.repeat(np.arange(m), 4 * n), np.tile(np.repeat(places, 4), m)[:, None], np.tile(np.arange(4), m * n)[:, None]
                one = scorer.edit_scores(own, *single).reshape(m, n, 4)
                other = (codes[:, :, None] + np.arange(1, 4)) % 4
                one, other = np.take_along_axis(one, other, axis=2), letter[other]
                before = np.concatenate([[0], np.cumsum(np.arange(n - 1, 0, -1))])       # pairs whose first place comes earlier
                step = max(1, EDITS // (9 * m))
                for lo in range(0, int(before[-1]), step):
                    pair = np.arange(lo, min(lo + step, int(before[-1])))
                    first = np.searchsorted(before, pair, side="right") - 1
                    second = first + 1 + pair - before[first]
                    both = doubles(own, codes, places, first, second)
                    change = (both.reshape(m, -1, 3, 3) - one[:, first][:, :, :, None] - one[:, second][:, :, None, :] + y[:, None, None, None]).reshape(m, -1, 9)
                    row, p = np.nonzero((codes[:, first] < 4) & (codes[:, second] < 4))
                    if not len(row):
                        continue
                    i, j = first[p], second[p]
                    if len(row) == m * len(pair):
                        both, change = both.reshape(-1, 9), change.reshape(-1, 9)
                    else:
                        both, change = both[row, p], change[row, p]
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(np.array(some)[row])), pa.array(places[i]), _letters(raw[row, i]), _letters(other[row, i], 3), pa.array(places[j]),
                         _letters(raw[row, j]), _letters(other[row, j], 3), numbers(both), numbers(change)], names=names)

    names = [key, "pos_i", "ref_i", "_other_i", "pos_j", "ref_j", "_other_j", "_both", "_change"]
    rows = df.select(key, col).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, pos_i long, ref_i string, _other_i string, "
                                               "pos_j long, ref_j string, _other_j string, _both array<double>, _change array<double>")
    rows = rows.select("*", F.posexplode("_change").alias("_t", "delta_delta"))
    return rows.select(key, "pos_i", "ref_i", F.substring("_other_i", F.expr("int(_t div 3) + 1"), F.lit(1)).alias("base_i"), "pos_j", "ref_j",
                       F.substring("_other_j", F.expr("_t % 3 + 1"), F.lit(1)).alias("base_j"), F.get("_both", F.col("_t")).alias("prediction"), "delta_delta")


def top_interactions(pairs: DataFrame, n: int = 500, least: float = 1e-6, key: str = "id") -> DataFrame:
    """Per sequence the n pairs of largest absolute epistasis above `least`."""
    size = F.abs("delta_delta")
    order = Window.partitionBy(key).orderBy(F.desc(size), "pos_i", "pos_j", "base_i", "base_j")
    return pairs.where(size > least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def epistasis3(df: DataFrame, scorer, start: int | None = None, end: int | None = None, threshold: float = 0.01,
               key: str = "id", col: str = "seq") -> DataFrame:
    """Third-order epistasis of each position triplet: the combination of non-reference bases of
    largest magnitude, where that exceeds the threshold.

    The default region is the middle: length//2 - 4 to length//2 + 4. A scorer that knows how its score changes scores the original and the
    singles once per sequence, and of a triplet the 54 combinations that change two or three of its bases, in rows of two positions
    and at most STRETCH third ones. Any other one is given the changed sequences, in rows of TRIPLETS triplets, which share them.
    Positions with a letter other than A, C, G, T form no triplets. Magnitudes equal to 1e-9 count as ties; the first
    combination in the order of the bases wins.
    """
    if not hasattr(scorer, "edit_scores"):
        return _triplets_by_text(df, scorer, start, end, threshold, key, col)
    seq = F.col(col)
    half = F.floor(F.length(seq) / 2).cast("int")
    lo = F.greatest(F.lit(0), half - 4) if start is None else F.lit(max(0, start))
    hi = F.least(F.length(seq), half + 5) if end is None else F.least(F.length(seq), F.lit(end))
    region = F.when(lo < hi, F.sequence(lo, hi - 1))
    rows = _singles(df, scorer, region, key, col).select("*", F.posexplode("_p").alias("_ni", "pos_i"))
    later = F.when(F.col("_ni") + 1 < F.size("_p"), F.sequence(F.col("_ni") + 1, F.size("_p") - 1))
    rows = _stretches(rows.withColumn("_nj", F.explode(later)), "_nj")
    ra, rb = F.get("_c", F.col("_ni")), F.get("_c", F.col("_nj"))
    i, j = F.col("pos_i"), F.get("_p", F.col("_nj"))

    # Bases are counted from the reference, so the places of the 27 triple and 3 * 9 double changes are known beforehand.
    turns = [(a, b, c) for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)]
    turns += [t for free in (2, 1, 0) for t in [x[:free] + (0,) + x[free:] for x in [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]]]
    numbers = F.filter(F.sequence("_from", "_to"), lambda n: (F.get("_c", n) >= 0) & (ra >= 0) & (rb >= 0))
    rows = rows.withColumn("_k", numbers)
    combos = F.expr(f"array({', '.join(f'array{t}' for t in turns)})")
    edits = F.flatten(F.transform("_k", lambda n: F.transform(combos, lambda t: F.array(
        i * 4 + _other(ra, t[0]), j * 4 + _other(rb, t[1]), F.get("_p", n) * 4 + _other(F.get("_c", n), t[2])))))
    rows = edited(rows, scorer, seq, edits, 3, "_all").select("*", F.posexplode("_k").alias("_t", "_nk")).withColumn(
        "_s", F.slice("_all", F.col("_t") * len(turns) + 1, len(turns)))
    rc = F.get("_c", F.col("_nk"))

    def largest(scores):
        def third(x):
            a, b, c = F.shiftright(x, 4), F.shiftright(x, 2) % 4, x % 4
            base_a, base_b, base_c = _other(ra, a), _other(rb, b), _other(rc, c)
            double = (F.get(scores, a * 3 + b + 23) + F.get(scores, a * 3 + c + 32) + F.get(scores, b * 3 + c + 41))
            single = (F.get("_one", F.col("_ni") * 4 + base_a) + F.get("_one", F.col("_nj") * 4 + base_b)
                      + F.get("_one", F.col("_nk") * 4 + base_c))
            value = F.get(scores, a * 9 + b * 3 + c - 13) - double + single - F.col("_y")
            return F.struct(F.round(F.abs(value), 9).alias("size"), (-(base_a * 16 + base_b * 4 + base_c)).alias("first"), value.alias("value"))
        return F.array_max(F.transform(F.expr("filter(sequence(21, 63), x -> x % 4 > 0 AND shiftright(x, 2) % 4 > 0)"), third))

    # The slice is bound once, as the variable of a one-element transform, and filtered inside the generator: a filter above would
    # be pushed down and score the combinations again.
    best = F.filter(F.transform(F.array(F.col("_s")), largest), lambda b: b["size"] > threshold)
    return (rows.withColumn("_best", F.explode(best))
            .select(key, i.cast("long").alias("pos_i"), j.cast("long").alias("pos_j"), F.get("_p", F.col("_nk")).cast("long").alias("pos_k"),
                    F.col("_best.value").alias("interaction")))


def _triplet_block(n: int, block: int):
    """Of the triplets of n places in lexicographic order the block-th TRIPLETS: their places, the changes that they need as places and
    turns (0: the base as it is), each once, and for each triplet the numbers of its 64 changes."""
    left = np.arange(n - 2, 0, -1)
    ends = np.cumsum(left * (left + 1) // 2)            # triplets up to each first place
    number = np.arange(block * TRIPLETS, min((block + 1) * TRIPLETS, int(ends[-1])))
    i = np.searchsorted(ends, number, side="right")
    rest = number - np.where(i > 0, ends[i - 1], 0)
    triplets = np.empty((len(number), 3), dtype=np.int64)
    for k, (first, r) in enumerate(zip(i.tolist(), rest.tolist())):
        inner = np.cumsum(np.arange(n - 2 - first, 0, -1))
        second = int(np.searchsorted(inner, r, side="right"))
        triplets[k] = first, first + 1 + second, first + 2 + second + r - (int(inner[second - 1]) if second else 0)
    turns = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), axis=-1).reshape(64, 3)
    at, by = np.repeat(triplets, 64, axis=0), np.tile(turns, (len(triplets), 1))
    name = np.sort(np.where(by > 0, at * 4 + by, 0), axis=1)
    _, which, inverse = np.unique(name, axis=0, return_index=True, return_inverse=True)
    return triplets, at[which], by[which], inverse.reshape(len(triplets), 64)


def _triplets_by_text(df: DataFrame, scorer, start: int | None, end: int | None, threshold: float, key: str, col: str) -> DataFrame:
    """epistasis3 for a scorer that is given the changed sequences, each change once per row of triplets."""
    letter = np.frombuffer(BASES.encode(), dtype=np.uint8)

    def region(length):
        lo = max(0, length // 2 - 4) if start is None else max(0, start)
        return lo, min(length, length // 2 + 5) if end is None else min(length, end)

    def coded(texts, lo, hi):
        """The letters of the texts as numbers, and the codes of the region."""
        plain = all(t.isascii() for t in texts)
        kind, name = (np.uint8, "ascii") if plain else (np.uint32, "utf-32-le")
        raw = np.frombuffer("".join(texts).encode(name), dtype=kind).reshape(len(texts), -1)
        part = raw[:, lo:hi]
        return raw, CODES[np.where(part < 128, part, 78).astype(np.uint8)].astype(np.int64)

    def block_of(known, n, block):
        if (n, block) not in known:
            if len(known) == KNOWN_BLOCKS:
                known.clear()
            known[n, block] = _triplet_block(n, block)
        return known[n, block]

    def written(batches):
        known: dict = {}
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for length, some in _by_length(texts, lambda n: max(1, TEXT_BYTES // (n * 32 * TRIPLETS))):
                lo, hi = region(length)
                n = hi - lo
                if n < 3:
                    continue
                raw, codes = coded([texts[i] for i in some], lo, hi)
                for block in range(-(-(n * (n - 1) * (n - 2) // 6) // TRIPLETS)):
                    _, at, by, _ = block_of(known, n, block)
                    new = np.repeat(raw[:, None, :], len(at), axis=1)
                    for slot in range(3):
                        rows = np.flatnonzero(by[:, slot])
                        place = at[rows, slot]
                        new[:, rows, lo + place] = letter[(codes[:, place] + by[rows, slot]) % 4]
                    count = new.shape[0] * new.shape[1]
                    if raw.dtype == np.uint8:
                        flat = pa.Array.from_buffers(pa.string(), count, [None, pa.py_buffer(np.arange(count + 1, dtype=np.int32) * np.int32(length)), pa.py_buffer(new.reshape(-1))])
                    else:
                        text = new.astype("<u4").tobytes().decode("utf-32-le")
                        flat = pa.array([text[k:k + length] for k in range(0, len(text), length)], pa.string())
                    which = pa.array(np.array(some))
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(which), batch.column(1).take(which), pa.array(np.full(len(some), block, dtype=np.int64)),
                         pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * np.int32(len(at))), flat)],
                        names=["_key", "_seq", "_block", "_texts"])

    def largest(batches):
        known: dict = {}
        for batch in batches:
            keys, texts, blocks, lists = (batch.column(k) for k in range(4))
            texts, blocks = texts.to_pylist(), blocks.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype(float)
            begin = lists.offsets.to_numpy()
            for row, text in enumerate(texts):
                lo, hi = region(len(text))
                triplets, _, _, inverse = block_of(known, hi - lo, int(blocks[row]))
                _, codes = coded([text], lo, hi)
                s = values[begin[row]:begin[row + 1]][inverse].reshape(-1, 4, 4, 4)
                double = s[:, 1:, 1:, :1] + s[:, 1:, :1, 1:] + s[:, :1, 1:, 1:]
                single = s[:, 1:, :1, :1] + s[:, :1, 1:, :1] + s[:, :1, :1, 1:]
                value = (s[:, 1:, 1:, 1:] - double + single - s[:, :1, :1, :1]).reshape(-1, 27)
                size = np.round(np.abs(value), 9)
                size[np.isnan(size)] = -1.0
                own = codes[0][triplets]
                base = [(own[:, slot, None] + np.arange(1, 4)) % 4 for slot in range(3)]
                order = (base[0][:, :, None, None] * 16 + base[1][:, None, :, None] * 4 + base[2][:, None, None, :]).reshape(-1, 27)
                best = np.argmin(np.where(size == size.max(axis=1, keepdims=True), order, 64), axis=1)
                t = np.arange(len(triplets))
                found = np.flatnonzero((own < 4).all(axis=1) & (size[t, best] > threshold))
                if len(found):
                    pos = triplets[found] + lo
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(np.full(len(found), row))), *[pa.array(pos[:, slot]) for slot in range(3)], pa.array(value[found, best[found]])],
                        names=[key, "pos_i", "pos_j", "pos_k", "interaction"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, col).mapInArrow(written, f"_key {kind}, _seq string, _block long, _texts array<string>")
    scores = rows.select("_key", "_seq", "_block", scorer.over(F.col("_texts")).alias("_s"))
    return scores.mapInArrow(largest, f"`{key}` {kind}, pos_i long, pos_j long, pos_k long, interaction double")


def strand_comparison(df: DataFrame, scorer, col: str = "seq") -> DataFrame:
    """Adds forward and reverse: the scores of each sequence and of its reverse complement."""
    return df.withColumns({"forward": scorer(F.col(col)), "reverse": scorer(dna.revcomp(col))})
