"""Attributions of additive scorers, the spans that stand out in them, and convolution filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions import dna
from lociframe.operators.evaluation import with_prefix
from lociframe.operators.joins import spread_join
from lociframe.operators.motifs import _chunks, _joined
from lociframe.operators.negatives import shuffled_in_parts
from lociframe.operators.scorers import CODES, WeightScorer, encode
from lociframe.session import stored


def with_shuffles(df: DataFrame, key: str, n: int = 20, seed=42, col: str = "seq", out: str = "refs") -> DataFrame:
    """Adds an array of n shuffles of each sequence that keep its dinucleotide counts, seeded by key."""
    @F.pandas_udf("array<string>")
    def refs(seqs: pd.Series, codes: pd.Series) -> pd.Series:
        texts = [s if isinstance(s, str) else None for s in seqs]
        own = codes.to_numpy("int64").view("uint64")[:, None] + np.arange(1, n + 1, dtype="uint64") * np.uint64(0xD1342543DE82EF95)
        done = shuffled_in_parts([t for t in texts for _ in range(n)], own.reshape(-1))
        return pd.Series([None if t is None else done[i * n:(i + 1) * n] for i, t in enumerate(texts)], dtype=object)
    return df.withColumn(out, refs(F.upper(F.col(col)), F.xxhash64(F.lit(str(seed)), F.col(key).cast("string"))))


def _as_lists(values: np.ndarray, ok: np.ndarray) -> pd.Series:
    return pd.Series([v if k else None for v, k in zip(values, ok)], dtype=object)


def attribute(df: DataFrame, scorer: WeightScorer, col: str = "seq", refs: str | None = "refs",
              method: str = "references", hypothetical: bool = False, out: str = "attribution") -> DataFrame:
    """Adds an array of attributions: one per position, or four per position when hypothetical.

    "references": the contribution of a base minus the mean contribution of the reference
    sequences' bases at that position; exact for additive scorers, and the sum over a sequence is
    its score minus the references' mean score. "input_x_weight": the weight of the observed base.
    A sequence of another length or alphabet gives NULL.
    """
    weights, length = scorer.weights, scorer.length
    place = np.arange(length)

    def observed(values, codes):
        return values[np.arange(len(codes))[:, None], place, codes]

    if method == "input_x_weight":
        @F.pandas_udf("array<double>")
        def product(seqs: pd.Series) -> pd.Series:
            codes, ok = encode(seqs.tolist(), length)
            return _as_lists(weights[place, np.minimum(codes, 3)], ok)
        return df.withColumn(out, product(F.col(col)))
    if method != "references":
        raise ValueError(f"unknown method {method!r}: references or input_x_weight")

    @F.pandas_udf("array<double>")
    def against(seqs: pd.Series, lists: pd.Series) -> pd.Series:
        codes, ok = encode(seqs.tolist(), length)
        sizes = np.array([len(x) for x in lists])
        flat, _ = encode([s for x in lists for s in x], length)
        padded = np.hstack([weights, np.zeros((length, 1))])
        starts = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(padded[place, flat], starts, axis=0) / sizes[:, None] if len(flat) else np.zeros((0, length))
        values = weights[None, :, :] - mean[:, :, None]
        if hypothetical:
            return _as_lists(values.reshape(len(codes), -1), ok)
        return _as_lists(observed(values, np.minimum(codes, 3)), ok)

    return df.withColumn(out, against(F.col(col), F.col(refs)))


def long_attribution(df: DataFrame, key: str = "id", col: str = "attribution") -> DataFrame:
    """(key, pos, value) of an attribution with one entry per position."""
    return df.select(key, F.posexplode(col).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


def attribution_sums(df: DataFrame, key: str = "id", col: str = "attribution", keep: tuple[str, ...] = ()) -> DataFrame:
    """The sum of each row's attributions, after the key and the columns to keep."""
    return df.select(key, *keep, F.aggregate(col, F.lit(0.0), lambda a, x: a + x).alias("total"))


SPAN_DIGITS = 9
DIGIT_BITS = 16             # of a double, counted in one pass
NEVER = (1 << 63) - 1       # above the bits of every double
SUM_VALUES = 1 << 18        # attributions whose spans are summed at once


def span_sums(lists, lengths):
    """Sequences of one length, about SUM_VALUES values at a time: their rows, and per span length a matrix of the sums of all spans."""
    have = np.fromiter((len(v) for v in lists), dtype=np.int64, count=len(lists))
    lists = list(lists)
    order = np.argsort(have, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(have[order])) + 1):
        size = int(have[same[0]]) if len(same) else 0
        step = max(1, SUM_VALUES // max(size, 1))
        for at in range(0, len(same) if size >= min(lengths) else 0, step):
            some = same[at:at + step]
            total = np.zeros((len(some), size + 1))
            np.cumsum(np.stack([np.asarray(lists[i], float) for i in some]), axis=1, out=total[:, 1:])
            yield some, {n: np.round(total[:, n:] - total[:, :-n], SPAN_DIGITS) + 0.0 for n in lengths if n <= size}


def _cutoffs(rows: DataFrame, sizes, max_p: float) -> tuple[dict, dict]:
    """Per (length, sign) the bits of the largest size that a share of max_p or more of all sizes reaches (0 where none is), and
    the number of sizes.

    sizes gives the bits of a batch per (length, sign). Each pass counts, in every task, the next 16 bits of the sizes whose higher bits
    are those already found, 65,536 counters per length and sign; Spark adds the counts up, and one row per length and sign,
    the digit where the sum from the top passes max_p, comes back. Four passes give the value itself, whatever the number of
    distinct sums.
    """
    known: dict[tuple[int, int], int] = {}      # higher bits found so far
    above: dict[tuple[int, int], int] = {}      # sizes larger than these
    total: dict[tuple[int, int], int] = {}
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        first = not total

        def count(batches, shift=shift, first=first, known=dict(known)):
            counters: dict[tuple[int, int], np.ndarray] = {}
            for pdf in batches:
                for k, bits in sizes(pdf).items():
                    if not first:
                        if k not in known:
                            continue
                        bits = bits[bits >> (shift + DIGIT_BITS) == known[k]]
                    found = np.bincount(bits >> shift & (1 << DIGIT_BITS) - 1, minlength=1 << DIGIT_BITS)
                    counters[k] = counters[k] + found if k in counters else found
            for (n, sign), c in counters.items():
                digit = np.flatnonzero(c)
                yield pd.DataFrame({"length": n, "sign": sign, "digit": digit, "n": c[digit]})

        digits = (rows.mapInPandas(count, "length int, sign int, digit long, n long")
                  .groupBy("length", "sign", "digit").agg(F.sum("n").alias("n")))
        down = Window.partitionBy("length", "sign").orderBy(F.desc("digit")).rowsBetween(Window.unboundedPreceding, 0)
        digits = (digits.withColumn("up_to", F.sum("n").over(down))
                  .withColumn("all", F.sum("n").over(Window.partitionBy("length", "sign"))))
        if not first:
            digits = digits.join(F.broadcast(rows.sparkSession.createDataFrame(     # two rows per length
                [(n, sign, above[n, sign], total[n, sign]) for n, sign in known], "length int, sign int, above long, total long")), ["length", "sign"])
        else:
            digits = digits.withColumns({"above": F.lit(0).cast("long"), "total": F.col("all")})
        reached = (F.col("above") + F.col("up_to")) / F.col("total") >= max_p
        found = (digits.groupBy("length", "sign").agg(
            F.max(F.when(reached, F.col("digit"))).alias("digit"), F.first("total").alias("total"),
            F.max_by(F.col("above") + F.col("up_to") - F.col("n"), F.when(reached, F.col("digit"))).alias("above")).collect())
        for r in found:
            k = (r["length"], r["sign"])
            total[k] = r["total"]
            if r["digit"] is not None:
                known[k], above[k] = known.get(k, 0) << DIGIT_BITS | r["digit"], r["above"]
        if not known:
            break
    return {k: known.get(k, 0) for k in total}, total


def call_seqlets(df: DataFrame, key: str = "id", col: str = "attribution", shortest: int = 5, longest: int = 15,
                 max_p: float = 0.01) -> DataFrame:
    """Spans whose summed attribution stands out: key, start, end, attribution, p_value.

    The rule of this library: the p-value of a span is the share of all spans of its length and
    sign whose absolute sum is at least as large. A span is significant when its own p-value is
    below max_p and so is that of every span of length >= shortest inside it, with the same sign.
    Of overlapping significant spans of a sequence the one of lowest p-value stays, then the longer,
    then the first. Flat attributions give none.

    The largest sum that is not rare enough is selected exactly, per length and sign, by histograms over 16 bits of the
    doubles at a time (_cutoffs); the tasks look only at their own sequences with it. Only the sums beyond it, a share of
    max_p of all, are counted one by one, for their p-values, and met by the spans on their bits.
    """
    lengths = list(range(shortest, longest + 1))

    def sizes(pdf):
        """Per length and sign the bits of the absolute sums; of positive doubles they rise as the doubles do."""
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for _, by_length in span_sums(pdf[col], lengths):
            for n, s in by_length.items():
                for sign in (1, -1):
                    found.setdefault((n, sign), []).append((s[s * sign > 0] * sign).view(np.int64))
        return {k: np.concatenate(v) for k, v in found.items()}

    rows = stored(df.select(key, col).where(F.col(col).isNotNull()))     # read by every pass
    cut, total = _cutoffs(rows.select(col), sizes, max_p)

    def beyond(batches):
        for pdf in batches:
            for (n, sign), bits in sizes(pdf).items():
                size, c = np.unique(bits[bits > cut.get((n, sign), NEVER)], return_counts=True)
                if len(size):
                    yield pd.DataFrame({"length": n, "sign": sign, "size": size, "n": c})

    spread = (rows.select(col).mapInPandas(beyond, "length int, sign int, size long, n long")
              .groupBy("length", "sign", "size").agg(F.sum("n").alias("n")))
    numbers = F.create_map(*[F.lit(x).cast("long") for (n, sign), all_ in total.items() for x in (n * sign, all_)]) if total else F.lit(None).cast("map<bigint,bigint>")
    tail = with_prefix(spread, ["length", "sign"], "size", ["n"]).select(
        "length", "sign", "size", ((F.col("n_all") - F.col("n_before")) / F.try_element_at(numbers, (F.col("length") * F.col("sign")).cast("long"))).alias("p_value"))

    def significant(batches):
        for pdf in batches:
            keys = pdf[key].to_numpy()
            for some, by_length in span_sums(pdf[col], lengths):
                for sign in (1, -1):
                    inner = None
                    for n, s in by_length.items():
                        size = s * sign
                        size = np.where(size > 0, size, 0.0).view(np.int64)
                        good = size > cut.get((n, sign), NEVER)
                        if inner is not None:
                            good &= inner[:, :-1] & inner[:, 1:]
                        inner = good
                        row, start = np.nonzero(good)
                        if len(row):
                            yield pd.DataFrame({key: keys[some[row]], "start": start, "end": start + n, "length": n, "sign": sign, "size": size[row, start]})

    key_type = df.schema[key].dataType.simpleString()
    spans = rows.mapInPandas(significant, f"`{key}` {key_type}, start long, end long, length int, sign int, size long")

    @F.pandas_udf("double")
    def as_double(bits: pd.Series) -> pd.Series:
        return pd.Series(bits.to_numpy(np.int64).view(float))

    # Copies of a sequence share their sums, so a frequent one is cut by the row.
    called = spread_join(spans, tail, ["length", "sign", "size"], row_key=F.struct(key, "start")).withColumn(
        "attribution", as_double("size") * F.col("sign"))

    @F.pandas_udf("array<boolean>")
    def free(starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([_first_free(a, b) for a, b in zip(starts, ends)], dtype=object)

    # One sequence's spans in order of preference: at most its length times the number of lengths.
    order = F.struct("p_value", (-F.col("length")).alias("shorter"), "start", "end", "attribution")
    lists = called.groupBy(key).agg(F.sort_array(F.collect_list(order)).alias("s"))
    chosen = lists.withColumn("keep", free(F.col("s.start"), F.col("s.end")))
    return (chosen.select(key, F.explode(F.arrays_zip("s", "keep")).alias("x")).where("x.keep")
            .select(key, *[F.col(f"x.s.{c}").alias(c) for c in ("start", "end", "attribution", "p_value")]))


def _first_free(starts, ends) -> list[bool]:
    """For spans in order of preference, which ones overlap none taken before."""
    taken: list[tuple[int, int]] = []
    out = []
    for s, e in zip(starts, ends):
        ok = all(e <= a or s >= b for a, b in taken)
        out.append(ok)
        if ok:
            taken.append((s, e))
    return out


# ---- convolution filters ------------------------------------------------------------------------

class Filters:
    """Filters of one layer: weights (n, width, 4) in the order A, C, G, T, bias, padding, dilation, stride."""

    def __init__(self, weights, bias=None, pad: int = 0, dilation: int = 1, stride: int = 1):
        self.weights = np.asarray(weights, dtype=float)
        self.n, self.width, _ = self.weights.shape
        self.bias = np.zeros(self.n) if bias is None else np.asarray(bias, dtype=float)
        self.pad, self.dilation, self.stride = pad, dilation, stride
        self.span = dilation * (self.width - 1) + 1

    def activations(self, data: np.ndarray, f: int) -> np.ndarray:
        """Activation at every input position where a window, padded ends included, may start."""
        table = np.hstack([self.weights[f], np.zeros((self.width, 1))])
        n = len(data) - self.span + 1
        out = np.full(max(n, 0), self.bias[f])
        for k in range(self.width):
            out += table[k, data[k * self.dilation:k * self.dilation + n]]
        return out


def _activation_rows(filters: Filters, pdf: pd.DataFrame, keys: list[str]):
    """(rows of the batch, per filter: row index, output position, activation) for every window."""
    pdf = pdf[pdf["_seq"].notna() & (pdf["_seq"] != "")]
    texts = pdf["_seq"].tolist()
    pad = "N" * filters.pad
    for lo, hi in _chunks(texts):
        padded = [pad + s + pad for s in texts[lo:hi]]
        data, starts = _joined(padded)
        codes = CODES[data]
        lengths = np.array([len(s) for s in padded])
        n_out = np.maximum((lengths - filters.span) // filters.stride + 1, 0)
        row = np.repeat(np.arange(len(padded)), n_out)
        out_pos = np.arange(n_out.sum()) - np.repeat(np.cumsum(n_out) - n_out, n_out)
        at = starts[row] + out_pos * filters.stride
        yield pdf.iloc[lo:hi].reset_index(drop=True), row, out_pos, (
            lambda f, codes=codes, at=at: filters.activations(codes, f)[at])


def filter_maxima(seqs: DataFrame, filters: Filters, seq: str = "seq") -> DataFrame:
    """(filter, max_activation) over all sequences and positions; one row per filter leaves a batch."""
    def maxima(batches):
        for pdf in batches:
            for _, _, _, act in _activation_rows(filters, pdf, []):
                values = [(f, act(f)) for f in range(filters.n)]
                yield pd.DataFrame([(f, float(a.max())) for f, a in values if len(a)], columns=["filter", "m"])
    return (seqs.select(F.upper(F.col(seq)).alias("_seq")).mapInPandas(maxima, "filter int, m double")
            .groupBy("filter").agg(F.max("m").alias("max_activation")))


def high_activations(seqs: DataFrame, filters: Filters, floors: dict[int, float], key: str = "id",
                     seq: str = "seq") -> DataFrame:
    """(key, filter, out_pos, activation) of the windows at or above each filter's floor, with the input
    position and text of the part of the window that lies inside the sequence."""
    key_type = seqs.schema[key].dataType.simpleString()

    def rows(batches):
        for pdf in batches:
            for part, row, out_pos, act in _activation_rows(filters, pdf, [key]):
                for f, floor in floors.items():
                    values = act(f)
                    hit = np.flatnonzero(values >= floor)
                    if len(hit):
                        yield pd.DataFrame({key: part[key].iloc[row[hit]].to_numpy(), "filter": f,
                                            "out_pos": out_pos[hit], "activation": values[hit]})

    src = seqs.select(key, F.upper(F.col(seq)).alias("_seq"))
    return src.mapInPandas(rows, f"`{key}` {key_type}, filter int, out_pos long, activation double")


def filter_summary(seqs: DataFrame, filters: Filters, key: str = "id", seq: str = "seq", top: int | None = None,
                   share: float = 0.8) -> DataFrame:
    """Per filter the largest activation and the number of windows at or above `share` of it.

    The top filters by largest activation, ties by number.
    """
    maxima = filter_maxima(seqs, filters, seq).orderBy(F.desc("max_activation"), "filter").limit(top or filters.n)
    best = {r["filter"]: r["max_activation"] for r in maxima.collect()}   # one row per filter
    counts = (high_activations(seqs, filters, {f: m * share for f, m in best.items()}, key, seq)
              .groupBy("filter").agg(F.count(F.lit(1)).alias("num_activating")))
    # A largest activation below 0 is below its own share: no window counts, and the filter is listed with 0.
    listed = seqs.sparkSession.createDataFrame(list(best.items()), "filter int, max_activation double")
    return listed.join(counts, "filter", "left").select("filter", "max_activation", F.coalesce("num_activating", F.lit(0)).alias("num_activating"))


def filter_pfm(seqs: DataFrame, filters: Filters, key: str = "id", seq: str = "seq", share: float = 0.8,
               per_sequence: int = 10) -> DataFrame:
    """PFM of each filter from its windows at or above share of its largest activation.

    The first windows of each sequence, at most per_sequence; windows are cut at the ends of the
    sequence, and a column's shares come from the windows that cover it. Columns between covered
    ones without a window of their own are 0.25. Columns: filter, pos (0-based from the first covered one), base,
    prob, coverage, nsites (the least covered column's windows). Filters without a positive
    maximum give none.
    """
    maxima = {r["filter"]: r["max_activation"] for r in filter_maxima(seqs, filters, seq).collect()}   # one row per filter
    floors = {f: m * share for f, m in maxima.items() if m > 0}
    order = Window.partitionBy("filter", key).orderBy("out_pos")
    acts = (high_activations(seqs, filters, floors, key, seq)
            .withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_sequence))
    sites = acts.join(seqs.select(key, F.upper(F.col(seq)).alias("_seq")), key)
    col = F.col("out_pos") * filters.stride - filters.pad + F.col("_c") * filters.dilation
    bases = (sites.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(filters.width - 1))))
             .withColumn("_at", col).where((F.col("_at") >= 0) & (F.col("_at") < F.length("_seq")))
             .withColumn("base", F.substring(F.col("_seq"), (F.col("_at") + 1).cast("int"), F.lit(1)))
             .groupBy("filter", "_c").agg(F.count(F.lit(1)).alias("coverage"),
                                          *[F.count_if(F.col("base") == b).alias(b) for b in "ACGT"]))
    whole = bases.groupBy("filter").agg(F.min("_c").alias("_lo"), F.max("_c").alias("_hi"), F.min("coverage").alias("nsites"))
    grid = whole.withColumn("_c", F.explode(F.sequence("_lo", "_hi"))).join(bases, ["filter", "_c"], "left")
    share_of = [x for b in "ACGT" for x in (F.lit(b), F.coalesce(F.col(b) / F.col("coverage"), F.lit(0.25)))]
    return grid.select("filter", (F.col("_c") - F.col("_lo")).cast("long").alias("pos"),
                       F.explode(F.create_map(*share_of)).alias("base", "prob"),
                       F.coalesce("coverage", F.lit(0)).alias("coverage"), "nsites")


def top_subsequences(seqs: DataFrame, filters: Filters, k: int = 10, key: str = "id", seq: str = "seq") -> DataFrame:
    """The k windows of highest activation per filter: filter, rank, key, start, activation, subsequence.

    Each batch gives its own best k per filter (ties by key, then position), so the ranking sees
    at most k rows per filter and batch.
    """
    key_type = seqs.schema[key].dataType.simpleString()

    def best(batches):
        for pdf in batches:
            for part, row, out_pos, act in _activation_rows(filters, pdf, [key]):
                for f in range(filters.n):
                    values = act(f)
                    order = np.lexsort((out_pos, part[key].to_numpy()[row], -values))[:k]
                    first = out_pos[order] * filters.stride - filters.pad
                    texts = part["_seq"].to_numpy()[row[order]]
                    cols = first[:, None] + np.arange(filters.width) * filters.dilation
                    yield pd.DataFrame({
                        key: part[key].to_numpy()[row[order]], "filter": f, "activation": values[order],
                        "out_pos": out_pos[order],
                        "start": [int(c[(c >= 0) & (c < len(t))][0]) if ((c >= 0) & (c < len(t))).any() else -1
                                  for c, t in zip(cols, texts)],
                        "subsequence": ["".join(t[x] for x in c if 0 <= x < len(t)) for c, t in zip(cols, texts)]})

    src = seqs.select(key, F.upper(F.col(seq)).alias("_seq"))
    found = src.mapInPandas(best, f"`{key}` {key_type}, filter int, activation double, out_pos long, start long, "
                                  "subsequence string").where(F.col("subsequence") != "")
    order = Window.partitionBy("filter").orderBy(F.desc("activation"), key, "out_pos")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("filter", F.col("rank").cast("long").alias("rank"), key, "start", "activation", "subsequence"))


def scan_region(regions: DataFrame, scorer: WeightScorer, key: str = "id", seq: str = "seq", width: int = 50,
                step: int = 25, refs: int = 0, seed=42) -> DataFrame:
    """Windows of regions with genome coordinates, a score and an attribution per window.

    regions has key, chrom, start and the sequence. With refs > 0 attributions are against that many
    shuffles of the window, otherwise input x weight.
    """
    wins = dna.tile(regions.select(key, "chrom", F.col("start").alias("_s"), F.col(seq).alias("_q")), "_q", width, step)
    wins = wins.select(key, "chrom", (F.col("_s") + F.col("win_start")).alias("start"),
                       (F.col("_s") + F.col("win_start") + width).alias("end"), F.col("win").alias("sequence"))
    wins = wins.withColumn("prediction", scorer(F.col("sequence")))
    if not refs:
        return attribute(wins, scorer, "sequence", method="input_x_weight")
    named = wins.withColumn("_k", F.concat_ws(":", F.col(key).cast("string"), F.col("start").cast("string")))
    return attribute(with_shuffles(named, "_k", refs, seed, "sequence"), scorer, "sequence").drop("_k", "refs")


__all__ = ["Filters", "attribute", "attribution_sums", "call_seqlets", "filter_maxima", "filter_pfm", "filter_summary",
           "high_activations", "long_attribution", "scan_region", "top_subsequences", "with_shuffles"]
