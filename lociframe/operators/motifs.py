"""Motifs: tables, scanning, p-values, position frequency matrices.

A motif table has motif, pos, base, prob, optionally bg. Motif sets are small by nature; they
are brought to the driver behind a size check and sent with the scanning tasks. Sequences never
leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions import dna
from lociframe.operators.evaluation import scored, with_prefix
from lociframe.operators.sampling import take_by_hash
from lociframe.operators.scorers import CODES, ExpressionScorer

PSEUDOCOUNT = 0.01
SCALE = 100              # score units of a bit for p-values
CHUNK_BASES = 4_000_000  # bases scanned at once in a task
MAX_MOTIF_ROWS = 1_000_000
BLOCK_WINDOWS = 8192     # windows scored at once with a bank of motifs
BANK_MOTIFS = 512        # motifs of a bank


def log_odds(motifs: DataFrame, pseudocount: float = PSEUDOCOUNT, background: float = 0.25) -> DataFrame:
    """Adds log_odds = log2((prob + p) / (bg + p))."""
    bg = F.coalesce(F.col("bg"), F.lit(background)) if "bg" in motifs.columns else F.lit(background)
    return motifs.withColumn("log_odds", F.log2((F.col("prob") + pseudocount) / (bg + pseudocount)))


def load_matrices(table: DataFrame, value: str = "log_odds", max_rows: int = MAX_MOTIF_ROWS
                  ) -> dict[str, np.ndarray]:
    """A (motif, pos, base, value) table as matrices of width x 4; an error beyond max_rows rows."""
    rows = table.select("motif", "pos", "base", value).limit(max_rows + 1).toPandas()
    if len(rows) > max_rows:
        raise ValueError(f"the motif table has more than {max_rows} rows")
    out = {}
    for name, part in rows.groupby("motif", sort=True):
        matrix = np.zeros((int(part["pos"].max()) + 1, 4))
        matrix[part["pos"].to_numpy(int), part["base"].map("ACGT".index).to_numpy(int)] = part[value]
        out[str(name)] = matrix
    return out


def strand_scores(codes: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of every window on both strands; NaN where a base is not A, C, G, T."""
    w = len(matrix)
    n = max(len(codes) - w + 1, 0)
    table = np.hstack([matrix, np.full((w, 1), np.nan)])
    other = np.hstack([matrix[:, ::-1], np.full((w, 1), np.nan)])   # complement: code 3 - c
    fwd, rev = np.zeros(n), np.zeros(n)
    for k in range(w):
        fwd += table[k, codes[k:k + n]]
        rev += other[k, codes[w - 1 - k:w - 1 - k + n]]
    return fwd, rev


def _chunks(seqs: Sequence[str], bases: int | None = None) -> Iterator[tuple[int, int]]:
    first, size, bases = 0, 0, bases or CHUNK_BASES
    for i, s in enumerate(seqs):
        size += len(s) + 1
        if size >= bases:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(seqs):
        yield first, len(seqs)


def _joined(seqs: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the sequences, each followed by an N, and the start of each."""
    text = "N".join(seqs) + "N"
    lengths = np.fromiter((len(s) + 1 for s in seqs), dtype=np.int64, count=len(seqs))
    return np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8), np.cumsum(lengths) - lengths


_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[[65, 67, 71, 84]] = [84, 71, 67, 65]


def scan_motifs(seqs: DataFrame, matrices: dict[str, np.ndarray], keys: Sequence[str] = ("id",),
                seq: str = "seq", threshold: float | None = None, both: bool = True,
                best_strand_only: bool = False, matched: bool = True, scale: int = SCALE,
                floors: dict[str, int] | None = None) -> DataFrame:
    """Windows of every sequence scored with every motif.

    One row per motif, window and strand with a score of at least threshold (None: all): keys,
    motif, start and stop (1-based, inclusive), strand, score, iscore (the score in whole 1/scale
    bits, for hit_pvalues) and the matched text as read on the hit's strand. Windows with another
    letter than A, C, G, T are left out. best_strand_only keeps the better strand of a
    window, the forward one on ties. floors gives a motif's least iscore (pvalue_floors); a motif that is not in it gives
    nothing. Whole batches are scanned at once; nothing is shuffled.
    """
    keys = list(keys)
    matrices = {k: np.asarray(m, dtype=float) for k, m in matrices.items()}
    floor = -np.inf if threshold is None else float(threshold)
    src = seqs.select(*keys, F.upper(F.col(seq)).alias("_seq"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_seq")
    schema = (f"{fields}, motif string, start long, stop long, strand string, score double, iscore long"
              + (", matched string" if matched else ""))

    def rows(part, data, starts, codes, name, matrix):
        w = len(matrix)
        whole = np.rint(matrix * scale)
        fwd, rev = strand_scores(codes, matrix)
        ifwd, irev = strand_scores(codes, whole)
        least = -np.inf if floors is None else floors.get(name, np.inf)
        take = [("+", fwd, ifwd, (fwd >= floor) & (ifwd >= least)), ("-", rev, irev, (rev >= floor) & (irev >= least))][:2 if both else 1]
        if best_strand_only and both:
            plus = fwd >= rev
            take = [("+", fwd, ifwd, take[0][3] & plus), ("-", rev, irev, take[1][3] & ~plus)]
        for strand, values, whole_values, keep in take:
            at = np.flatnonzero(keep)
            if not len(at):
                continue
            row = np.searchsorted(starts, at, side="right") - 1
            out = part[keys].iloc[row].reset_index(drop=True)
            out["motif"] = name
            out["start"] = at - starts[row] + 1
            out["stop"] = out["start"] + w - 1
            out["strand"] = strand
            out["score"] = values[at]
            out["iscore"] = whole_values[at].astype(np.int64)
            if matched:
                text = np.lib.stride_tricks.sliding_window_view(data, w)[at]
                if strand == "-":
                    text = _COMPLEMENT[text[:, ::-1]]
                out["matched"] = np.ascontiguousarray(text).view(f"S{w}").ravel().astype(str)
            yield out

    def scan(batches):
        for pdf in batches:
            pdf = pdf[pdf["_seq"].notna()]
            texts = pdf["_seq"].tolist()
            for lo, hi in _chunks(texts):
                data, starts = _joined(texts[lo:hi])
                codes = CODES[data]
                for name, matrix in matrices.items():
                    yield from rows(pdf.iloc[lo:hi], data, starts, codes, name, matrix)

    return src.mapInPandas(scan, schema)


WORD = 6        # bases that are looked up at once


def _words(codes: np.ndarray, length: int) -> np.ndarray:
    """The words of a length from every place, as numbers in base 5."""
    n = max(len(codes) - length + 1, 0)
    out = np.zeros(n, np.int32)
    for k in range(length):
        out *= 5
        out += codes[k:k + n]
    return out


def _word_tables(whole: np.ndarray) -> list[np.ndarray]:
    """For every WORD columns of a matrix of whole numbers the sum of each word; far below all scores where a base is not A, C, G, T."""
    tables = []
    for at in range(0, len(whole), WORD):
        table = np.zeros(1, np.int64)
        for column in whole[at:at + WORD]:
            table = (table[:, None] + np.append(column, -(1 << 40))[None, :]).ravel()
        tables.append(table)
    return tables


def score_counts(seqs: DataFrame, matrices: dict[str, np.ndarray], seq: str = "seq", both: bool = True, scale: int = SCALE) -> DataFrame:
    """(motif, iscore, n): how many windows of all sequences have a score, on both strands, as scan_motifs without a threshold finds them.

    A task looks its windows up in words of bases and counts the scores of a motif in one array of their range; a row per task, motif and
    score is added up.
    """
    matrices = {name: np.rint(np.asarray(m, dtype=float) * scale).astype(np.int64) for name, m in matrices.items()}

    def count(batches):
        kinds = [(name, len(m), int(m.min(axis=1).sum()) - 1, int(m.max(axis=1).sum()), _word_tables(strand))
                 for name, m in matrices.items() for strand in ((m, m[::-1, ::-1]) if both else (m,))]
        totals = {name: np.zeros(high - below + 1, np.int64) for name, _, below, high, _ in kinds}
        for pdf in batches:
            texts = pdf["_seq"].dropna().tolist()
            for lo, hi in _chunks(texts):
                codes = CODES[_joined(texts[lo:hi])[0]]
                words = {n: _words(codes, n) for n in {min(WORD, w - at) for _, w, *_ in kinds for at in range(0, w, WORD)}}
                for name, w, below, _, tables in kinds:
                    n = max(len(codes) - w + 1, 0)
                    score = np.zeros(n, np.int64)
                    for k, table in enumerate(tables):
                        score += table[words[min(WORD, w - k * WORD)][k * WORD:k * WORD + n]]
                    totals[name] += np.bincount(np.maximum(score, below) - below, minlength=len(totals[name]))
        for name, below in {name: below for name, _, below, *_ in kinds}.items():
            found = np.flatnonzero(totals[name][1:]) + 1       # the first place holds the windows that are not valid
            yield pd.DataFrame({"motif": name, "iscore": found + below, "n": totals[name][found]})

    counted = seqs.select(F.upper(F.col(seq)).alias("_seq")).mapInPandas(count, "motif string, iscore long, n long")
    return counted.groupBy("motif", "iscore").agg(F.sum("n").alias("n"))


def best_strand(hits: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """One hit per motif, sequence and start: the better strand, the forward one on ties."""
    group = [*keys, "motif", "start"]
    rest = [c for c in hits.columns if c not in group]
    order = F.struct((-F.col("score")).alias("s"), (F.col("strand") != "+").alias("r"))
    return hits.groupBy(*group).agg(F.min_by(F.struct(*rest), order).alias("h")).select(*group, "h.*")


def null_distribution(motifs: DataFrame, scale: int = SCALE) -> DataFrame:
    """(motif, iscore, p_value): the chance that a random window scores at least iscore.

    motifs has motif, pos, base, log_odds and optionally bg. The sum over the columns of a motif, each
    rounded to 1/scale bit, is built column by column.
    """
    table = motifs.select("motif", "pos", "base", "log_odds",
                          (F.col("bg") if "bg" in motifs.columns else F.lit(0.25)).alias("bg"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        low, probs = 0, np.ones(1)
        for _, column in pdf.groupby("pos", sort=True):
            steps = np.rint(column["log_odds"].to_numpy() * scale).astype(int)
            weight = column["bg"].to_numpy()
            new = np.zeros(len(probs) + steps.max() - steps.min())
            for s, p in zip(steps, weight / weight.sum()):
                off = s - steps.min()
                new[off:off + len(probs)] += p * probs
            low, probs = low + steps.min(), new
        tail = np.minimum(probs[::-1].cumsum()[::-1], 1.0)
        reached = np.flatnonzero(probs > 0)
        return pd.DataFrame({"motif": pdf["motif"].iloc[0], "iscore": reached + low, "p_value": tail[reached]})

    return table.groupBy("motif").applyInPandas(build, "motif string, iscore long, p_value double")


def pvalue_floors(motifs: DataFrame, threshold: float = 1e-4, scale: int = SCALE) -> dict[str, int]:
    """For each motif the least iscore whose p-value is at or below the threshold; motifs that reach none are left out."""
    found = null_distribution(motifs, scale).where(F.col("p_value") <= threshold).groupBy("motif").agg(F.min("iscore").alias("least"))
    return {r["motif"]: r["least"] for r in found.collect()}      # one row per motif, as the matrices


def hit_pvalues(hits: DataFrame, motifs: DataFrame, threshold: float = 1e-4, scale: int = SCALE) -> DataFrame:
    """Adds p_value to the hits and keeps those at or below the threshold."""
    return (hits.join(null_distribution(motifs, scale), ["motif", "iscore"])
            .where(F.col("p_value") <= threshold))


def top_hits(hits: DataFrame, n: int = 500) -> DataFrame:
    """The n hits of smallest p-value; a top-k, never a full sort."""
    return hits.orderBy("p_value", F.desc("score")).limit(n)


def score_per_sequence(hits: DataFrame, seqs: DataFrame, key: str = "id", how: str = "max") -> DataFrame:
    """Max or mean hit score of every sequence, 0 for one without a hit."""
    agg = {"max": F.max, "mean": F.avg}[how]("score").alias("score")
    return (seqs.select(key).join(hits.groupBy(key).agg(agg), key, "left")
            .select(key, F.coalesce("score", F.lit(0.0)).alias("score")))


def score_at(hits: DataFrame, position: int, seqs: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Max score over the hits that cover a 1-based position; 0 for the sequences without one."""
    found = (hits.where((F.col("start") <= position) & (F.col("stop") >= position))
             .groupBy(key).agg(F.max("score").alias("score")))
    if seqs is None:
        return found
    return seqs.select(key).join(found, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def window_length_at(width: int, even: bool = False) -> int:
    """Length of a window in which every placement covering the centre fits: 2w - 1; 2w - 2 when even."""
    return 2 * width - 2 if even else 2 * width - 1


WINDOWS_A_ROW = 1 << 18     # that an expression scores in one array; the scores of a shorter sequence are added up in order


def best_window(df: DataFrame, scorer, width: int, key: str = "id", col: str = "seq",
                all_scores: bool = False) -> DataFrame:
    """Per sequence the best window: best_idx, best_seq, max_score, mean_score, n_windows, and optionally
    the scores of all windows in order. The first window wins a tie; NULLs when no window is valid.

    A scorer that can slide (weights, pairs) takes whole sequences and nothing is shuffled. An expression scores the windows of a chunk
    of a sequence in the row, and a row per chunk is reduced. For any other one, windows stream out of the sequences, are scored and
    reduced before the shuffle, which sorts them.
    """
    if getattr(scorer, "length", None) == width and hasattr(scorer, "sliding"):
        return _slide_best(df, scorer, width, col, all_scores)
    if isinstance(scorer, ExpressionScorer):
        chunks = dna.chunked(df.select(key, F.col(col).alias("_s")), "_s", width, (WINDOWS_A_ROW,))
        return df.join(_best_of_chunks(chunks, scorer, width, key, all_scores), key, "left")
    wins = dna.tile(df.select(key, F.col(col).alias("_s")), "_s", width).withColumn("score", scorer(F.col("win")))
    wins = scored(wins)
    aggs = [F.min_by(F.struct("win_start", "win", "score"), F.struct((-F.col("score")).alias("s"), "win_start")).alias("b"),
            F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n_windows")]
    if all_scores:
        aggs.append(F.transform(F.sort_array(F.collect_list(F.struct("win_start", "score"))),
                                lambda x: x["score"]).alias("all_scores"))
    best = wins.groupBy(key).agg(*aggs)
    out = best.select(key, F.col("b.win_start").cast("long").alias("best_idx"), F.col("b.win").alias("best_seq"),
                      F.col("b.score").alias("max_score"), "mean_score", "n_windows",
                      *(["all_scores"] if all_scores else []))
    return df.join(out, key, "left")


def _best_of_chunks(chunks: DataFrame, scorer: ExpressionScorer, width: int, key: str, all_scores: bool) -> DataFrame:
    """best_window's columns per key out of dna.chunked: the scores of a chunk are an array, NULL for windows that are not valid."""
    wins = F.transform(F.sequence(F.lit(0), F.octet_length("_text") - width), lambda i: dna.cut("_text", i, width))
    scores = F.transform(wins, lambda w: F.when(dna.has_only_acgt(w), scorer(w)))
    # Bound by generators, so that a chunk is cut once for its windows, and they are scored once for all that is taken from them.
    bound = chunks.withColumn("_text", F.explode(F.array("_text"))).withColumn("_scores", F.explode(F.array(scores))).withColumn("_max", F.array_max("_scores")).where("_max is not null")
    at = F.array_position("_scores", F.col("_max")) - 1
    valid = F.array_compact("_scores")
    rows = bound.select(key, F.col("_max").alias("score"), (F.col("_at") + at).cast("long").alias("best_idx"), dna.cut("_text", at, width).alias("win"),
                        F.size(valid).cast("long").alias("_n"), F.aggregate(valid, F.lit(0.0), lambda a, x: a + x).alias("_sum"),
                        *([F.col("_at"), valid.alias("_valid")] if all_scores else []))
    aggs = [F.min_by(F.struct("best_idx", "win", "score"), F.struct((-F.col("score")).alias("s"), "best_idx")).alias("b"),
            F.sum("_sum").alias("_sum"), F.sum("_n").alias("n_windows")]
    if all_scores:
        aggs.append(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_valid"))), lambda x: x["_valid"])).alias("all_scores"))
    return rows.groupBy(key).agg(*aggs).select(
        key, "b.best_idx", F.col("b.win").alias("best_seq"), F.col("b.score").alias("max_score"), (F.col("_sum") / F.col("n_windows")).alias("mean_score"),
        "n_windows", *(["all_scores"] if all_scores else []))


def _slide_best(df: DataFrame, scorer, width: int, col: str, all_scores: bool) -> DataFrame:
    fields = "best_idx long, max_score double, mean_score double, n_windows long" + (
        ", all_scores array<double>" if all_scores else "")

    @F.pandas_udf(f"struct<{fields.replace(' ', ':').replace(',:', ',')}>")
    def slide(seqs: pd.Series) -> pd.DataFrame:
        parts = [pd.DataFrame({c.split()[0]: [] for c in fields.split(", ")})]
        texts = ["" if s is None else s for s in seqs]
        for lo, hi in _chunks(texts):
            data, starts = _joined(texts[lo:hi])
            scores = np.full(len(data), np.nan)
            values = scorer.sliding(CODES[data])
            scores[:len(values)] = values
            ok = ~np.isnan(scores)      # a window that reaches into the next sequence holds an N
            n = np.add.reduceat(ok, starts, dtype=np.int64)
            best = np.maximum.reduceat(np.where(ok, scores, -np.inf), starts)
            total = np.add.reduceat(np.where(ok, scores, 0.0), starts)
            owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(data))))
            at = np.flatnonzero(ok & (scores == best[owner]))
            rows, first = np.unique(owner[at], return_index=True)
            idx = np.full(len(starts), -1, dtype=np.int64)
            idx[rows] = at[first] - starts[rows]
            found = n > 0
            part = pd.DataFrame({
                "best_idx": pd.Series(idx).where(found).astype("Int64"), "max_score": np.where(found, best, np.nan),
                "mean_score": np.where(found, total / np.maximum(n, 1), np.nan), "n_windows": pd.Series(n).where(found).astype("Int64")})
            part["max_score"] = part["max_score"].astype("Float64").where(found)
            part["mean_score"] = part["mean_score"].astype("Float64").where(found)
            if all_scores:
                ends = np.append(starts[1:], len(data))
                part["all_scores"] = [scores[s:e][ok[s:e]] if k else None for s, e, k in zip(starts, ends, found)]
            parts.append(part)
        return pd.concat(parts[1:] or parts, ignore_index=True)

    out = df.withColumn("_b", slide(F.upper(F.col(col))))
    text = F.substring(F.col(col), (F.col("_b.best_idx") + 1).cast("int"), F.lit(width))
    return out.select(*df.columns, "_b.best_idx", F.upper(text).alias("best_seq"), "_b.max_score", "_b.mean_score",
                      "_b.n_windows", *(["_b.all_scores"] if all_scores else []))


def _groups(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group, rows of equal values being one, and a row of each group."""
    group = np.zeros(rows, np.int64)
    for c in columns:
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, group = np.unique(group * (int(code.max()) + 1) + code, return_inverse=True)
    _, first = np.unique(group, return_index=True)
    return group, first


def pfm(df: DataFrame, col: str = "seq", by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares per position and base of sequences of one length; every base is listed.

    Bases are counted a batch at a time, so no letter becomes a row, and then within each task: the shuffle holds length x 4 rows per task and group.
    """
    by = list(by)
    names = [f"_by_{i}" for i in range(len(by))]
    src = df.where(F.col(col) != "").select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.upper(F.col(col)).alias("_seq"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])

    def counted(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            group, first = _groups([batch.column(n) for n in names], batch.num_rows)
            texts = batch.column("_seq").to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            data = np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)
            pos = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            longest = int(sizes.max())
            at = np.repeat(group, sizes) * longest + pos
            if len(first) * longest <= len(data):
                place = np.arange(len(first) * longest)
            else:       # a long text among short ones makes no large table
                place, at = np.unique(at, return_inverse=True)
            n = np.bincount(at * 5 + CODES[data], minlength=5 * len(place)).reshape(-1, 5)
            there = np.flatnonzero(n.any(axis=1))
            place, n = place[there], n[there]
            rows = pa.array(first[place // longest])
            yield pa.RecordBatch.from_arrays([*[batch.column(x).take(rows) for x in names], pa.array(place % longest), *[pa.array(n[:, k]) for k in range(4)]],
                                             names=[*names, "pos", *"ACGT"])

    parts = src.mapInArrow(counted, f"{kinds}pos long, A long, C long, G long, T long")
    wide = parts.groupBy(*[F.col(n).alias(c) for n, c in zip(names, by)], "pos").agg(*[F.sum(b).alias(b) for b in "ACGT"])
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    return (wide.withColumn("_t", total)
            .select(*by, F.col("pos").cast("long").alias("pos"), "_t", F.explode(F.create_map(
                *[x for b in "ACGT" for x in (F.lit(b), F.col(b))])).alias("base", "n"))
            .select(*by, "pos", "base", "n", F.when(F.col("_t") > 0, F.col("n") / F.col("_t")).alias("prob")))


def information(matrix: DataFrame, pseudocount: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    """Adds bits, a position's information content against even bases, and height = prob * bits.

    With a pseudocount, prob is taken from the counts n with the pseudocount added to each base.
    """
    by = list(by)
    wide = matrix.groupBy(*by, "pos").agg(
        *[F.max(F.when(F.col("base") == b, F.col("n") + pseudocount)).alias(b) for b in "ACGT"])
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")

    def term(b):
        p = F.col(b) / total
        return F.when(p > 0, p * (F.log2(p) + 2.0)).otherwise(0.0)

    bits = term("A") + term("C") + term("G") + term("T")
    return (wide.withColumn("bits", bits)
            .select(*by, "pos", "bits", F.explode(F.create_map(
                *[x for b in "ACGT" for x in (F.lit(b), F.col(b) / total)])).alias("base", "prob"))
            .withColumn("height", F.col("prob") * F.col("bits")))


def take_extreme(df: DataFrame, n: Column, key: str, score: str = "score", highest: bool = True, seed=42) -> DataFrame:
    """The n rows of highest or lowest score; rows tied at the border are drawn in hash order.

    n may be a scalar column, such as a tenth of a count. Scores are counted per distinct value, the
    border score is found from prefix sums, and only the rows tied there are ranked.
    """
    value = F.col(score).cast("double") * (-1.0 if highest else 1.0)
    rows = scored(df, score).withColumn("_v", value)
    points = with_prefix(rows.groupBy("_v").agg(F.count(F.lit(1)).alias("_c")), [], "_v", ["_c"])
    border = points.where((F.col("_c_before") < n) & (n <= F.col("_c_before") + F.col("_c"))).select(
        F.col("_v").alias("at"), (n - F.col("_c_before")).alias("quota"))
    edge = border.agg(F.max("at")).scalar()
    sure = rows.where((F.col("_v") < edge) | (edge.isNull() & (n > 0)))
    tied = take_by_hash(rows.where(F.col("_v") == edge), key, seed,
                        border.agg(F.coalesce(F.max("quota"), F.lit(0)).alias("quota")))
    return sure.unionByName(tied).drop("_v")


def pfm_contrast(df: DataFrame, key: str = "id", col: str = "seq", score: str = "score", parts: int = 10) -> DataFrame:
    """PFMs of the best and worst tenth (n // 10 rows, at least one) and their difference."""
    n = scored(df, score).agg(F.greatest(F.expr(f"count(1) div {parts}"), F.lit(1).cast("long"))).scalar()
    top = pfm(take_extreme(df, n, key, score), col).select("pos", "base", F.col("prob").alias("top"))
    low = pfm(take_extreme(df, n, key, score, highest=False), col).select("pos", "base", F.col("prob").alias("bottom"))
    return top.join(low, ["pos", "base"]).withColumn("difference", F.col("top") - F.col("bottom"))


def consensus(motifs: DataFrame) -> DataFrame:
    """(motif, consensus): the most probable base per position, the first of A, C, G, T on ties."""
    best = motifs.groupBy("motif", "pos").agg(
        F.min_by("base", F.struct((-F.col("prob")).alias("p"), "base")).alias("base"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "base")))   # one entry per position
    return best.groupBy("motif").agg(F.array_join(F.transform(ordered, lambda x: x["base"]), "").alias("consensus"))


def best_in_bank(spans: DataFrame, matrices: dict[str, np.ndarray], keys: Sequence[str], seq: str = "span_seq", scale: int = SCALE) -> DataFrame:
    """keys, motif, iscore and n: the best whole score (1/scale bits) of a motif over the windows of a span and both strands, and their number.

    Motifs of one width form a bank, a matrix with a column per motif and strand; the windows of a block of spans, one-hot, times
    the bank give all scores at once, and the maximum per span is taken before anything leaves the task. So one row per span and motif
    comes out, however many windows a span has, and the arrays are bounded by BLOCK_WINDOWS and BANK_MOTIFS. Whole scores
    make the products exact. Windows with another letter than A, C, G, T are left out, and a span without a window of a
    motif has no row for it.
    """
    keys = list(keys)
    named = {k: f"_key_{i}" for i, k in enumerate(keys)}
    src = spans.select(*[F.col(k).alias(v) for k, v in named.items()], F.upper(F.col(seq)).alias("_seq"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_seq")
    banks = []
    by_width: dict[int, list[str]] = {}
    for name in sorted(matrices):
        by_width.setdefault(len(matrices[name]), []).append(name)
    for w, names in sorted(by_width.items()):
        for at in range(0, len(names), BANK_MOTIFS):
            some = names[at:at + BANK_MOTIFS]
            whole = [np.rint(np.asarray(matrices[x], float) * scale) for x in some]
            banks.append((w, np.array(some, dtype=object), np.stack([m.reshape(-1) for m in whole] + [m[::-1, ::-1].reshape(-1) for m in whole], axis=1)))

    def scan(batches):
        for pdf in batches:
            pdf = pdf[pdf["_seq"].notna()]
            texts = pdf["_seq"].tolist()
            for lo, hi in _chunks(texts, BLOCK_WINDOWS):
                data, starts = _joined(texts[lo:hi])
                codes = CODES[data].astype(np.int64)
                gaps = np.concatenate([[0], np.cumsum(codes > 3)])
                owner = np.repeat(np.arange(hi - lo), np.diff(np.append(starts, len(codes))))
                part = pdf.iloc[lo:hi].drop(columns="_seq").reset_index(drop=True)
                for w, names, bank in banks:
                    places = np.flatnonzero(gaps[w:] == gaps[:-w]) if len(codes) >= w else np.zeros(0, dtype=np.int64)
                    best = np.full((hi - lo, len(names)), -np.inf)
                    for at in range(0, len(places), BLOCK_WINDOWS):
                        some = places[at:at + BLOCK_WINDOWS]
                        hot = np.zeros((len(some), w, 4))
                        hot[np.arange(len(some))[:, None], np.arange(w), codes[some[:, None] + np.arange(w)]] = 1
                        scores = hot.reshape(len(some), -1) @ bank
                        scores = np.maximum(scores[:, :len(names)], scores[:, len(names):])
                        rows = owner[some]
                        first = np.flatnonzero(np.diff(rows, prepend=-1))
                        best[rows[first]] = np.maximum(best[rows[first]], np.maximum.reduceat(scores, first, axis=0))
                    row = np.unique(owner[places])
                    if len(row):
                        windows = np.bincount(owner[places], minlength=hi - lo)[row]
                        out = part.iloc[np.repeat(row, len(names))].reset_index(drop=True)
                        out["motif"] = np.tile(names, len(row))
                        out["iscore"] = best[row].reshape(-1).astype(np.int64)
                        out["n"] = np.repeat(2 * windows, len(names))
                        yield out

    return src.mapInPandas(scan, f"{fields}, motif string, iscore long, n long").withColumnsRenamed({v: k for k, v in named.items()})


def annotate_spans(spans: DataFrame, motifs: DataFrame, matrices: dict[str, np.ndarray], keys: Sequence[str],
                   seq: str = "span_seq", max_p: float = 0.05, scale: int = SCALE) -> DataFrame:
    """Adds the motif with the smallest p-value over the span's windows and that p-value, corrected for
    the number of windows; the name only when the p-value is below max_p. Spans shorter than every
    motif get NULLs. The smallest p-value of a motif is that of its best score, so only this one is looked up."""
    keys = list(keys)
    best = (best_in_bank(spans, matrices, keys, seq, scale).join(null_distribution(motifs, scale), ["motif", "iscore"])
            .withColumn("motif_p_value", 1.0 - F.pow(1.0 - F.col("p_value"), F.col("n")))
            .groupBy(*keys).agg(F.min_by(F.struct("motif", "motif_p_value"), F.struct("motif_p_value", "motif")).alias("b")))
    return (spans.join(best, keys, "left")
            .withColumn("motif_p_value", F.col("b.motif_p_value"))
            .withColumn("motif", F.when(F.col("motif_p_value") < max_p, F.col("b.motif"))).drop("b"))


def top_motifs(annotated: DataFrame, n: int = 20) -> DataFrame:
    """The motifs named on most spans."""
    return (annotated.where(F.col("motif").isNotNull()).groupBy(F.col("motif").alias("name"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "name").limit(n))
