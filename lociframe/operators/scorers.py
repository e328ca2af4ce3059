"""Scorers: functions from a sequence column to a double column.

A scorer is called with a Column and gives a Column, so that reference and mutant, or forward and
reverse, are scored side by side in one row without a join. Built-in ones work on whole Arrow
batches; any Spark expression or batch function is a scorer too. A sequence that cannot be scored
gives NULL.

`edited` scores a sequence under many small edits; a scorer that knows how its score changes with a base (weights, pairs) does so
without writing the edited sequences out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODES = np.full(256, 4, dtype=np.int8)   # A, C, G, T = 0..3 in either case, anything else 4
for _i, _b in enumerate("ACGT"):
    CODES[ord(_b)] = CODES[ord(_b.lower())] = _i


def encode(seqs: Sequence[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of shape (n, length), mask of the rows that have this length and only A, C, G, T)."""
    fits = np.fromiter((s is not None and len(s) == length for s in seqs), dtype=bool, count=len(seqs))
    text = "".join(s for s, ok in zip(seqs, fits) if ok).encode("ascii", "replace")
    codes = np.full((len(seqs), length), 4, dtype=np.int8)
    codes[fits] = CODES[np.frombuffer(text, dtype=np.uint8)].reshape(-1, length)
    return codes, (codes < 4).all(axis=1)


class Scorer:
    """Base of the scorers that work on batches: subclasses give batch(list of str) -> array of float."""

    def batch(self, seqs: Sequence[str]) -> np.ndarray:
        raise NotImplementedError

    def __call__(self, col) -> Column:
        scorer = self

        @F.pandas_udf("double")
        def score(seqs: pd.Series) -> pd.Series:
            return _nullable(scorer.batch(seqs.tolist()))
        return score(col)

    def over(self, col) -> Column:
        """Scores of an array of sequences, in its order."""
        scorer = self

        @F.pandas_udf("array<double>")
        def score(lists: pd.Series) -> pd.Series:
            sizes = [0 if x is None else len(x) for x in lists]
            flat = _nullable(scorer.batch([s for x in lists if x is not None for s in x])).to_numpy()
            ends = np.cumsum(sizes)
            return pd.Series([flat[e - n:e] for e, n in zip(ends, sizes)], dtype=object)
        return score(col)


def _nullable(values: np.ndarray) -> pd.Series:
    values = pd.Series(np.asarray(values, dtype=float))
    return values.astype(object).where(values.notna(), None) if values.isna().any() else values


class WeightScorer(Scorer):
    """Sum of one weight per position and base, for sequences of one length.

    digits rounds the sums, so that sums equal on paper are equal in every order of addition.
    """

    def __init__(self, weights, bias: float = 0.0, digits: int | None = None):
        self.weights = np.asarray(weights, dtype=float)
        self.bias = float(bias)
        self.digits = digits
        self.length = len(self.weights)

    def by_difference(self, seq: Column, edits: Column, k: int) -> Column:
        """The score of the sequence plus what each edit changes; the edits' numbers follow each other in one array."""
        scorer = self

        @F.pandas_udf("array<double>")
        def score(seqs: pd.Series, lists: pd.Series) -> pd.Series:
            sizes = np.fromiter((0 if x is None else len(x) // k for x in lists), dtype=np.int64, count=len(lists))
            flat = np.concatenate([np.zeros(0, np.int64), *(x for x, n in zip(lists, sizes) if n)]).astype(np.int64).reshape(-1, k)
            values = _nullable(scorer.edit_scores(seqs.tolist(), np.repeat(np.arange(len(seqs)), sizes), flat >> 2, flat & 3)).to_numpy()
            ends = np.cumsum(sizes)
            return pd.Series([values[e - n:e] for e, n in zip(ends, sizes)], dtype=object)
        return score(seq, edits)

    def edit_scores(self, seqs: Sequence[str], rows: np.ndarray, places: np.ndarray, bases: np.ndarray) -> np.ndarray:
        """Score of seqs[rows[e]] with bases[e] put at places[e], which are different places, for every edit e."""
        codes, _ = encode(seqs, self.length)
        short = np.fromiter((s is None or len(s) != self.length for s in seqs), dtype=bool, count=len(seqs))
        unknown = (codes > 3).sum(axis=1)
        inside = (places < self.length).all(axis=1) & ~short[rows]
        rows, places, bases = rows[inside], places[inside], bases[inside]
        old = codes[rows[:, None], places]
        total = self._sum(lambda p: codes[:, p], len(codes), other=0.0)[rows] + self._change(codes, rows, places, bases, old)
        out = np.full(len(inside), np.nan)
        out[inside] = np.where(unknown[rows] == sum((old[:, k] > 3).astype(int) for k in range(old.shape[1])), self._rounded(total), np.nan)
        return out

    def double_scores(self, seqs: Sequence[str], places: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Scores of every sequence with both places of a pair, places[first[p]] and places[second[p]], changed to another base: shape (sequences, pairs, 3, 3),
        by how many steps less one the bases lie after the sequence's own. NaN for a sequence that cannot be scored or a place beyond the length.

        The change of a base is found once for each place; a pair adds two of them and what its own terms change.
        """
        codes, ok = encode(seqs, self.length)
        inside = places < self.length
        at = np.where(inside, places, 0)
        m, n, own = len(codes), len(at), codes[:, at].astype(np.int64)
        other = (own[:, :, None] + np.arange(1, 4)) % 4
        rows, flat = np.repeat(np.arange(m), 3 * n), np.tile(np.repeat(at, 3), m)[:, None]
        change = self._change(codes, rows, flat, other.reshape(-1, 1), np.repeat(own.reshape(-1), 3)[:, None]).reshape(m, n, 3)
        total = self._sum(lambda p: codes[:, p], m, other=0.0)
        both = (total[:, None, None] + change[:, first])[:, :, :, None] + change[:, second][:, :, None, :]
        for p, table in self._joint(at[first], at[second]):
            a, b, x, y = own[:, first[p]], own[:, second[p]], other[:, first[p]], other[:, second[p]]
            both[:, p] += (table[x[:, :, None], y[:, None, :]] - table[x, b[:, None]][:, :, None] - table[a[:, None], y][:, None, :] + table[a, b][:, None, None])
        both = self._rounded(both)
        both[~ok] = np.nan
        both[:, ~(inside[first] & inside[second])] = np.nan
        return both

    def _joint(self, first: np.ndarray, second: np.ndarray):
        """The pairs of places, by number, that have terms of their own, with the terms as a table of codes."""
        return ()

    def _change(self, codes, rows, places, bases, old) -> np.ndarray:
        table = np.hstack([self.weights, np.zeros((self.length, 1))])
        return sum(table[places[:, k], bases[:, k]] - table[places[:, k], old[:, k]] for k in range(places.shape[1]))      # by columns, as few

    def _rounded(self, values: np.ndarray) -> np.ndarray:
        return values if self.digits is None else np.round(values, self.digits) + 0.0

    def batch(self, seqs):
        codes, ok = encode(seqs, self.length)
        return np.where(ok, self._rounded(self._sum(lambda p: codes[:, p], len(codes))), np.nan)

    def _sum(self, column: Callable[[int], np.ndarray], n: int, other: float = np.nan) -> np.ndarray:
        """Sums over the codes that column(place) gives; `other` is the weight of a letter that is no base."""
        table = np.hstack([self.weights, np.full((self.length, 1), other)])
        total = np.full(n, self.bias)
        for p in range(self.length):
            total += table[p, column(p)]
        return total

    def sliding(self, codes: np.ndarray) -> np.ndarray:
        """Scores of all windows of a coded sequence; NaN for one with another letter."""
        n = max(len(codes) - self.length + 1, 0)
        return self._rounded(self._sum(lambda p: codes[p:p + n], n))


class PairScorer(WeightScorer):
    """Weights per position plus terms (pos_i, base_i, pos_j, base_j, value) for pairs of positions."""

    def __init__(self, weights, pairs, bias: float = 0.0, digits: int | None = None):
        super().__init__(weights, bias, digits)
        self.pairs = [tuple(p) for p in pairs]

    def _sum(self, column, n, other=np.nan):
        total = super()._sum(column, n, other)
        for i, a, j, b, value in self.pairs:
            total += value * ((column(i) == a) & (column(j) == b))
        return total

    def _partners(self) -> dict[int, dict[int, np.ndarray]]:
        """Per place its partners, each with the terms of the two as a table of codes."""
        out: dict[int, dict[int, np.ndarray]] = {}
        for i, a, j, b, value in self.pairs:
            for p, x, q, y in {(i, a, j, b), (j, b, i, a)}:
                out.setdefault(p, {}).setdefault(q, np.zeros((5, 5)))[x, y] += value
        return out

    def _joint(self, first, second):
        partners = self._partners()
        for p, (i, j) in enumerate(zip(first.tolist(), second.tolist())):
            if i != j and j in partners.get(i, ()):
                yield p, partners[i][j]

    def _change(self, codes, rows, places, bases, old):
        """A term changes only with an edit of one of its places; one whose places are both edited counts at the lower."""
        total = super()._change(codes, rows, places, bases, old)
        partners = self._partners()
        for slot in range(places.shape[1]):
            order = np.argsort(places[:, slot], kind="stable")
            at = places[order, slot]
            for p, tables in partners.items():
                e = order[np.searchsorted(at, p):np.searchsorted(at, p, "right")]
                for q, table in tables.items():
                    before = codes[rows[e], q]
                    after, touched = before.astype(bases.dtype), np.zeros(len(e), dtype=bool)
                    for other in range(places.shape[1]):
                        meets = places[e, other] == q
                        after, touched = np.where(meets, bases[e, other], after), touched | meets
                    change = table[bases[e, slot], after] - table[old[e, slot], before]
                    total[e] += np.where(touched, 0.0, change) if q < p else change
        return total


class PwmScorer(Scorer):
    """Best log-odds of a motif over all windows of a sequence and, by default, both strands."""

    def __init__(self, log_odds, both_strands: bool = True):
        self.log_odds = np.asarray(log_odds, dtype=float)
        self.both_strands = both_strands
        self.width = len(self.log_odds)

    @classmethod
    def from_probabilities(cls, probs, background=(0.25, 0.25, 0.25, 0.25), pseudocount=0.01, **kw):
        probs, background = np.asarray(probs, float), np.asarray(background, float)
        return cls(np.log2((probs + pseudocount) / (background + pseudocount)), **kw)

    def batch(self, seqs):
        """All sequences of a batch are joined, an N between them, and scanned at once."""
        from lociframe.operators.motifs import _chunks, _joined, strand_scores
        out = np.full(len(seqs), np.nan)
        texts = ["" if s is None else s for s in seqs]
        for lo, hi in _chunks(texts):
            data, starts = _joined(texts[lo:hi])
            codes = CODES[data]
            fwd, rev = strand_scores(codes, self.log_odds)
            best = np.fmax(fwd, rev) if self.both_strands else fwd
            best = np.concatenate([np.where(np.isnan(best), -np.inf, best), np.full(len(codes) - len(best), -np.inf)])
            top = np.maximum.reduceat(best, starts)
            out[lo:hi] = np.where(np.isinf(top), np.nan, top)
        return out


class FunctionScorer(Scorer):
    """A function from a list of sequences to their scores; NaN stands for not scored."""

    def __init__(self, fn: Callable[[Sequence[str]], np.ndarray]):
        self.fn = fn

    def batch(self, seqs):
        return np.asarray(self.fn(seqs), dtype=float) if len(seqs) else np.zeros(0)


class ExpressionScorer:
    """A Spark expression as a scorer; stays in the JVM."""

    def __init__(self, fn: Callable[[Column], Column]):
        self.fn = fn

    def __call__(self, col) -> Column:
        value = self.fn(F.col(col) if isinstance(col, str) else col).cast("double")
        return F.nanvl(value, F.lit(None))

    def over(self, col) -> Column:
        return F.transform(F.col(col) if isinstance(col, str) else col, lambda s: self(s))


def put(seq: Column, place: Column, base: Column) -> Column:
    return F.overlay(seq, base, (place + 1).cast("int"), F.lit(1))


def edited(df: DataFrame, scorer, seq: Column, edits: Column, k: int, out: str) -> DataFrame:
    """Adds the scores of a sequence under each edit of an array, in its order.

    An edit is an array of k numbers 4 * place + base, of different places. A scorer without a way of its own is given the edited
    sequences. The array is bound by a generator, so that the optimizer moves none of its making into the Python call.
    """
    def written(edit):
        text = seq
        for n in range(k):
            text = put(text, F.shiftright(edit[n], 2), F.substring(F.lit("ACGT"), edit[n] % 4 + 1, F.lit(1)))
        return text

    known = hasattr(scorer, "by_difference")
    df = df.withColumn("_edits", F.explode(F.array(F.flatten(edits) if known else F.transform(edits, written))))
    return df.withColumn(out, scorer.by_difference(seq, F.col("_edits"), k) if known else scorer.over(F.col("_edits"))).drop("_edits")


def score(df: DataFrame, scorer, col: str = "seq", out: str = "score") -> DataFrame:
    """Adds a score column. Rows are scored where they are, without a shuffle."""
    return df.withColumn(out, scorer(F.col(col)))


def score_distinct(df: DataFrame, scorer, col: str = "seq", out: str = "score") -> DataFrame:
    """Adds a score column, scoring each distinct sequence once; for costly scorers and many copies."""
    table = df.select(col).distinct().withColumn(out, scorer(F.col(col)))
    return df.join(table, col, "left")
