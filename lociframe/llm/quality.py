"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; cyclic boosting visits the features in turn and adds a shallow
tree (at most three leaves) over the bins of one feature, so the model ends as one lookup table per
feature. The pairs of features that explain most of what is left then get two-dimensional tables, grown
by trees of one cut per axis. A score is a sum of table entries, taken for a whole batch at once.

Fitting takes at most `rows` labelled rows, those of the smallest hash of their id (a documented bound).
Their features are found in Spark; the bags are fitted in one task each, from bounded rows.

A null or empty text has zero in every feature and gets a score like any other. Labels that are null or of
unknown documents are left out; several labels of one document all count. Without labels every score is 0.5.
Other columns of a table are carried along untouched where the result keeps them.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = ("log_chars", "log_words", "word_length", "space", "digit", "upper", "mark", "symbol", "wide", "bang", "bar",
            "distinct_words", "distinct_pairs", "top_word", "short_words", "upper_words", "marked_words", "log_lines", "distinct_lines", "line_words")
ROWS, BAGS, BINS, COARSE, PAIRS = 20_000, 4, 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.1


def _classes() -> np.ndarray:
    """Kind of each byte: 0 letter, 1 white space, 2 digit, 3 upper case, 4 mark, 5 symbol, 6 not ASCII, 7 `!`, 8 `|`."""
    kind = np.zeros(256, np.uint8)
    for b in range(128):
        c = chr(b)
        kind[b] = 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isupper() else 0 if c.islower() else 4 if c in ".,;:?'\"-()" else 7 if c == "!" else 8 if c == "|" else 5
    kind[128:] = 6
    return kind


_KIND = _classes()


def features_of(text: str | None) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    share = np.bincount(_KIND[raw], minlength=9) / len(raw)
    n = len(words)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    short = sum(k for w, k in seen.items() if len(w) <= 3)
    upper = sum(k for w, k in seen.items() if w.isupper())
    marked = sum(k for w, k in seen.items() if not w[-1].isalnum())
    lines = [x for x in text.split("\n") if x]
    return [float(np.log1p(len(text))), float(np.log1p(n)), (len(text) - share[1] * len(raw)) / n, *share[[1, 2, 3, 4, 5, 6, 7, 8]].tolist(),
            len(seen) / n, len(set(zip(words, words[1:]))) / max(1, n - 1), max(seen.values()) / n, short / n, upper / n, marked / n,
            float(np.log1p(len(lines))), len(set(lines)) / max(1, len(lines)), n / max(1, len(lines))]


def matrix(texts) -> np.ndarray:
    return np.array([features_of(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(text: pd.Series) -> pd.Series:
    return pd.Series(list(matrix(text)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Step of each bin: the best cuts of sums of gradients g and weights h into at most `leaves` runs of bins."""
    out, parts = np.zeros(len(g)), [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for i, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b]) + 1e-9
            lg, lh, rg, rh = cg[:-1], ch[:-1], cg[-1] - cg[:-1], ch[-1] - ch[:-1]
            gain = lg ** 2 / (lh + 1) + rg ** 2 / (rh + 1) - cg[-1] ** 2 / (ch[-1] + 1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), i, a + k + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of each cell of a grid: the best one cut per axis, four leaves."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))

    def corners(c):
        a = c[1:-1, 1:-1]
        left, top, all_ = c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return a, left - a, top - a, all_ - left - top + a
    gs, hs = corners(cg), corners(ch)
    gain = sum(x ** 2 / (y + 1) for x, y in zip(gs, hs))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    step = np.empty_like(g)
    for k, at in enumerate(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        step[at] = gs[k][i, j] / (hs[k][i, j] + 1)
    return float(gain[i, j] - g.sum() ** 2 / (h.sum() + 1)), step


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bin of every value; cuts[j] are the upper borders of feature j."""
    return np.stack([np.searchsorted(np.asarray(c, float), x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, len(cuts)), int)


def boost(x: np.ndarray, y: np.ndarray, cuts: list[list[float]]) -> dict:
    """Lookup tables fitted to rows x and labels y (0 or 1)."""
    b = binned(x, cuts)
    f, n = b.shape[1], [len(c) + 1 for c in cuts]
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    tables, at = [np.zeros(k) for k in n], np.full(len(y), base)

    def residual():
        p = 1 / (1 + np.exp(-at))
        return y - p, p * (1 - p)
    for _ in range(ROUNDS):
        for j in range(f):
            r, w = residual()
            step = RATE * _tree(np.bincount(b[:, j], r, n[j]), np.bincount(b[:, j], w, n[j]))
            tables[j] += step
            at += step[b[:, j]]
    coarse = [np.minimum(b[:, j] * COARSE // n[j], COARSE - 1) for j in range(f)]

    def grid(i, j, v):
        return np.bincount(coarse[i] * COARSE + coarse[j], v, COARSE * COARSE).reshape(COARSE, COARSE)
    r, w = residual()
    gains = sorted(((_pair_tree(grid(i, j, r), grid(i, j, w))[0], i, j) for i in range(f) for j in range(i)), reverse=True)
    pairs = {(i, j): np.zeros((COARSE, COARSE)) for _, i, j in gains[:PAIRS]}
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in pairs.items():
            r, w = residual()
            step = RATE * _pair_tree(grid(i, j, r), grid(i, j, w))[1]
            t += step
            at += step[coarse[i], coarse[j]]
    return {"base": base, "tables": [t.tolist() for t in tables], "pairs": [[i, j, t.tolist()] for (i, j), t in pairs.items()]}


class Model:
    """Lookup tables of several bags; log odds are the mean of their sums."""

    def __init__(self, cuts: list[list[float]], bags: list[dict]):
        self.cuts, self.n, m = cuts, [len(c) + 1 for c in cuts], max(1, len(bags))
        self.base = sum(x["base"] for x in bags) / m
        self.tables = [sum(np.asarray(x["tables"][j]) for x in bags) / m for j in range(len(cuts))] if bags else []
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        for x in bags:
            for i, j, t in x["pairs"]:
                self.pairs[i, j] = self.pairs.get((i, j), 0) + np.asarray(t) / m

    def score(self, x: np.ndarray) -> np.ndarray:
        b = binned(x, self.cuts)
        at = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            at += t[b[:, j]]
        for (i, j), t in self.pairs.items():
            at += t[np.minimum(b[:, i] * COARSE // self.n[i], COARSE - 1), np.minimum(b[:, j] * COARSE // self.n[j], COARSE - 1)]
        return 1 / (1 + np.exp(-at))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, bags: int = BAGS) -> Model:
    """A model of labels (doc_id, label of 0 or 1) from at most `rows` of them."""
    sample = (labels.select(F.col("doc_id").alias("_id"), F.col("label").cast("double").alias("y")).dropna()
              .orderBy(F.xxhash64("_id"), "_id", "y").limit(rows))
    known = (docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
             .select("doc_id", "y", features("text").alias("x")))
    known = known.sparkSession.createDataFrame(known.toPandas(), "doc_id long, y double, x array<double>")  # at most `rows` rows, all small
    edges = [i / BINS for i in range(1, BINS)]
    found = known.agg(*(F.percentile(F.col("x")[j], edges).alias(f"f{j}") for j in range(len(FEATURES)))).first()
    if found[0] is None:
        return Model([[] for _ in FEATURES], [])
    cuts = [sorted(set(c)) for c in found]

    def fit_bag(pdf: pd.DataFrame) -> pd.DataFrame:
        tables = boost(np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy(), cuts)
        return pd.DataFrame({"bag": pdf["bag"].iloc[:1], "model": [json.dumps(tables)]})
    drawn = (known.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
             .filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(bags + 1)) != F.col("bag")))
    fitted = drawn.groupBy("bag").applyInPandas(fit_bag, "bag int, model string").collect()
    return Model(cuts, [json.loads(r["model"]) for r in sorted(fitted)])


def scorer(model: Model):
    """A function of a text column that gives its score."""
    @F.pandas_udf(T.DoubleType())
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(matrix(text)))
    return scored


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score, a double from 0 to 1; a column of that name is replaced."""
    return docs.withColumn("score", scorer(model)("text"))


def quality_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32 of the id as text modulo 3 is not 1."""
    from lociframe.llm.common import text_crc
    return labels.filter(text_crc("doc_id") % 3 != 1).select("doc_id", F.col("quality").alias("label"))
