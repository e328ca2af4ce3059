import math
import re
from collections import Counter

import numpy as np
import pytest

from lociframe.llm import ngram_lm as lm
from pyspark.sql import functions as F


@pytest.mark.parametrize("n", (0, 1, 2, 500, 20_000))
def test_elias_fano_finds_successors(n):
    r = np.random.default_rng(n)
    for top in (n + 1, 1 << 20, 1 << 62):
        values = np.unique(r.integers(0, top, n).astype(np.uint64))
        coded, _ = lm.EliasFano.at(memoryview(lm.EliasFano.code(values)), 0)
        asked = np.concatenate([values, r.integers(0, top, 200).astype(np.uint64), np.array([0, top], np.uint64)])
        assert (coded.successor(asked) == np.searchsorted(values, asked)).all()
        place = np.searchsorted(values, asked)
        want = np.where((place < len(values)) & (values[np.minimum(place, len(values) - 1)] == asked), place, -1) if len(values) else np.full(len(asked), -1)
        assert (coded.find(asked) == want).all()
        if len(values):
            assert (coded.get(np.arange(len(values))) == values).all()


def test_levels_are_compact():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1 << 20, 100_000)).astype(np.uint64)
    assert len(lm.EliasFano.code(values)) < 100_000 * 3.5


def brute(rows):
    cut, low = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [["<s>"] + cut.findall((t or "").translate(low)) + ["</s>"] for _, t, _ in rows]
    one, two, after, kinds = Counter(), Counter(), Counter(), Counter()
    for (_, _, training), w in zip(rows, tokens):
        if training:
            one.update(w[1:])
            for pair in zip(w, w[1:]):
                two[pair] += 1
                after[pair[0]] += 1
    kinds.update(a for a, _ in two)
    n, v = sum(one.values()), len(one)

    def single(w):
        return math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) if n else math.log10(0.1 / 0.1)
    out = []
    for w in tokens:
        score = 0.0
        for a, b in zip(w, w[1:]):
            score += math.log10((two[a, b] - lm.DISCOUNT) / after[a]) if two[a, b] else single(b) + (math.log10(min(1, lm.DISCOUNT * kinds[a] / after[a])) if after[a] else 0)
        out.append((len(w) - 1, sum(one[x] > 0 for x in w[1:]), n, sum(map(single, w[1:])), score))
    return out


@pytest.mark.parametrize("shard_tokens", (1 << 30, 400))
def test_scores_equal_brute_force(spark, prose, shard_tokens):
    rows = [(i, prose(i % 23, 10 + i) + (" THEÄ the" if i % 2 else ""), i % 5 != 0) for i in range(80)]
    rows += [(100, "the " * 500, True), (101, "the " * 50, False), (102, None, True), (103, " \t\n", False), (None, "no id", False), (7, "again", True)]
    rows += rows[:3]
    table = spark.createDataFrame(rows, "doc_id long, text string, training boolean").withColumn("word", F.lit(1)).withColumn("block", F.lit("x"))
    model, scores = lm.learn_and_score(table, shard_tokens)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]), r) for r in scores.collect())
    want = sorted(((d if d is not None else -1, b[0]), *b, t) for (d, _, t), b in zip(rows, brute(rows)))
    assert [k for k, _ in got] == [w[0] for w in want]
    for (_, r), (_, n, known, total, base, score, training) in zip(got, want):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, not training)
        assert abs(r["base_score"] - base) < 1e-6
        if shard_tokens > 1 << 20:
            assert abs(r["score"] - score) < 0.05 * n
    assert (model.count() > 1) == (shard_tokens == 400)
    held = [r for _, r in got if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_context_relative_search():
    contexts = np.array([5, 9, 1 << 60], np.uint64)
    raw = lm.Trie.build(contexts, np.array([0, 2, 3]), np.array([1, 7, 7, 0, 7], np.uint64), np.array([3, 1, 2, 1, 1]), np.array([4, 2, 2]), np.zeros(3, bool))
    trie = lm.Trie(raw)
    value, seen = trie.query(np.array([5, 5, 9, 9, 1 << 60, 6], np.uint64), np.array([1, 2, 7, 1, 0, 7], np.uint64))
    assert seen.tolist() == [True, False, True, False, True, False]
    assert np.allclose(10 ** value, [2.25 / 4, 0.75 * 2 / 4, 1.25 / 2, 0.75 / 2, 0.25 / 2, 1])
    assert trie.successors_of(5) == (0, 2) and trie.successors_of(1 << 60) == (3, 5) and trie.successors_of(6) == (0, 0)


def test_empty_tables_and_no_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, training boolean")
    assert lm.learn_and_score(empty)[1].count() == 0
    none = spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, training boolean")
    r = lm.learn_and_score(none)[1].first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0)


def test_split_contexts_back_off_like_whole_ones(spark, prose):
    """Every token's context is split over more shards than most have successors; unseen pairs go to shards that hold none."""
    rows = [(i, "the " + " the ".join(prose(i, 12).split()), True) for i in range(30)]
    rows += [(1000 + i, " ".join(f"the new{i}x{k}" for k in range(20)), False) for i in range(10)]
    table = spark.createDataFrame(rows, "doc_id long, text string, training boolean")
    model, scores = lm.learn_and_score(table, 20)
    assert model.count() > 20
    got, want = {r["doc_id"]: r["score"] for r in scores.collect()}, {r[0]: (b[0], b[-1]) for r, b in zip(rows, brute(rows))}
    assert all(abs(got[d] - score) < 0.05 * n for d, (n, score) in want.items())


def test_a_word_is_searched_in_its_context_alone():
    """Words of neighbouring contexts, of the first and of the last one are not taken for a context's own."""
    r = np.random.default_rng(3)
    contexts = np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64))
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in contexts]
    starts = np.cumsum([0] + [len(x) for x in sets[:-1]])
    counts = np.ones(sum(map(len, sets)), np.int64)
    trie = lm.Trie(lm.Trie.build(contexts, starts, np.concatenate(sets), counts, np.array([len(x) for x in sets]), np.zeros(len(sets), bool)))
    at, word = r.integers(0, len(contexts), 4000), r.integers(0, 64, 4000).astype(np.uint64)
    _, seen = trie.query(contexts[at], word)
    assert seen.tolist() == [bool((sets[a] == w).any()) for a, w in zip(at, word)]
