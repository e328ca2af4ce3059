"""Tracks and spaced hits inside the scan of a genome, against loops."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lociframe.operators import tracks as tr
from lociframe.operators.genome import with_halo
from lociframe.operators.scorers import FunctionScorer, PairScorer, PwmScorer, WeightScorer

BIN = 64


def genome_of(spark, texts):
    rows = [(c, b, t[b * BIN:(b + 1) * BIN]) for c, t in texts.items() for b in range(-(-len(t) // BIN))]
    return spark.createDataFrame(rows, "chrom string, bin long, seq string").repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    def letters(n, letters="ACGT"):
        return "".join(rng.choice(letters) for _ in range(n))
    return {"a": letters(500), "b": letters(100, "ACGTNac"), "c": letters(5), "d": "N" * 70 + letters(60) + "n" * 130, "e": letters(BIN * 2), "f": "A" * 300}


def weights(n):
    rng = np.random.default_rng(n)
    return rng.integers(-8, 8, (n, 4)) / 4


@given(st.lists(st.one_of(st.just(float("nan")), st.floats(-5, 5)), max_size=40), st.integers(1, 12))
@settings(deadline=None, max_examples=200)
def test_sliding_minimum_equals_a_loop(values, k):
    clean = [np.inf if v != v else v for v in values]
    assert tr.sliding_minimum(np.array(values, float), k).tolist() == [min(clean[i:i + k]) for i in range(len(values) - k + 1)]


@pytest.mark.parametrize("placed, width, step, start", [(4, 10, 3, 0), (4, 10, 20, 5), (7, 7, 1, 0), (3, 60, 64, 130), (5, 65, 7, 0)])
@pytest.mark.parametrize("kind", ["weights", "pairs", "motif", "function"])
def test_window_minima_equal_a_loop(spark, rows, texts, kind, placed, width, step, start):
    scorer = {"weights": WeightScorer(weights(placed)), "pairs": PairScorer(weights(placed), [(0, 1, 2, 2, .5)]), "motif": PwmScorer(weights(placed)),
              "function": FunctionScorer(lambda seqs: np.array([np.nan if "N" in s else s.count("G") - s.count("A") for s in seqs], float))}[kind]
    genome = genome_of(spark, texts)
    got = tr.window_minima(with_halo(genome, width - 1, BIN), scorer, placed, width, step, BIN, start)
    want = []
    for c, t in texts.items():
        t = t.upper()
        for w in range(start, len(t) - width + 1, step):
            values = scorer.batch([t[p:p + placed] for p in range(w, w + width - placed + 1)])
            values = values[~np.isnan(values)]
            want.append((c, w, float(values.min()) if len(values) else None))
    order = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)


def test_a_track_shuffles_nothing(spark, texts, tmp_path):
    with_halo(genome_of(spark, texts), 19, BIN).write.parquet(str(tmp_path / "bins"))
    bins = spark.read.parquet(str(tmp_path / "bins"))
    plan = tr.window_minima(bins, WeightScorer(weights(6)), 6, 20, 5, BIN)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    with pytest.raises(ValueError):
        tr.window_minima(bins, WeightScorer(weights(6)), 6, 5, 5, BIN)


def places(text, matrix, margin):
    """(score, pos, strand) of every place of a contig, best strand."""
    w, out = len(matrix), []
    for p in range(margin, len(text) - w + 1 if not margin else len(text) - w - margin):
        codes = ["ACGT".find(x) for x in text[p:p + w].upper()]
        if min(codes) >= 0:
            f = sum(matrix[k][c] for k, c in enumerate(codes))
            r = sum(matrix[w - 1 - k][3 - c] for k, c in enumerate(codes))
            out.append((max(f, r), p, "+" if f >= r else "-"))
    return sorted(out, key=lambda x: (-x[0], -x[1]))


@pytest.mark.parametrize("n, distance, margin", [(4, 10, 0), (3, 25, 12), (50, 1, 3), (1, 5, 0)])
def test_best_spaced_equals_greedy(spark, rows, texts, monkeypatch, n, distance, margin):
    matrix = weights(5)
    lengths = spark.createDataFrame([(c, len(t)) for c, t in texts.items()], "chrom string, length long")
    got = rows(tr.best_spaced(with_halo(genome_of(spark, texts), 4, BIN), matrix, n, distance, BIN, margin, lengths if margin else None),
               "chrom", "pos", "score", "strand")
    want = []
    for c, t in texts.items():
        chosen = []
        for s, p, strand in places(t, matrix, margin):
            if len(chosen) < n and all(abs(p - q[1]) >= distance for q in chosen):
                chosen.append((c, p, s, strand))
        want += chosen
    assert got == sorted(want)


def test_rows_out_of_the_scan_are_bounded_by_the_arguments(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("ACGT") for _ in range(BIN * 500))
    bins = with_halo(genome_of(spark, {"a": text, "b": text[:BIN * 100]}), 4, BIN).repartition(4).cache()
    matrix = weights(5)
    for most in (1, 7, 40):
        found = tr.best_places(bins, matrix, most, BIN)
        assert found.count() <= 4 * 2 * most
        best = sorted(((r["score"], r["pos"], r["strand"]) for r in found.where("chrom = 'a'").collect()), key=lambda x: (-x[0], -x[1]))[:most]
        assert best == places(text, matrix, 0)[:most]


def test_many_contigs_keep_the_state_small(spark, rows, monkeypatch):
    # Every partial result of a task is given out when the state is full; the result stays whole.
    rng = random.Random(2)
    texts = {f"c{i}": "".join(rng.choice("ACGT") for _ in range(90)) for i in range(40)}
    bins = with_halo(genome_of(spark, texts), 4, BIN)
    whole = rows(tr.best_spaced(bins, weights(5), 3, 8, BIN))
    monkeypatch.setattr(tr, "STATE_ROWS", 10)
    monkeypatch.setattr(tr, "_chunks", lambda seqs: ((i, i + 1) for i in range(len(seqs))))
    assert rows(tr.best_spaced(bins, weights(5), 3, 8, BIN)) == whole and len({r[0] for r in whole}) == 40


def test_awkward_genomes(spark, rows):
    empty = spark.createDataFrame([], "chrom string, bin long, bases binary, score long")
    assert rows(tr.window_minima(empty, WeightScorer(weights(3)), 3, 6, 1, BIN)) == []
    assert rows(tr.best_spaced(empty, weights(3), 2, 5, BIN)) == []
    odd = spark.createDataFrame([("x", 0, None, 1), ("y", 0, b"", 1), (None, 0, b"ACGTACGT", 1)], "chrom string, bin long, bases binary, score long")
    assert {r[0] for r in tr.window_minima(odd, WeightScorer(weights(3)), 3, 6, 1, BIN).collect()} == {None}
    assert {r[0] for r in tr.best_spaced(odd, weights(3), 1, 5, BIN).collect()} <= {None}
    with pytest.raises(ValueError):
        tr.best_places(empty, weights(3), 1, BIN, margin=2)
