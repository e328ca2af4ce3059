import itertools
import math
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lociframe.operators import attribution as at
from lociframe.operators import effects as ef
from lociframe.operators import models as md
from lociframe.operators import motifs as mo
from lociframe.operators.scorers import ExpressionScorer, FunctionScorer, PairScorer, PwmScorer, WeightScorer, score, score_distinct

# Functions of this module are sent to Python workers, which cannot import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RNG = random.Random(11)
PROBS = {"m1": [[.7, .1, .1, .1], [.1, .6, .2, .1], [.1, .1, .1, .7]], "m2": [[.25, .25, .4, .1], [.05, .05, .05, .85]]}


def dna(n, rng=RNG, n_rate=0.0):
    return "".join("N" if rng.random() < n_rate else rng.choice("ACGT") for _ in range(n))


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


@pytest.fixture(scope="module")
def motifs(spark):
    rows = [(m, p, b, x) for m, ps in PROBS.items() for p, row in enumerate(ps) for b, x in zip("ACGT", row)]
    return spark.createDataFrame(rows, "motif string, pos long, base string, prob double")


def lo(m, p, b):
    return math.log2((PROBS[m][p]["ACGT".index(b)] + .01) / .26)


def hits_by_hand(seqs, threshold):
    out = []
    for i, s in seqs:
        for m, ps in PROBS.items():
            w = len(ps)
            for k in range(len(s) - w + 1):
                for strand, t in (("+", s[k:k + w]), ("-", rc(s[k:k + w]))):
                    if "N" not in t:
                        x = sum(lo(m, p, b) for p, b in enumerate(t))
                        if x >= threshold:
                            out.append((i, m, k + 1, k + w, strand, t, round(x, 9)))
    return sorted(out)


def test_scan_equals_a_loop(spark, motifs):
    seqs = [(i, dna(RNG.randrange(0, 60), n_rate=.05)) for i in range(40)] + [(99, "")]
    df = spark.createDataFrame(seqs, "id long, seq string")
    mats = mo.load_matrices(mo.log_odds(motifs))
    for threshold in (1.0, -100.0):
        got = sorted((r["id"], r["motif"], r["start"], r["stop"], r["strand"], r["matched"], round(r["score"], 9))
                     for r in mo.scan_motifs(df, mats, threshold=threshold).collect())
        assert got == hits_by_hand(seqs, threshold)
    both = mo.best_strand(mo.scan_motifs(df, mats)).select("id", "motif", "start", "strand", "score").collect()
    once = mo.scan_motifs(df, mats, best_strand_only=True).select("id", "motif", "start", "strand", "score").collect()
    assert sorted(both) == sorted(once)


def test_chunks_do_not_change_the_scan(spark, motifs, monkeypatch):
    texts = [dna(50), "", dna(3), dna(120)]
    monkeypatch.setattr(mo, "CHUNK_BASES", 60)
    assert [b for _, b in mo._chunks(texts)][-1] == len(texts)
    assert sum(hi - lo_ for lo_, hi in mo._chunks(texts)) == len(texts)


def test_p_values_are_exact_and_monotone(spark, motifs):
    table = mo.log_odds(motifs)
    got = {(r["motif"], r["iscore"]): r["p_value"] for r in mo.null_distribution(table).collect()}
    for m, ps in PROBS.items():
        words = [sum(round(lo(m, p, b) * 100) for p, b in enumerate(w)) for w in itertools.product("ACGT", repeat=len(ps))]
        for s in set(words):
            assert got[(m, s)] == pytest.approx(sum(x >= s for x in words) / len(words))
    assert all(0 < p <= 1 for p in got.values())


def test_scores_per_sequence_and_position(spark):
    hits = spark.createDataFrame([(1, 2, 4, 3.0), (1, 4, 6, 5.0), (2, 9, 11, 1.0)], "id long, start long, stop long, score double")
    seqs = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert sorted(mo.score_per_sequence(hits, seqs).collect()) == [(1, 5.0), (2, 1.0), (3, 0.0)]
    assert sorted(mo.score_per_sequence(hits, seqs, how="mean").collect()) == [(1, 4.0), (2, 1.0), (3, 0.0)]
    assert sorted(mo.score_at(hits, 3, seqs).collect()) == [(1, 3.0), (2, 0.0), (3, 0.0)]
    assert mo.window_length_at(13) == 25 and mo.window_length_at(13, even=True) == 24


WEIGHTS = [[RNG.randrange(-4, 5) / 4 for _ in range(4)] for _ in range(8)]


def additive(s):
    return sum(WEIGHTS[p]["ACGT".index(b)] for p, b in enumerate(s))


def test_scorers_agree_and_leave_out_what_they_cannot_score(spark):
    seqs = [(i, dna(8)) for i in range(20)] + [(20, dna(8))] * 3 + [(30, "ACGTNACG"), (31, "ACG"), (32, None)]
    df = spark.createDataFrame(seqs, "id long, seq string")
    w = WeightScorer(WEIGHTS)
    got = [(r["seq"], r["score"]) for r in score(df, w).collect()]
    for s, x in got:
        assert x == (additive(s) if s and len(s) == 8 and "N" not in s else None)
    distinct = [(r["seq"], r["score"]) for r in score_distinct(df.where("seq is not null"), w).collect()]
    assert sorted(distinct, key=str) == sorted([g for g in got if g[0]], key=str)
    arrays = df.where("seq is not null").groupBy().agg(F.sort_array(F.collect_list("seq")).alias("s"))
    row = arrays.select("s", w.over("s").alias("y")).first()
    assert row["y"] == [additive(s) if len(s) == 8 and "N" not in s else None for s in row["s"]]
    fn = FunctionScorer(lambda xs: np.array([x.count("G") for x in xs], float))
    ex = ExpressionScorer(lambda c: F.length(c) - F.length(F.translate(c, "G", "")))
    for r in score(score(df.where("seq is not null"), fn, out="a"), ex, out="b").collect():
        assert r["a"] == r["b"] == r["seq"].count("G")


@pytest.mark.parametrize("kind", ["slide", "tile"])
def test_best_window_equals_a_loop(spark, kind):
    seqs = [(i, dna(n, n_rate=.03)) for i, n in enumerate((0, 3, 8, 9, 40, 700, 33))] + [(50, "N" * 30)]
    df = spark.createDataFrame(seqs, "id long, seq string")
    scorer = WeightScorer(WEIGHTS)
    use = scorer
    if kind == "tile":
        use = scorer.__call__
    for r in mo.best_window(df, use, 8, all_scores=True).collect():
        s = dict(seqs)[r["id"]]
        wins = [(k, s[k:k + 8]) for k in range(len(s) - 7) if "N" not in s[k:k + 8]]
        if not wins:
            assert r["best_idx"] is None and r["max_score"] is None and r["best_seq"] is None and r["mean_score"] is None
            continue
        k, w = max(wins, key=lambda x: (additive(x[1]), -x[0]))
        assert (r["best_idx"], r["best_seq"], r["max_score"], r["n_windows"]) == (k, w, additive(w), len(wins))
        assert r["mean_score"] == pytest.approx(np.mean([additive(x) for _, x in wins]))
        assert r["all_scores"] == [additive(x) for _, x in wins]


@pytest.mark.parametrize("chunk", [512, 1 << 18])
def test_best_window_of_an_expression_sorts_no_windows(spark, monkeypatch, chunk):
    """Scored in the row, over the borders of chunks, as a loop; the first of equal windows wins, and NULL scores do not count."""
    monkeypatch.setattr(mo, "WINDOWS_A_ROW", chunk, raising=False)
    r = random.Random(12)
    seqs = [(i, "".join(r.choices("ACGTNa", [9, 9, 9, 9, .2, .1], k=n))) for i, n in enumerate((0, 7, 8, 9, 511, 520, 17_000))] + [(50, "N" * 30), (51, None)]
    df = spark.createDataFrame(seqs, "id long, seq string")
    ex = ExpressionScorer(lambda c: F.when(c != "ACGTACGT", (F.length(c) - F.length(F.translate(c, "G", ""))) / 8.0))
    for row in mo.best_window(df, ex, 8, all_scores=True).collect():
        s = dict(seqs)[row["id"]] or ""
        wins = [(s[k:k + 8].count("G") / 8, -k) for k in range(len(s) - 7) if not set(s[k:k + 8]) - set("ACGT") and s[k:k + 8] != "ACGTACGT"]
        if not wins:
            assert row["best_idx"] is None and row["n_windows"] is None
            continue
        top, k = max(wins)
        assert (row["best_idx"], row["best_seq"], row["max_score"], row["n_windows"]) == (-k, s[-k:8 - k], top, len(wins))
        assert row["all_scores"] == [x for x, _ in wins] and row["mean_score"] == pytest.approx(np.mean(row["all_scores"]))
    plan = mo.best_window(df, ex, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" in plan and "win_start" not in plan


@pytest.mark.parametrize("both", [True, False])
def test_scores_are_counted_as_the_scan_finds_them(spark, both):
    r = random.Random(14)
    seqs = [(i, "".join(r.choices("ACGTNa", [9, 9, 9, 9, 1, 1], k=n))) for i, n in enumerate((0, 3, 5, 6, 14, 15, 700, 33))] + [(60, None)]
    df = spark.createDataFrame(seqs, "id long, seq string").repartition(3)
    matrices = {f"m{w}": [[r.uniform(-4, 2) for _ in range(4)] for _ in range(w)] for w in (1, 5, 6, 7, 14)}
    want = mo.scan_motifs(df, matrices, both=both, matched=False).groupBy("motif", "iscore").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, mo.score_counts(df, matrices, both=both).collect())) == sorted(map(tuple, want.collect()))


def test_pwm_scorer_takes_the_best_strand_and_window(spark):
    scorer = PwmScorer.from_probabilities(PROBS["m1"])
    s = dna(30)
    want = max(x for *_, x in hits_by_hand([(0, s)], -99) if _[1] == "m1")
    assert scorer.batch([s, "AC", None])[0] == pytest.approx(want)
    assert np.isnan(scorer.batch([s, "AC", None])[1:]).all()


def test_mutagenesis_is_centred_and_equals_the_scores(spark):
    s = dna(8)
    df = spark.createDataFrame([(1, s)], "id long, seq string")
    w = PairScorer(WEIGHTS, [(0, 1, 5, 2, .5)])
    got = {(r["pos"], r["base"]): r["value"] for r in ef.mutagenesis(df, w).collect()}
    raw = {(r["pos"], r["base"]): (r["original"], r["mutant"]) for r in ef.mutagenesis(df, w, raw=True, start=2, end=5).collect()}
    assert {p for p, _ in raw} == {2, 3, 4} and len(got) == 32
    for p in range(8):
        ys = [w.batch([s[:p] + b + s[p + 1:]])[0] for b in "ACGT"]
        for b, y in zip("ACGT", ys):
            assert got[(p, b)] == pytest.approx(y - np.mean(ys))
            if (p, b) in raw:
                assert raw[(p, b)] == (w.batch([s])[0], y)


def test_epistasis_is_zero_if_additive_and_finds_the_pair(spark):
    df = spark.createDataFrame([(1, "AAAAAAAA")], "id long, seq string")
    flat = ef.epistasis2(df, WeightScorer(WEIGHTS)).collect()
    assert len(flat) == 9 * 28 and max(abs(r["delta_delta"]) for r in flat) < 1e-9
    pairs = ef.epistasis2(df, PairScorer(WEIGHTS, [(2, 1, 6, 3, .8)]))
    top = ef.top_interactions(pairs).collect()
    assert [(r["pos_i"], r["base_i"], r["pos_j"], r["base_j"], round(r["delta_delta"], 9)) for r in top] == [(2, "C", 6, "T", .8)]


def test_third_order_equals_the_formula(spark):
    def fn(seqs):
        return np.array([additive(s) + 2.0 * (s[1] == "C") * (s[3] == "G") * (s[4] == "T") - 3.0 * (s[1] == "G") * (s[3] == "T") * (s[5] == "C") for s in seqs])
    df = spark.createDataFrame([(1, "AAAAAAAA")], "id long, seq string")
    got = {(r["pos_i"], r["pos_j"], r["pos_k"]): round(r["interaction"], 9) for r in ef.epistasis3(df, FunctionScorer(fn), 0, 8).collect()}
    assert got == {(1, 3, 4): 2.0, (1, 3, 5): -3.0}


def test_effect_signs_and_missing_scores(spark):
    df = spark.createDataFrame([("AAAAAAAA", "CAAAAAAA"), ("AAAAAAAA", "NAAAAAAA")], "ref_window string, alt_window string")
    w = WeightScorer(WEIGHTS)
    a, c = additive("AAAAAAAA"), additive("CAAAAAAA")
    out = ef.variant_effect(df, {"model": w, "motif": w, "energy": w}, kind={"motif": "motif", "energy": "energy"}).collect()
    assert [(r["model_dd"], r["motif_dd"], r["energy_dd"]) for r in out] == [(a - c, a - c, c - a), (None, a, None)]


def test_marginalisation_and_strands(spark):
    df = spark.createDataFrame([(1, "AAAAAAAA"), (2, "CCCCCCCC")], "id long, seq string")
    w = WeightScorer(WEIGHTS)
    out = ef.marginalize(df, "GT", w, start=1)
    assert [r["delta"] for r in out.orderBy("id").collect()] == [additive(s[0] + "GT" + s[3:]) - additive(s) for s in ("A" * 8, "C" * 8)]
    row = ef.strand_comparison(df, w).orderBy("id").first()
    assert (row["forward"], row["reverse"]) == (additive("A" * 8), additive("T" * 8))


def test_attributions_add_up(spark):
    df = spark.createDataFrame([(i, dna(8)) for i in range(30)], "id long, seq string")
    w = WeightScorer(WEIGHTS, bias=.3)
    with_refs = at.with_shuffles(df, "id", 6)
    rows = at.attribute(with_refs, w).collect()
    for r in rows:
        assert len(r["refs"]) == 6 and all(sorted(x) == sorted(r["seq"]) for x in r["refs"])
        assert sum(r["attribution"]) == pytest.approx(additive(r["seq"]) - np.mean([additive(x) for x in r["refs"]]))
    full = at.attribute(with_refs, w, hypothetical=True).collect()
    for r, h in zip(sorted(rows), sorted(full)):
        four = np.array(h["attribution"]).reshape(8, 4)
        assert [four[p]["ACGT".index(b)] for p, b in enumerate(r["seq"])] == pytest.approx(r["attribution"])
    product = at.attribute(df, w, method="input_x_weight").first()
    assert sum(product["attribution"]) == pytest.approx(additive(product["seq"]))


def test_a_planted_seqlet_is_called_once(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        values = rng.normal(0, .1, 80)
        if i < 3:
            values[20 + i:28 + i] += 3
        rows.append((i, values.tolist()))
    df = spark.createDataFrame(rows, "id long, attribution array<double>")
    spans = at.call_seqlets(df).collect()
    assert all(0 < r["p_value"] < .01 and 5 <= r["end"] - r["start"] <= 15 for r in spans)
    for i in range(3):
        mine = [r for r in spans if r["id"] == i]
        assert any(r["start"] < 28 + i and r["end"] > 20 + i and r["attribution"] > 9 for r in mine), mine
        assert all(a["end"] <= b["start"] or b["end"] <= a["start"] for a, b in itertools.combinations(mine, 2))
    flat = spark.createDataFrame([(1, [0.0] * 50)], "id long, attribution array<double>")
    assert at.call_seqlets(flat).count() == 0


@pytest.mark.parametrize("max_p", [.003, .05, .4, 1.0, 2.0])
def test_cutoffs_are_exact(spark, max_p):
    rng = np.random.default_rng(4)
    values = {(n, s): np.concatenate([rng.exponential(1, 300), [1.25] * 200, rng.integers(0, 9, 80) / 8, [1e-300, 1e300]]) for n in (5, 6) for s in (1, -1)}
    values = {k: v[v > 0] for k, v in values.items()}
    df = spark.createDataFrame([(n, s, v[i::7].tolist()) for (n, s), v in values.items() for i in range(7)], "n int, s int, v array<double>").repartition(5)

    def sizes(pdf):
        out = {}
        for n, s, v in zip(pdf["n"], pdf["s"], pdf["v"]):
            out.setdefault((n, s), []).append(np.asarray(v, float).view(np.int64))
        return {k: np.concatenate(v) for k, v in out.items()}

    cut, total = at._cutoffs(df, sizes, max_p)
    assert total == {k: len(v) for k, v in values.items()}
    for k, v in values.items():
        common = [x for x in v if (v >= x).sum() / len(v) >= max_p]
        assert cut[k] == (np.array([max(common)]).view(np.int64)[0] if common else 0)


def test_seqlets_equal_a_loop(spark):
    rng = np.random.default_rng(6)
    lists = [np.round(rng.normal(0, 1, rng.integers(0, 40)), 1).tolist() for _ in range(25)]
    lists += [lists[3]] * 20 + [[0.0] * 12, [], [float("nan")] * 9 + [1.0] * 9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)] + [(99, None)], "id long, attribution array<double>")
    lengths, max_p = range(3, 7), .2

    def total(v, i, n):
        return round(float(np.concatenate([[0.0], np.cumsum(v)])[i + n] - np.concatenate([[0.0], np.cumsum(v)])[i]), 9)
    every = {(k, i, n): total(v, i, n) for k, v in enumerate(lists) for n in lengths for i in range(len(v) - n + 1)}
    pools = {(n, s): np.array([t * s for (_, _, m), t in every.items() if m == n and t * s > 0]) for n in lengths for s in (1, -1)}
    p = {span: (pools[span[2], s] >= t * s).sum() / len(pools[span[2], s]) for span, t in every.items() for s in (1, -1) if t * s > 0}
    good = {}
    for (k, i, n), t in sorted(every.items(), key=lambda x: x[0][2]):
        inner = [(k, j, n - 1) for j in (i, i + 1)] if n > 3 else []
        good[k, i, n] = t == t and t != 0 and p[k, i, n] < max_p and all(good[x] and every[x] * t > 0 for x in inner)
    want = []
    for k in range(len(lists)):
        taken = []
        for _, _, i, n in sorted((p[x], -x[2], x[1], x[2]) for x, ok in good.items() if ok and x[0] == k):
            if all(i >= j + m or j >= i + n for j, m in taken):
                taken.append((i, n))
                want.append((k, i, i + n, every[k, i, n], p[k, i, n]))
    got = at.call_seqlets(df, shortest=3, longest=6, max_p=max_p).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 20


def test_sums_of_a_batch_are_taken_together(monkeypatch):
    rng = np.random.default_rng(8)
    lists = [rng.normal(size=n) for n in (32, 4, 32, 0, 7, 32, 5, 7)]
    want = {i: {n: np.convolve(v, np.ones(n), "valid") for n in (5, 6, 7) if n <= len(v)} for i, v in enumerate(lists) if len(v) >= 5}
    for values, calls in ((1 << 18, 3), (40, 5)):      # a matrix per length of a sequence, not one per sequence
        monkeypatch.setattr(at, "SUM_VALUES", values)
        found = list(at.span_sums(lists, [5, 6, 7]))
        assert len(found) == calls and sorted(i for rows, _ in found for i in rows) == sorted(want)
        for rows, by_length in found:
            for r, i in enumerate(rows):
                assert list(by_length) == list(want[i]) and all(np.allclose(s[r], want[i][n], atol=1e-9) for n, s in by_length.items())


def test_spans_are_annotated(spark, motifs):
    spans = spark.createDataFrame([(1, 5, "ACT"), (1, 9, "GGG"), (2, 5, "A")], "id long, start long, span_seq string")
    table = mo.log_odds(motifs)
    out = {(r["id"], r["start"]): r for r in mo.annotate_spans(spans, table, mo.load_matrices(table), ["id", "start"]).collect()}
    assert len(out) == 3 and out[(2, 5)]["motif_p_value"] is None
    assert out[(1, 5)]["motif"] == "m1" and out[(1, 9)]["motif"] is None


@pytest.mark.parametrize("block, bank", [(8192, 512), (7, 2)])
def test_a_bank_equals_the_scan(spark, monkeypatch, block, bank):
    monkeypatch.setattr(mo, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(mo, "BANK_MOTIFS", bank)
    rng = np.random.default_rng(3)
    matrices = {f"m{i}": np.round(rng.normal(0, 1, (w, 4)), 3) for i, w in enumerate([3, 5, 3, 8, 3, 5, 12])}
    texts = [dna(n, n_rate=.08) for n in (0, 1, 2, 3, 4, 9, 30, 200)] + ["NNNNNN", "acgtac", None]
    df = spark.createDataFrame([(i, i % 3, t, 1.5) for i, t in enumerate(texts)], "start long, stop int, span_seq string, score double")
    got = mo.best_in_bank(df, matrices, ["start", "stop"])
    hits = mo.scan_motifs(df.withColumnsRenamed({"start": "a", "stop": "b"}), matrices, ["a", "b"], "span_seq", matched=False)
    want = hits.groupBy("a", "b", "motif").agg(F.max("iscore"), F.count(F.lit(1)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() >= 30
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_library_of_motifs_annotates_spans(spark):
    rng = np.random.default_rng(8)
    probs = rng.dirichlet([.2] * 4, (300, 8))
    rows = [(f"m{i:03}", p, b, float(x)) for i, m in enumerate(probs) for p, col in enumerate(m) for b, x in zip("ACGT", col)]
    table = mo.log_odds(spark.createDataFrame(rows, "motif string, pos int, base string, prob double"))
    planted = [(i, "".join("ACGT"[c] for c in probs[i].argmax(axis=1))) for i in range(0, 300, 25)]
    spans = spark.createDataFrame(planted + [(999, None), (1000, "")], "id long, span_seq string")
    out = {r["id"]: (r["motif"], r["motif_p_value"]) for r in mo.annotate_spans(spans, table, mo.load_matrices(table), ["id"]).collect()}
    assert len(out) == 14 and out[999] == out[1000] == (None, None)
    assert sum(out[i][0] == f"m{i:03}" for i, _ in planted) >= 9 and all(out[i][1] < .01 for i, _ in planted)


@pytest.mark.parametrize("pad, dilation, stride", [(0, 1, 1), (2, 1, 1), (2, 2, 1), (1, 1, 2)])
def test_filters_equal_a_convolution(spark, pad, dilation, stride):
    rng = np.random.default_rng(2)
    weights = np.round(rng.normal(0, 1, (2, 3, 4)) * 8) / 8
    filters = at.Filters(weights, [.5, -.25], pad, dilation, stride)
    seqs = [(i, dna(20 + i, n_rate=.05)) for i in range(12)]
    df = spark.createDataFrame(seqs, "id long, seq string")
    acts = {}
    for i, s in seqs:
        for f in range(2):
            for o in range((len(s) + 2 * pad - filters.span) // stride + 1):
                cols = [o * stride - pad + k * dilation for k in range(3)]
                acts[(i, f, o)] = filters.bias[f] + sum(weights[f, k, "ACGT".index(s[c])] for k, c in enumerate(cols)
                                                        if 0 <= c < len(s) and s[c] != "N")
    best = {f: max(a for (_, g, _), a in acts.items() if g == f) for f in range(2)}
    got = {r["filter"]: (r["max_activation"], r["num_activating"]) for r in at.filter_summary(df, filters).collect()}
    assert got == {f: (best[f], sum(a >= best[f] * .8 for (_, g, _), a in acts.items() if g == f)) for f in range(2)}
    top = at.top_subsequences(df, filters, 4).collect()
    for f in range(2):
        mine = sorted((r for r in top if r["filter"] == f), key=lambda r: r["rank"])
        assert [r["activation"] for r in mine] == sorted((a for (_, g, _), a in acts.items() if g == f), reverse=True)[:4]
    pfm = at.filter_pfm(df, filters).collect()
    sums = {}
    for r in pfm:
        sums[(r["filter"], r["pos"])] = sums.get((r["filter"], r["pos"]), 0) + r["prob"]
        assert r["nsites"] <= max(1, sum(a >= best[r["filter"]] * .8 for (_, g, _), a in acts.items() if g == r["filter"]))
    assert all(0 < x <= 1 + 1e-9 for x in sums.values())


def test_matrices(spark):
    df = spark.createDataFrame([(1, "AC", 3.0), (2, "AG", 2.0), (3, "AC", 1.0), (4, "TC", 0.0)], "id long, seq string, score double")
    pfm = mo.pfm(df)
    got = {(r["pos"], r["base"]): (r["n"], r["prob"]) for r in pfm.collect()}
    assert got[(0, "A")] == (3, .75) and got[(1, "C")] == (3, .75) and got[(1, "T")] == (0, 0.0) and len(got) == 8
    bits = {r["pos"]: r["bits"] for r in mo.information(pfm).collect()}
    assert bits[0] == pytest.approx(2 + .75 * math.log2(.75) + .25 * math.log2(.25))
    contrast = {(r["pos"], r["base"]): r["difference"] for r in mo.pfm_contrast(df).collect()}
    assert contrast[(0, "A")] == 1.0 and contrast[(0, "T")] == -1.0 and contrast[(1, "C")] == 0.0
    named = pfm.withColumn("motif", F.lit("x"))
    assert mo.consensus(named).collect() == [("x", "AC")]


def test_extremes_are_exact_with_ties(spark):
    df = spark.createDataFrame([(i, float(i // 10)) for i in range(100)], "id long, score double")
    for n in (1, 7, 10, 25, 100):
        top = mo.take_extreme(df, F.lit(n), "id").collect()
        assert len(top) == n and sorted(r["score"] for r in top) == sorted([float(i // 10) for i in range(100)], reverse=True)[:n][::-1]


def test_a_model_learns_an_additive_rule(spark):
    rng = random.Random(7)
    w = WeightScorer(WEIGHTS)
    seqs = [(i, dna(8, rng)) for i in range(600)]
    df = spark.createDataFrame([(i, s, int(additive(s) > 0), additive(s), ("train", "val", "test")[i % 3]) for i, s in seqs],
                               "id long, seq string, label int, value double, split string")
    model = md.train_baseline(df, max_iter=20)
    test = md.evaluate(df.where("split = 'test'"), model).first()
    assert test["test_auc"] > .95 and test["test_acc"] > .85 and test["test_loss"] < .5
    line = md.train_baseline(df, "regression", label="value", reg=0.0)
    assert md.evaluate(df.where("split = 'test'"), line, "regression", label="value").first()["test_loss"] < 1e-3
    swept = md.sweep(df, {"reg": [.001, 10.0]}).collect()
    assert [r["reg"] for r in swept] == [.001, 10.0] and swept[0]["val_loss"] < swept[1]["val_loss"]
    assert w.batch([seqs[0][1]])[0] == additive(seqs[0][1])


def scored_alone(scorer, s):
    """A scorer's score of one sequence, None where it has none."""
    value = float(scorer.batch([s])[0])
    return None if np.isnan(value) else value


def changed(s, *edits):
    for p, b in edits:
        s = s[:p] + b + s[p + 1:]
    return s


def pairs_alone(scorer, s, places):
    for n, i in enumerate(places):
        for j in places[n + 1:]:
            for a in "ACGT":
                for b in "ACGT":
                    if {s[i].upper(), s[j].upper()} <= set("ACGT") and a != s[i].upper() and b != s[j].upper():
                        y = [scored_alone(scorer, changed(s, *e)) for e in ([(i, a), (j, b)], [(i, a)], [(j, b)], [])]
                        yield (i, a, j, b), y[0], None if None in y else y[0] - y[1] - y[2] + y[3]


LONG = 41      # more than two stretches of partners
TERMS = [(0, 1, 40, 2, .75), (40, 2, 0, 1, .5), (0, 3, 17, 0, -1.5), (17, 0, 18, 0, .25), (18, 2, 18, 2, .125), (18, 1, 18, 2, 9.0)]


def long_weights():
    return np.random.default_rng(5).integers(-8, 9, (LONG, 4)) / 4


@pytest.mark.parametrize("scorer", [
    WeightScorer(long_weights(), .5), PairScorer(long_weights(), TERMS), PairScorer(long_weights(), TERMS, digits=1),
    FunctionScorer(lambda seqs: np.array([np.nan if "N" in s else s.count("C") ** 2 + (s[0] == "G") for s in seqs], dtype=float))])
def test_epistasis_by_differences_equals_whole_sequences(spark, scorer):
    rng = np.random.default_rng(3)
    seqs = ["".join(rng.choice(list("ACGT"), LONG)) for _ in range(2)]
    seqs += [changed(seqs[0], (17, "N")), seqs[1].lower() if isinstance(scorer, WeightScorer) else seqs[1], seqs[0]]
    df = spark.createDataFrame([*enumerate(seqs), (5, None), (6, ""), (7, "A")], "id long, seq string")
    got = {(r["id"], r["pos_i"], r["base_i"], r["pos_j"], r["base_j"]): r for r in ef.epistasis2(df, scorer, [0, 3, 17, 18, 40, 99]).collect()}
    want = {(n, *k): (p, d) for n, s in enumerate(seqs) for k, p, d in pairs_alone(scorer, s, [0, 3, 17, 18, 40])}
    assert got.keys() == want.keys()
    for k, (prediction, delta) in want.items():
        assert got[k]["prediction"] == pytest.approx(prediction) and got[k]["delta_delta"] == pytest.approx(delta, abs=1e-9)
        assert got[k]["ref_i"] == seqs[k[0]][k[1]] and got[k]["ref_j"] == seqs[k[0]][k[3]]
    every = ef.epistasis2(df.where("id < 2"), scorer).groupBy("id").count().collect()
    assert {r["count"] for r in every} == {9 * LONG * (LONG - 1) // 2}


@pytest.mark.parametrize("scorer", [PairScorer(long_weights(), TERMS), FunctionScorer(
    lambda seqs: np.array([(s[0] == "C") * (s[17] != "A") * (s[18] == "T") + .5 * s.count("G") ** 3 for s in seqs], dtype=float))])
def test_triplets_by_differences_equal_whole_sequences(spark, scorer):
    rng = np.random.default_rng(4)
    s = "".join(rng.choice(list("ACGT"), LONG))
    df = spark.createDataFrame([(1, s), (2, changed(s, (16, "N"))), (3, None), (4, ""), (5, "ACG")], "id long, seq string")
    got = {(r["id"], r["pos_i"], r["pos_j"], r["pos_k"]): r["interaction"] for r in ef.epistasis3(df.where("id < 3"), scorer, 14, 20, -1.0).collect()}
    assert {k for k in got if k[0] == 2} <= {(2, *k) for k in itertools.combinations([14, 15, 17, 18, 19], 3)}
    for at in itertools.combinations(range(14, 20), 3):
        best = (-1.0, None)
        for bases in itertools.product("ACGT", repeat=3):
            if all(b != s[p] for b, p in zip(bases, at)):
                edits = list(zip(at, bases))
                value = sum((-1) ** (3 - k) * scored_alone(scorer, changed(s, *c)) for k in range(4) for c in itertools.combinations(edits, k))
                if round(abs(value), 9) > best[0]:
                    best = round(abs(value), 9), value
        assert got[(1, *at)] == pytest.approx(best[1], abs=1e-9)
    assert ef.epistasis3(df.where("id = 3 OR id = 4"), scorer).count() == 0


def test_expressions_are_given_edited_sequences(spark):
    cube = ExpressionScorer(lambda s: F.pow(F.length(s) - F.length(F.translate(s, "T", "")), F.lit(3)))
    df = spark.createDataFrame([(1, "ACGTTGCAAC")], "id long, seq string")
    plain = FunctionScorer(lambda seqs: np.array([float(s.count("T")) ** 3 for s in seqs]))
    for fn in (ef.epistasis2, ef.epistasis3):
        assert sorted(fn(df, cube).collect()) == sorted(fn(df, plain).collect())


def test_pairs_of_a_batch_are_scored_in_few_calls_and_triplets_share_their_changes(spark, monkeypatch):
    from lociframe.operators import effects as ef
    from lociframe.queries.views import pair_scorer
    texts = [dna(12) for _ in range(6)] + ["ACGTNACGTACG", "acgtacgtacgt", "ACG", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, seq string").coalesce(1)

    def rows(out):
        return sorted(tuple(round(x, 9) + 0.0 if isinstance(x, float) else str(x) for x in r) for r in out.collect())

    class Plain:      # a scorer that is given the changed sequences
        def __init__(self, scorer):
            self.scorer = scorer

        def __call__(self, col):
            return self.scorer(col)

        def over(self, col):
            return self.scorer.over(col)
    scorer = pair_scorer(12)
    known = rows(ef.epistasis2(df, scorer))
    assert known == rows(ef.epistasis2(df, Plain(scorer))) and len(known) > 6 * 66 * 9
    assert "_edits" not in ef.epistasis2(df, scorer)._jdf.queryExecution().toString()
    monkeypatch.setattr(ef, "EDITS", 100)
    assert rows(ef.epistasis2(df, scorer)) == known
    assert rows(ef.epistasis2(df, scorer, [0, 3, 3, 40])) == rows(ef.epistasis2(df, Plain(scorer), [0, 3, 3, 40]))
    three = rows(ef.epistasis3(df, Plain(scorer), 0, 12, -1.0))
    assert three == rows(ef.epistasis3(df, scorer, 0, 12, -1.0)) and len(three) > 6 * 220
    monkeypatch.setattr(ef, "TRIPLETS", 7)
    assert rows(ef.epistasis3(df, Plain(scorer), 0, 12, -1.0)) == three
    triplets, at_, by, numbers = ef._triplet_block(9, 0)
    assert len(triplets) == 7 and len(at_) < 7 * 64 and len({tuple(sorted((p, b) for p, b in zip(x, y) if b)) for x, y in zip(at_.tolist(), by.tolist())}) == len(at_)
