import random

import pytest
from pyspark.sql import functions as F

from lociframe.functions.contigs import resolve_contig
from lociframe.operators import intervals as iv
from lociframe.operators.joins import grid_join, spread_join
from lociframe.operators.sampling import sample_n, take_by_hash

PEAKS = "chrom string, start long, end long, num long"


def merged_by_hand(peaks):
    out = []
    for chrom, start, end, num in sorted(peaks):
        if out and out[-1][0] == chrom and start <= out[-1][2]:
            out[-1][2], out[-1][3] = max(out[-1][2], end), max(out[-1][3], num)
        else:
            out.append([chrom, start, end, num])
    return sorted(tuple(x) for x in out)


@pytest.mark.parametrize("peaks, expected", [
    ([("a", 0, 10, 1), ("a", 10, 20, 3), ("a", 21, 30, 2), ("b", 5, 6, 1)],
     [("a", 0, 20, 3), ("a", 21, 30, 2), ("b", 5, 6, 1)]),
    ([("a", 0, 100, 1), ("a", 10, 20, 5), ("a", 50, 60, 2)], [("a", 0, 100, 5)]),
])
def test_merge_by_hand(spark, rows, peaks, expected):
    assert rows(iv.merge_intervals(spark.createDataFrame(peaks, PEAKS)), "chrom", "start", "end", "num") == expected


@pytest.mark.parametrize("bits", [2, 4, 6, 16])
@pytest.mark.parametrize("seed", [1, 2])
def test_merge_across_bins_equals_a_sweep(spark, rows, bits, seed):
    """Intervals that span many bins, bins without a start, copies and touching ends, on every bin width."""
    rng = random.Random(seed)
    peaks = []
    for _ in range(300):
        start = rng.randrange(-50, 900)
        peaks.append((rng.choice("ab"), start, start + rng.choice([1, 3, 8, 40, 200]) * (rng.random() > 0.9 or 1) if rng.random() > 0.1
                      else start + 1, rng.randrange(9)))
    peaks += [peaks[0]] * 20
    got = rows(iv.merge_intervals(spark.createDataFrame(peaks, PEAKS), bits=bits), "chrom", "start", "end", "num")
    assert got == merged_by_hand(peaks)


def test_merge_does_not_depend_on_partitions(spark, rows):
    rng = random.Random(5)
    df = spark.createDataFrame([("a", s, s + rng.randrange(1, 30), 1) for s in (rng.randrange(5000) for _ in range(500))], PEAKS)
    got = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(rows(iv.merge_intervals(df, bits=5), "chrom", "start", "end", "num"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_confidence_needs_counts(spark, rows):
    df = spark.createDataFrame([("a", 0, 10, 1), ("a", 20, 30, 4)], PEAKS)
    assert rows(iv.filter_confidence(df, 4), "start") == [(20,)]
    with pytest.raises(ValueError, match="line 3"):
        iv.filter_confidence(df, 2, "line 3 has 'x' in column 4")


@pytest.mark.parametrize("hot_rows", [None, 3, 1_000_000])
def test_overlap_join_equals_all_pairs(spark, rows, hot_rows):
    rng = random.Random(3)

    def table(n, tag):
        return [(f"{tag}{i}", rng.choice(["a", "b"]), s, s + rng.choice([1, 5, 40, 300])) for i, s in
                enumerate(rng.choice([100, rng.randrange(900)]) for _ in range(n))]
    left, right = table(80, "l"), table(60, "r")
    schema = "id string, chrom string, start long, end long"
    got = iv.overlap_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), bits=4,
                          hot_rows=hot_rows, row_key=F.col("id"))
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    assert rows(got, "id", "id_right") == want


@pytest.mark.parametrize("hot", ["left", "right", "both"])
def test_a_hot_bin_is_cut_on_either_side(spark, rows, hot):
    rng = random.Random(11)

    def table(tag, crowd):
        places = [50] * crowd + [rng.randrange(4000) for _ in range(40)]
        return spark.createDataFrame([(f"{tag}{i}", "a", s, s + 3) for i, s in enumerate(places)], "id string, chrom string, start long, end long")
    left, right = table("l", 300 if hot != "right" else 1), table("r", 300 if hot != "left" else 1)
    got = iv.overlap_join(left, right, bits=6, hot_rows=20, row_key=F.col("id"))
    plain = iv.overlap_join(left, right, bits=6, hot_rows=None)
    assert rows(got, "id", "id_right") == rows(plain, "id", "id_right")
    # Rows of the crowded bin that meet in one task: a part of each side.
    keyed = [df.select("id", F.lit("k").alias("k")).withColumnRenamed("id", name) for df, name in ((left, "x"), (right, "y"))]
    pairs = grid_join(*keyed, ["k"], hot_rows=20)
    assert pairs.count() == left.count() * right.count() == pairs.distinct().count()
    lefts = {r["x"] for r in keyed[0].collect()}
    assert {r["x"] for r in pairs.select("x").distinct().collect()} == lefts


def test_grid_join_with_nulls_and_empty_sides(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (3, "a")], "x long, k string")
    right = spark.createDataFrame([("a", 7), (None, 8), ("b", 9)], "k string, y long")
    for hot in (None, 1, 100):
        assert rows(grid_join(left, right, ["k"], hot_rows=hot), "k", "x", "y") == [("a", 1, 7), ("a", 3, 7), ("a", 3, 7)]
        assert grid_join(left.where("false"), right, ["k"], hot_rows=hot).count() == 0
        assert grid_join(left, right.where("false"), ["k"], hot_rows=hot).count() == 0


def test_overlap_edges(spark, rows):
    peaks = spark.createDataFrame([("a", 10, 20)], "chrom string, start long, end long")
    points = spark.createDataFrame([("a", p - 1, p) for p in (10, 11, 20, 21)], "chrom string, start long, end long")
    assert rows(iv.overlap_join(points, peaks), "end") == [(11,), (20,)]


@pytest.mark.parametrize("longest", [None, 400])
@pytest.mark.parametrize("hot_rows", [None, 2])
def test_exclude_equals_all_pairs_and_keeps_copies(spark, rows, longest, hot_rows):
    rng = random.Random(4)
    schema = "chrom string, start long, end long"
    left = [(rng.choice(["a", "b", "c"]), s, s + rng.choice([1, 6, 90, 400])) for s in (rng.randrange(3000) for _ in range(120))]
    left += left[:10]
    blocked = spark.createDataFrame([(rng.choice(["a", "b"]), s, s + rng.randrange(1, 60)) for s in
                                     (rng.randrange(3000) for _ in range(25))], schema)
    excluded = iv.exclusion_set(blocked, 5)
    ex = excluded.collect()
    got = iv.exclude_overlaps(spark.createDataFrame(left, schema), excluded, longest, bits=5, hot_rows=hot_rows)
    want = sorted(r for r in left if not any(e.chrom == r[0] and e.start < r[2] and r[1] < e.end for e in ex))
    assert rows(got, "chrom", "start", "end") == want


def test_window_policies(spark, rows):
    peaks = spark.createDataFrame([("a", 90, 98)], "chrom string, start long, end long")
    lengths = spark.createDataFrame([("a", 100)], "chrom string, length long")

    def kept(width, policy="inside"):
        return rows(iv.center_windows(peaks, width, lengths, policy), "ws", "we")
    assert kept(10) == [(89, 99)]
    assert kept(12) == [(88, 100)]
    assert kept(12, "strict") == []
    assert kept(10, "strict") == [(89, 99)]
    assert kept(11, "strict") == []
    assert kept(11, "odd") == []
    assert kept(9, "odd") == [(90, 99)]


def test_filter_order(spark, rows):
    df = spark.createDataFrame([
        (1, False, 1.0, None), (2, False, None, None), (3, True, None, "ACNT"), (4, True, 2.0, "ACNT"), (5, True, 2.0, "ACGT")],
        "id int, in_bounds boolean, score double, seq string")
    assert rows(iv.filter_reason(df), "id", "reason") == [(1, "bounds"), (2, "bounds"), (3, "score"), (4, "non_acgt"), (5, None)]


def test_contig_names(spark, rows):
    names = spark.createDataFrame([("chr1",), ("2",), ("M",), ("chrX",), ("7",)], "chrom string")
    contigs = spark.createDataFrame([("1",), ("chr1",), ("chr2",), ("MT",), ("X",)], "chrom string")
    got = {r["name"]: r["contig"] for r in resolve_contig(names, contigs).collect()}
    assert got == {"chr1": "chr1", "2": "chr2", "M": "MT", "chrX": "X", "7": None}


def test_top_n_spaced_equals_greedy(spark, rows):
    rng = random.Random(8)
    hits = [(c, p, float(rng.randrange(40))) for c in "ab" for p in range(400)]
    got = rows(iv.top_n_spaced(spark.createDataFrame(hits, "chrom string, pos long, score double"), 5, 30), "chrom", "pos")
    want = []
    for c in "ab":
        chosen = []
        for _, p, _s in sorted((h for h in hits if h[0] == c), key=lambda h: (-h[2], -h[1])):
            if len(chosen) < 5 and all(abs(p - q) >= 30 for q in chosen):
                chosen.append(p)
        want += [(c, p) for p in chosen]
    assert got == sorted(want)


@pytest.mark.parametrize("width, placed, step, start", [(10, 4, 3, 0), (10, 4, 20, 5), (7, 7, 1, 0), (24, 11, 5, 2)])
def test_window_min_equals_a_loop(spark, rows, width, placed, step, start):
    rng = random.Random(9)
    energy = {p: None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else rng.random() for p in range(0, 90)}
    for p in range(40, 65):
        energy[p] = float("nan")
    df = spark.createDataFrame([("a", p, e) for p, e in energy.items()], "chrom string, pos long, energy double")
    end = 89 + placed
    want = []
    for w in range(start, end - width + 1, step):
        ok = [energy[p] for p in range(w, w + width - placed + 1) if energy[p] is not None and energy[p] == energy[p]]
        want.append((w, min(ok) if ok else None))
    got = [(r["window_start"], r["window_min"]) for r in iv.window_min(df, width, placed, step, start).orderBy("window_start").collect()]
    assert got == want


def test_track(spark, rows):
    lengths = spark.createDataFrame([("a", 106)], "chrom string, length long")
    windows = spark.createDataFrame([("a", 90, 1.0), ("a", 100, 2.0), ("a", 104, 3.0), ("a", 50, None), ("a", 60, float("nan"))],
                                    "chrom string, window_start long, window_min double")
    assert rows(iv.track_intervals(windows, lengths, 11, 5), "start", "end", "value") == [(93, 98, 1.0), (103, 106, 2.0)]
    assert rows(iv.track_intervals(windows.limit(1), lengths, 11, 50), "start", "end") == [(90, 101)]


def test_samples_are_exact_and_stable(spark, rows):
    df = spark.range(5000).repartition(7)
    for n in (0, 1, 777, 5000, 9000):
        got = rows(sample_n(df, n, "id"))
        assert len(got) == min(n, 5000)
        assert got == rows(sample_n(df.coalesce(1), n, "id"))
    quotas = spark.createDataFrame([(0, 10), (1, 0), (2, 10_000)], "g long, quota long")
    grouped = df.withColumn("g", F.col("id") % 4)
    counts = {r["g"]: r["count"] for r in take_by_hash(grouped, "id", 1, quotas, by=["g"]).groupBy("g").count().collect()}
    assert counts == {0: 10, 2: 1250}


def test_hot_keys_are_salted_without_changing_the_result(spark, rows):
    left = spark.range(400).select("id", F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 5).alias("k"))
    right = spark.createDataFrame([(0, "x"), (0, "y"), (3, "z"), (9, "q")], "k long, v string")
    for how in ("inner", "left"):
        plain = left.join(right, "k", how)
        salted = spread_join(left, right, ["k"], how, F.col("id"), hot_rows=20)
        key = lambda df: sorted((r["id"], r["k"], r["v"] or "") for r in df.collect())
        assert key(salted) == key(plain)


def test_caps_and_summits(spark, rows):
    df = spark.createDataFrame([("a", 100, 200, None), ("a", 100, 5000, 700)], "chrom string, start long, end long, summit long")
    assert rows(iv.cap_region(df, 2000), "start", "end") == [(100, 200), (1550, 3550)]
    assert rows(iv.summit_window(df, 11, "summit"), "ws", "we") == [(145, 156), (695, 706)]


def test_exclusion_searches_dense_lists(spark):
    rng = random.Random(8)
    for n in (1, 2, 3, 4, 7, 8, 9, 400):
        at, excluded = 0, []
        for _ in range(n):
            start = at + rng.randint(1, 4)
            at = start + rng.randint(1, 3)
            excluded.append(("1", start, at))
        rows = [("1", s, s + rng.randint(0, 5)) for s in (rng.randint(0, at + 8) for _ in range(200))] + [("2", 1, 9)]
        got = iv.exclude_overlaps(spark.createDataFrame(rows, "chrom string, start long, end long"),
                                  spark.createDataFrame(excluded, "chrom string, start long, end long"))
        want = [r for r in rows if not any(r[0] == c and s < r[2] and e > r[1] for c, s, e in excluded)]
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_shuffles_begin_in_more_parts_than_the_session_has(spark):
    """Parts are put together up to a size but never cut for a group or a window, so their number bounds a task's memory."""
    df = spark.range(3).selectExpr("'c' AS chrom", "id AS start", "id + 5 AS end", "1L AS num")
    plan = iv.merge_intervals(df)._jdf.queryExecution().executedPlan().toString()
    assert ", 1024)" in plan and ", 4)" not in plan
