"""The driver contract, and queries next to their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from lociframe.queries.registry import OPERATORS
from tools.compare import compare, duck

SMALL = "/root/testdata/sf0.001"

# One or two queries of each family; tools/compare.py runs them all.
CHECKED = ("merge_intervals overlap_join exclude_overlaps sample_n extract_windows variant_windows fill_n roc_curve pr_auc "
           "balance_scores score_regression scan_motifs hit_pvalues best_window mutagenesis epistasis_all_top attribute_references "
           "filter_pfm make_classification split_dataset residue_confidence timeline read_peaks read_fasta write_resumable "
           "method_comparison variant_validation").split()


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 140
    ids = {i for ops in OPERATORS.values() for i in ops}
    wanted = {f"{k}{i}" for k, n in (("S", 16), ("K", 9), ("I", 18), ("N", 6), ("Q", 12), ("M", 26), ("D", 10), ("E", 16), ("L", 9), ("P", 8))
              for i in range(1, n + 1)}
    assert wanted - ids == set()


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["method", "auc_abs", "auc_raw", "median_abs_path", "median_abs_benign", "n_path", "n_benign"]
    assert df.count() == 1


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    note, _, _, same = compare(spark, duck(SMALL), name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert same, note


def test_no_query_multiplies_tables(spark):
    for name in ("scan_motifs", "epistasis_all_pairs", "score_regression", "split_dataset", "extract_windows", "variant_validation"):
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_epistasis_of_all_positions(spark):
    pairs = entry.queries()["epistasis_all_pairs"](spark, SMALL).select("pos_i", "pos_j").distinct()
    assert {tuple(r) for r in pairs.collect()} == {(i, j) for i in range(32) for j in range(i + 1, 32)}
    triplets = entry.queries()["epistasis_default_triplets"](spark, SMALL).select("pos_i", "pos_j", "pos_k").distinct()
    assert triplets.count() == 84
    for name in ("epistasis_all_pairs", "epistasis_all_top", "epistasis_default_triplets"):
        note, _, _, same = compare(spark, duck(SMALL), name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
        assert same, note
