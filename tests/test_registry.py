"""Registry contract, and a sample of queries against their SQL (all of them with OBSLOOM_ALL=1)."""
import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["scan_csv", "scan_tsv_verbatim", "threshold_qc", "exclusion_manifest", "join_validated", "hierarchical_match", "scored_best_match",
          "quantiles_type7", "near_zero_variance", "avg_rank", "row_number_tiers", "holm_adjust", "deterministic_shuffle", "shift_sum_fit_apply",
          "hvg_select", "spearman_pairwise", "greedy_nonredundant", "kruskal_wallis", "dunn_holm", "chi_square_cramers_v", "strat_permutation_test",
          "lof", "snn_graph", "k_selection", "coclustering", "cell_stability_margin", "group_shuffle_split", "class_metrics", "roc_pr_summary",
          "group_bootstrap_ci", "gene_bootstrap_votes", "branch_order", "trace_qc_flags", "kde_grid", "table_diff"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("OBSLOOM_ALL") else SAMPLE


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 226


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 7 and "p_bh" in df.columns


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    status, rows, note = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert status == "ok", f"{status} {note}"
