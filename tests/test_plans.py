"""Plan properties that have to hold at scale."""

import ast
import pathlib
import re

import pytest

from maskbench.plans import catalog, views as V

# the grid of a threshold recovery and the arm lists are constants of a few rows
HEAVY = ["pivot_with_deltas", "main_table", "spearman", "bootstrap_ci", "cluster_bootstrap_pooled", "gate_replay",
         "trajectory_deciles", "wilcoxon_signed_rank", "cliffs_delta", "rank_auc", "holm_bonferroni", "duplicate_report",
         "reconciliation", "denominator_correction", "agreement_scores", "mask_alignment_profile", "extra_over_clean",
         "profile_ema", "recover_tau", "between_association", "series_digest_blocks", "pick_three", "convention_transfer",
         "cost_summary", "ablation_table"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HEAVY)
def test_no_cross_join_and_no_local_checkpoint(spark, sf_dir, name):
    plan = plan_of(catalog.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = plan_of(catalog.QUERIES["pivot_with_deltas"](spark, sf_dir))
    cols = re.search(r"FileScan parquet \[([^\]]*)\]", plan).group(1)
    assert "l_extendedprice" not in cols and "l_shipdate" not in cols and "l_orderkey" not in cols
    assert plan.count("FileScan") == 1


def test_filters_reach_the_scan(spark, sf_dir):
    d = V.table(spark, sf_dir, "lineitem").where("l_quantity < 5")
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,5.0)]" in plan_of(d)


def test_no_window_holds_a_whole_key(spark, sf_dir):
    """Order-dependent operators window by (key, chunk); only chunk summaries window by key."""
    d = V.frame_rows(spark, sf_dir)
    for line in plan_of(d).splitlines():
        if "Window [" in line and "row" in line.lower():
            assert "_chunk" in line


def called_names(tree):
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            f = node.func
            yield f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", "")


def test_no_local_checkpoint_cross_join_or_forced_broadcast():
    """Read from the syntax trees of the base; the optional operators have rules of their own."""
    root = pathlib.Path(catalog.__file__).parents[1]
    base = [p for p in root.rglob("*.py") if p.relative_to(root).parts[0] != "llm"]
    for p in base:
        assert not {"localCheckpoint", "crossJoin", "broadcast"} & set(called_names(ast.parse(p.read_text()))), p
    assert len(base) > 20
