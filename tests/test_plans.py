"""Plans: native operators stay in the JVM, scans are pruned, nothing gathers in one task."""

import pytest

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()

# Python by nature: user hooks, suffix scans over tokens, sequential packing, keyed stream state.
PYTHON = {
    "h01_reward_func", "h02_scorer", "w04_gae", "w05_discounted_returns", "w06_compute_advantages",
    "w06_compute_advantages_gae", "w07_normalize_advantages_global", "w09_first_fit_batches", "w10_balanced_partitions",
    "w10_balanced_equal_size", "w11_greedy_partitions", "w13_dynamic_micro_batches", "w14_rollout_micro_batches",
    "a16_seqlen_balance_report",
}
STREAMS = {n for n in QUERIES if n.startswith(("r01", "r02", "r03", "h04"))}
TRAINING_DATA = {n for n in QUERIES if n.startswith("op") or n == "pipeline"}  # any style; tested on their own


def plan(df):
    return df._jdf.queryExecution().executedPlan().treeString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS - TRAINING_DATA))
def test_plan(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    python = any(n in text for n in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsIn", "FlatMapCoGroupsIn", "PythonUDF"))
    assert python == (name in PYTHON)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["a01_best_of_n", "w01_advantage_rloo", "f12_approx_kl"])
def test_scan_reads_only_needed_columns(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert set(part.split(":")[0] for part in schema.split(",")) <= {"event_id", "user_id", "value"}


def test_top_k_scans_only_needed_columns(spark):
    from pyspark.sql import functions as F

    from prefspark.operators.positions import prune_to_tail
    from prefspark.plans.views import view

    text = plan(prune_to_tail(view(spark, SF_DIR, "v_margins").select("pair_id", "im"), F.col("im"), 10)[0])
    assert text.count("ReadSchema: struct<event_id:bigint>") == text.count("ReadSchema") > 0


def test_role_filter_reaches_the_scan(spark):
    from prefspark.plans.views import view

    text = plan(view(spark, SF_DIR, "v_pairs"))
    assert "EqualTo(role,user)" in text and "EqualTo(role,assistant)" in text
