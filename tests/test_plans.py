"""Physical plans: no crossed joins, no row-at-a-time Python, early limits, pruned scans."""

import pytest
from scene_helpers import SF_DIR

from sceneframe.plans import catalog

PYTHON_BOUNDARY = {"read_array_archive", "score_states", "run_trials", "classify_rows"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"classify_rows", "classify_rows_range"}))
def test_no_crossed_joins_and_no_python(name, spark):
    text = plan(catalog.QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if name not in PYTHON_BOUNDARY:
        assert "ArrowEvalPython" not in text and "MapInPandas" not in text


def test_scene_slots_shuffles_once_after_an_early_limit(spark):
    text = plan(catalog.QUERIES["scene_slots"](spark, SF_DIR))
    assert text.count("Exchange hashpartitioning") == 1
    assert "WindowGroupLimit" in text and "Partial" in text and "Aggregate" not in text
    assert "l_comment" not in text and "l_shipdate" not in text


def test_examples_are_limited_before_the_shuffle(spark):
    text = plan(catalog.QUERIES["sample_examples"](spark, SF_DIR))
    assert "WindowGroupLimit" in text and text.index("Final") < text.index("Partial")


@pytest.mark.parametrize("name", ["atoms", "state_results", "sum_errors", "write_codes_csv", "equalize_histogram"])
def test_row_local_queries_do_not_shuffle_their_rows(name, spark):
    df = catalog.QUERIES[name](spark, SF_DIR)
    main = plan(df).split("Subquery")[0] if name == "equalize_histogram" else plan(df)
    allowed = 0 if name != "sum_errors" else 2  # sum_errors pairs neighbouring states first
    assert main.count("Exchange hashpartitioning") <= allowed


@pytest.mark.parametrize("name", ["primary_category", "viability", "predicate_usage", "action_effects", "bit_stats"])
def test_reports_combine_before_the_shuffle(name, spark):
    assert "partial_" in plan(catalog.QUERIES[name](spark, SF_DIR))
