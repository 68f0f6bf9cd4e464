"""Every registered query against its DuckDB oracle, and the shape of the driver contract."""

import pytest

from check import compare
from scene_helpers import SF_DIR
from sceneframe.plans import catalog


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry_has_ten_slots_per_state(spark):
    import __spark_entry__
    from pyspark.sql import functions as F

    per_state = __spark_entry__.entry(spark).groupBy("state_id").agg(F.count("*").alias("n")).select("n").distinct().collect()
    assert [r.n for r in per_state] == [10]


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(name, spark, duck):
    assert compare(catalog.QUERIES[name](spark, SF_DIR), duck, catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_oracle(name, spark):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0
