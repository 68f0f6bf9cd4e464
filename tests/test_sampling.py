"""Draws with replacement: the same rows as numbered by hand, their law, and what moves."""

import hashlib
from collections import Counter

import pytest
from scene_helpers import rows

from sceneframe.operators import sampling as SA


def h60(*values):
    return int(hashlib.md5("|".join(map(str, values)).encode()).hexdigest()[:15], 16)


def by_hand(ids, n, seed):
    order = sorted(ids, key=lambda i: (h60(i, seed), i))
    return sorted((k, order[h60(k, seed + 1) % len(order)]) for k in range(n))


@pytest.mark.parametrize("fan, leaf", [(10, 64), (3, 1), (2, 5), (1, 2)])
def test_draws_equal_places_in_hash_order_at_any_depth(spark, monkeypatch, fan, leaf):
    monkeypatch.setattr(SA, "FAN_BITS", fan)
    monkeypatch.setattr(SA, "LEAF_ROWS", leaf)
    ids = [7 * i - 50 for i in range(300)]
    table = spark.createDataFrame([(i, f"row {i}") for i in ids], "key long, name string").repartition(5)
    got = SA.sample_with_replacement(table, ["key"], 400, 3)
    assert got.columns == ["draw", "key", "name"]
    assert rows(got) == sorted(((k, i, f"row {i}") for k, i in by_hand(ids, 400, 3)), key=repr)


def test_law_and_repeats(spark):
    table = spark.range(40).repartition(3)
    count = Counter(r.id for r in SA.sample_with_replacement(table, ["id"], 20_000, 11).collect())
    squares = sum((count[i] - 500) ** 2 / 500 for i in range(40))
    assert squares < 72.1  # chi-square of 39 degrees, one in a thousand
    first, again, other = (rows(SA.sample_with_replacement(spark.range(1000).repartition(p), ["id"], 50, s)) for p, s in ((2, 5), (7, 5), (7, 6)))
    assert first == again != other


def test_no_rows_no_draws_and_equal_hashes(spark):
    assert SA.sample_with_replacement(spark.range(0), ["id"], 5).count() == 0
    assert SA.sample_with_replacement(spark.range(9), ["id"], 0).count() == 0
    assert [tuple(r) for r in SA.sample_with_replacement(spark.range(4, 5), ["id"], 2).collect()] == [(0, 4), (1, 4)]


def test_only_drawn_rows_are_shuffled(spark, tmp_path):
    spark.range(200_000).selectExpr("id", "repeat('x', 50) as wide").write.parquet(str(tmp_path / "t"))
    got = SA.sample_with_replacement(spark.read.parquet(str(tmp_path / "t")), ["id"], 20)
    assert got.count() == 20
    plan = got._jdf.queryExecution().executedPlan()
    got.collect()
    text = plan.toString()
    scan = text.index("wide#")
    assert "BroadcastHashJoin" in text and "LeftSemi" in text and "CartesianProduct" not in text and scan > 0
    # no exchange lies between the scan of the table and the join that keeps the drawn leaves
    semi = text[text.index("LeftSemi"):]
    assert "Exchange hashpartitioning" not in semi[:semi.index("BroadcastExchange")]
