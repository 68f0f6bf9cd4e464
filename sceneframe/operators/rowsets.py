"""Set operations on tables and labelled unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.operators.ordering import hashed_position


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of ``b``, duplicates kept, then the distinct rows of ``a`` that are new."""
    return b.unionAll(a.subtract(b))


def real_fake_dataset(real: DataFrame, fake: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """Rows of both tables tagged 1 or 0, shuffled and cut 90 / 10 into train and test.

    ``keys`` identify a row within its own table.
    """
    both = real.withColumn("label", F.lit(1)).unionByName(fake.withColumn("label", F.lit(0)))
    placed = hashed_position(both, ["label", *keys], seed, total="_total")
    train = F.col("position") < F.floor(F.col("_total") * F.lit(0.9))
    return placed.withColumn("split", F.when(train, "train").otherwise("test")).drop("_total")


def merge_config(defaults: Column, override: Column) -> Column:
    """Config map with the right side winning per key."""
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(override, k)), override)
