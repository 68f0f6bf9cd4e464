"""Exploding array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def exploded(df: DataFrame, array: str, index: str, item: str, keep: list[str] = []) -> DataFrame:
    """``keep`` columns with the position and value of every array entry; empty arrays give no row.

    The outer form is deliberate: for the plain one Spark infers a "not empty" filter below the
    generator, which evaluates a computed array again for every row.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(index, item)).where(F.col(index).isNotNull())


def held(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]
