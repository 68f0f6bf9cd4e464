"""Predicate usage, attention averages and codes by bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sceneframe.functions.arrays import exploded
from sceneframe.functions.codes import predicate_of, unit_of

# A predicate above the first rate is always on, below the second always off.
ALWAYS_ON = 0.99
ALWAYS_OFF = 0.01


def predicate_usage(states: DataFrame, predicates: int, bits: str = "bits") -> DataFrame:
    """``(unit, predicate, activation_rate, usage)`` for every bit of the code.

    Each bit is exploded and counted map-side, so only one row per bit and task is shuffled. The
    class uses the exact rate, the report the rate rounded to four digits (half even).
    """
    rates = exploded(states, bits, "idx", "bit").groupBy("idx").agg(
        (F.sum("bit") / F.count("*")).alias("rate")
    )
    usage = F.when(F.col("rate") > ALWAYS_ON, "always_on").when(F.col("rate") < ALWAYS_OFF, "always_off").otherwise("variable")
    return rates.select(
        unit_of(F.col("idx"), predicates).alias("unit"), predicate_of(F.col("idx"), predicates).alias("predicate"),
        F.bround("rate", 4).alias("activation_rate"), usage.alias("usage"),
    )


def usage_totals(usage: DataFrame) -> DataFrame:
    """Number of predicates of each class in one row."""
    return usage.agg(*[
        F.count_if(F.col("usage") == c).alias(f"num_{c}") for c in ["always_on", "always_off", "variable"]
    ])


def variable_predicates_by_rate(usage: DataFrame) -> DataFrame:
    """Variable predicates, the most active first."""
    return usage.where("usage = 'variable'").select("unit", "predicate", "activation_rate").orderBy(
        F.col("activation_rate").desc(), "unit", "predicate"
    )


def head_states(states: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` states."""
    return states.orderBy(order).limit(n)


def mean_attention(states: DataFrame, attention: str = "attention") -> DataFrame:
    """Mean weight of every ``(unit, arg, obj)``."""
    units = exploded(states, attention, "unit", "_u")
    args = units.select("unit", F.posexplode("_u").alias("arg", "_a"))
    objs = args.select("unit", "arg", F.posexplode("_a").alias("obj", "w"))
    return objs.groupBy("unit", "arg", "obj").agg(F.avg("w").alias("weight"))


def sample_examples(arguments: DataFrame, predicate: str, bit: str, keys: list[str], k: int, order) -> DataFrame:
    """Up to ``k`` true and ``k`` false argument sets per predicate in the given random order.

    The rank limit is applied before the shuffle, so each task sends at most ``k`` rows per class
    although every predicate covers all states. Predicates that are never true are skipped.
    """
    from pyspark.sql import Window

    nth = Window.partitionBy(predicate, bit).orderBy(order, *keys)
    kept = arguments.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= k)
    return (
        kept.withColumn("_ever", F.max(bit).over(Window.partitionBy(predicate)))
        .where(F.col("_ever") == 1)
        .withColumn("example", F.col("_n") - 1)
        .drop("_n", "_ever")
    )
