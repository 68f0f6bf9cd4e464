"""Action statistics over transitions ``(action, pre, suc)`` with packed codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sceneframe.functions.arrays import exploded
from sceneframe.functions.codes import apply_effects


def action_histogram(transitions: DataFrame, action: str = "action") -> DataFrame:
    """Transitions per available action; unused actions have no row."""
    return transitions.groupBy(action).agg(F.count("*").alias("n"))


def action_count(transitions: DataFrame, action: str = "action") -> DataFrame:
    """Number of distinct actions in use."""
    return action_histogram(transitions, action).agg(F.count("*").alias("true_num_actions"))


def action_effects(transitions: DataFrame, action: str = "action", pre: str = "pre", suc: str = "suc") -> DataFrame:
    """Add and delete effect of every action on every bit.

    Changes are maximised map-side; the shuffle carries one row per (action, bit) and task.
    """
    change = transitions.select(action, F.posexplode(F.zip_with(pre, suc, lambda a, b: b - a)).alias("idx", "d"))
    return change.groupBy(action, "idx").agg(
        F.max(F.greatest(F.col("d"), F.lit(0))).alias("add"),
        F.max(F.greatest(-F.col("d"), F.lit(0))).alias("del"),
    )


def effect_arrays(effects: DataFrame, action: str = "action") -> DataFrame:
    """Effects packed per action; an action has one entry per bit of the code."""
    packed = effects.groupBy(action).agg(F.array_sort(F.collect_list(F.struct("idx", "add", "del"))).alias("_e"))
    return packed.select(
        action, F.transform("_e", lambda e: e["add"]).alias("add"), F.transform("_e", lambda e: e["del"]).alias("del")
    )


def predict_successors(transitions: DataFrame, effects: DataFrame, action: str = "action", pre: str = "pre",
                       rule=apply_effects) -> DataFrame:
    """Successor codes from the effects of the action. ``rule(pre, add, del)`` is a column function.

    The effect table has one row per action; Spark broadcasts it while it is below its threshold.
    """
    merged = transitions.join(effect_arrays(effects, action), action)
    both = F.arrays_zip(F.col(pre).alias("p"), F.col("add").alias("a"), F.col("del").alias("d"))
    return merged.withColumn("predicted", F.transform(both, lambda z: rule(z["p"], z["a"], z["d"]))).drop("add", "del")


def action_entropy(transitions: DataFrame, action: str = "action", pre: str = "pre") -> DataFrame:
    """Mean over used actions of the summed bit entropy of their pre states."""
    tiny = F.lit(1e-20)  # fixed value inside the logarithm
    p = F.col("p")
    per_bit = exploded(transitions, pre, "idx", "bit", [action]).groupBy(action, "idx").agg(F.avg("bit").alias("p"))
    per_action = per_bit.groupBy(action).agg(F.sum(-(p * F.log(p + tiny) + (1 - p) * F.log(1 - p + tiny))).alias("h"))
    return per_action.agg(F.avg("h").alias("h_z_given_a"))


def stack_observed_predicted(predictions: DataFrame, keep: list[str], pre: str = "pre", suc: str = "suc",
                             predicted: str = "predicted") -> DataFrame:
    """Observed and predicted transitions below each other, from one scan."""
    return predictions.select(
        *keep,
        F.inline(F.array(
            F.struct(F.lit("observed").alias("origin"), F.col(pre).alias("pre"), F.col(suc).alias("suc")),
            F.struct(F.lit("predicted").alias("origin"), F.col(pre).alias("pre"), F.col(predicted).alias("suc")),
        )),
    )
