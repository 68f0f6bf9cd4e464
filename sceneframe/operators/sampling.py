"""Reproducible samples, bags of negatives and classifier calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sceneframe.operators.ordering import HASH_BITS, hashed_position, stable_hash
from sceneframe.session import written

FAN_BITS = 10  # bits of the hash that one level of the tree of draws looks at
LEAF_ROWS = 64


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the first in hash order (all rows when there are fewer); no task holds them all."""
    return hashed_position(df, keys, seed, "_at").where(F.col("_at") < n).drop("_at")


def _children(rows: DataFrame) -> DataFrame:
    """``node`` and, ascending, its children as ``ends`` (rows up to the child's end, child, its rows); from ``node, child``."""
    counted = rows.groupBy("node", "child").agg(F.count("*").alias("n"))
    end = F.sum("n").over(Window.partitionBy("node").orderBy("child"))
    return counted.withColumn("end", end).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("end", "child", "n"))).alias("ends"))


def _descended(draws: DataFrame, children: DataFrame) -> DataFrame:
    """``draw, node, at`` one level down: each draw goes to the child that holds its place and counts from there."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(FAN_BITS))])
    child = F.aggregate(steps, F.lit(0), lambda i, step: F.when(
        F.get(F.col("ends"), i + step - 1)["end"] <= F.col("at"), i + step).otherwise(i))
    hit = draws.join(children, "node").withColumn("hit", F.get("ends", child))
    return hit.select("draw", F.col("hit.child").alias("node"), (F.col("at") - F.col("hit.end") + F.col("hit.n")).alias("at"))


def sample_with_replacement(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` independent draws: hashed places among the rows in hash order, as ``draw`` and the row. ``keys`` identify a row.

    The draws go down a tree over the leading bits of the hash. A level counts the rows of each child, of drawn nodes alone,
    which reads the keys once and combines them map-side. The leaves hold about ``LEAF_ROWS`` rows; only rows of drawn
    leaves are shuffled and ranked. Draws are written at each level when the operator is called, so Spark knows their size
    and broadcasts the drawn nodes only below its threshold. An empty table gives no draw.
    """
    node = lambda level: F.shiftright(stable_hash(*keys, seed=seed), HASH_BITS - FAN_BITS * level)
    top = written(_children(df.select(F.lit(0).cast("bigint").alias("node"), node(1).alias("child"))), "draw-tree")
    total = top.agg(F.max(F.element_at("ends", -1)["end"]).alias("n")).first()["n"]
    if total is None:
        return df.select(F.lit(0).cast("bigint").alias("draw"), "*").where(F.lit(False))
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"), F.lit(0).cast("bigint").alias("node"), F.pmod(stable_hash("id", seed=seed + 1), F.lit(total)).alias("at"))
    # one row of at most 2**FAN_BITS children
    draws, level = written(_descended(draws, F.broadcast(top)), "draws"), 1
    while total > LEAF_ROWS << FAN_BITS * level and FAN_BITS * (level + 1) <= HASH_BITS:
        drawn = draws.select("node").distinct()
        rows = df.select(node(level).alias("node"), node(level + 1).alias("child")).join(drawn, "node", "left_semi")
        draws, level = written(_descended(draws, _children(rows)), "draws"), level + 1
    leaves = draws.select(F.col("node").alias("_node")).distinct()
    rows = df.withColumn("_node", node(level)).join(leaves, "_node", "left_semi")
    place = F.row_number().over(Window.partitionBy("_node").orderBy(stable_hash(*keys, seed=seed), *keys)) - 1
    return draws.withColumnsRenamed({"node": "_node", "at": "_at"}).join(
        rows.withColumn("_at", place.cast("bigint")), ["_node", "_at"]).select("draw", *[F.col(c) for c in df.columns])


def class_balance(rows: DataFrame, label: str) -> DataFrame:
    """Positives, negatives and their ratio; an error unless negatives outnumber positives."""
    counts = rows.agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives")
    )
    checked = F.when(F.col("negatives") > F.col("positives"), F.try_divide("negatives", "positives")).otherwise(
        F.raise_error(F.lit("negatives must outnumber positives")).cast("double")
    )
    return counts.withColumn("ratio", checked)


def assign_bags(rows: DataFrame, keys: list[str], label: str, bags: int, seed: int = 0) -> DataFrame:
    """``bags`` training sets: an equal share of the shuffled negatives and all positives each.

    All negatives are dealt, so shares differ by one at most; with fewer negatives than bags some bags have none.
    Positives are repeated per bag inside the row.
    """
    placed = hashed_position(rows.where(F.col(label) == 0), keys, seed, "_at", total="_negatives")
    dealt = placed.withColumn("bag", F.floor(F.col("_at") * F.lit(bags) / F.col("_negatives")))
    positives = rows.where(F.col(label) == 1).withColumn(
        "bag", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bags - 1).cast("long")))
    )
    return dealt.select(*rows.columns, F.col("bag").cast("long").alias("bag")).unionByName(positives)


def calibrate_scores(rows: DataFrame, score: str, label: str, validation: DataFrame | None = None) -> DataFrame:
    """Scores divided by the mean score of labelled positives; an error when there are none.

    The constant is a one-value subquery; the calibrated score is not clamped.
    """
    known = validation if validation is not None else rows
    constant = known.agg(
        F.coalesce(F.avg(F.when(F.col(label) == 1, F.col(score))),
                   F.raise_error(F.lit("no labelled positives")).cast("double"))
    ).scalar()
    return rows.withColumn("calibrated", F.col(score) / constant)


def ensemble_vote(scores: DataFrame, key: str, score: str) -> DataFrame:
    """Rounded mean of the bag scores of each row."""
    return scores.groupBy(key).agg(F.avg(score).alias("mean")).select(key, "mean", F.rint("mean").cast("int").alias("vote"))
