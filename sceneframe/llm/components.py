"""Connected components of a link table, by hooking labels to smaller ones and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sceneframe.session import written


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, label) after joining the groups that ``links`` (a, b: labels) connect; a group's label is its least.

    Every pass hooks each label to its least neighbour, halves the chains and contracts the links, so the number of passes
    grows with the logarithm of the longest chain. Each pass is written, which cuts its lineage.
    """
    mapping, left = None, written(_both_ways(links), "links")
    while not left.isEmpty():
        hook = left.groupBy("a").agg(F.min("b").alias("to")).filter("to < a")
        # follow the hooks of the hooks once
        onward = hook.select(F.col("a").alias("to"), F.col("to").alias("further"))
        hook = hook.join(onward, "to", "left").select("a", F.coalesce("further", "to").alias("to"))
        hook = written(hook, "hooks")
        mapping = hook if mapping is None else written(_follow(mapping, hook), "mapping")
        relabel = lambda side: F.coalesce(F.col(f"{side}.to"), F.col(f"l.{side[0]}"))
        moved = (
            left.alias("l").join(hook.alias("ah"), F.col("l.a") == F.col("ah.a"), "left")
            .join(hook.alias("bh"), F.col("l.b") == F.col("bh.a"), "left")
            .select(relabel("ah").alias("a"), relabel("bh").alias("b"))
        )
        left = written(_both_ways(moved), "links")
    if mapping is None:
        return labels
    to = mapping.select(F.col("a").alias("label"), "to")
    return written(labels.join(to, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")


def _both_ways(links: DataFrame) -> DataFrame:
    turned = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("l"))
    return turned.select("l.a", "l.b").filter("a <> b").distinct()


def _follow(mapping: DataFrame, hook: DataFrame) -> DataFrame:
    """The mapping with its targets moved on by ``hook``, and the new hooks."""
    step = hook.select(F.col("a").alias("to"), F.col("to").alias("further"))
    moved = mapping.join(step, "to", "left").select("a", F.coalesce("further", "to").alias("to"))
    return moved.unionByName(hook.join(mapping, "a", "left_anti"))
