"""User-supplied array functions over state rows, classifier scores, and decision trees of predicates."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sceneframe.session import written

BLOCK_ROWS = 1 << 16  # rows of a task that are counted together
COUNTS = "p int, node bigint, f int, value double, n bigint, n_true bigint"


def score_states(states: DataFrame, keys: list[str], features: str,
                 outputs: dict[str, tuple[Callable[[np.ndarray], np.ndarray], str]]) -> DataFrame:
    """Apply array functions to batches of states.

    ``outputs`` maps a column to ``(function, type)``: the function takes the ``(batch, features)``
    matrix and returns one row per state, for example codes or flattened attention. Functions are
    pure; large weights belong in a Spark broadcast captured by the function.
    """
    types = dict(states.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{name} {ddl}" for name, (_, ddl) in outputs.items()])
    functions = {name: fn for name, (fn, _) in outputs.items()}

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) == 0:
                continue
            matrix = np.stack(batch[features].to_numpy())
            scored = {name: list(np.asarray(fn(matrix))) for name, fn in functions.items()}
            yield pd.DataFrame({**{k: batch[k].to_numpy() for k in keys}, **scored})

    return states.select(*keys, features).mapInPandas(apply, schema)


def classify_rows(rows: DataFrame, model, score: str = "score") -> DataFrame:
    """Probability of the positive class from a fitted classifier, as a plain column."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn(score, vector_to_array("probability")[1])


def predicate_trees(arguments: DataFrame, features: list[str], predicates: list[str], max_depth: int = 60) -> DataFrame:
    """A decision tree for each predicate over the features of its arguments: ``predicate, node, n, n_true, feature, threshold``.

    All trees grow together, one level a job: one aggregate counts every value of every feature in every open node of every predicate
    (blocks of rows first, inside their tasks), the split with the least Gini impurity is picked from running counts, and rows move on to their child by a join with
    the splits. An impure node is split while a feature differs in it; splits that tie go to the first feature, then the
    smaller value. Node 1 is the root, ``2n`` takes ``feature <= threshold`` and ``2n + 1`` the rest, with which a null counts. A null label leaves its row
    out of that tree. Equal rows with equal labels are counted once and written once for all predicates, so features of few values (codes, bins) make small tables.
    """
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    rows = arguments.select(x.alias("x"), F.array(*[F.col(p).cast("int") for p in predicates]).alias("y"))
    files = 2 * arguments.sparkSession.sparkContext.defaultParallelism  # small, but a row stands for one of every predicate
    rows = written(rows.groupBy("x", "y").agg(F.count("*").alias("n")).repartition(files), "tree-rows")
    rows = rows.select("x", "n", F.posexplode("y").alias("p", "y")).where("y is not null").select("p", "x", "n", (F.col("n") * F.col("y")).alias("n_true"))
    at, levels = rows.withColumn("node", F.lit(1).cast("bigint")), []
    for level in range(max_depth + 1):
        levels.append(written(_level(at.where(F.col("node") >= 1 << level), level < max_depth), "tree-level"))
        split = levels[-1].where("f is not null").select("p", "node", "f", "value")
        if split.isEmpty():
            break
        child = 2 * F.col("node") + (F.get("x", F.col("f")) > F.col("value")).cast("bigint")
        at = at.join(split, ["p", "node"], "left").select("p", "x", "n", "n_true", F.coalesce(child, "node").alias("node"))
    named = lambda names, index: F.get(F.array(*map(F.lit, names)), F.col(index))
    tree = functools.reduce(DataFrame.unionByName, levels)
    return tree.select(named(predicates, "p").alias("predicate"), "node", "n", "n_true", named(features, "f").alias("feature"), "threshold")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``n`` and ``n_true`` of every value of every feature in every node, block of rows by block of rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield from _block_counts(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield from _block_counts(pa.Table.from_batches(held))


def _block_counts(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
    nodes = rows.select(["p", "node"]).append_column("at", pa.array(np.arange(rows.num_rows))).group_by(["p", "node"]).aggregate([("at", "list")])
    members = nodes["at_list"].combine_chunks()
    group = np.empty(rows.num_rows, np.int64)
    group[members.flatten().to_numpy()] = np.repeat(np.arange(len(members)), np.diff(members.offsets.to_numpy()))
    n, true = (rows[c].to_numpy() for c in ("n", "n_true"))
    for f in range(x.shape[1]):
        coded = pa.array(x[:, f]).dictionary_encode()
        values, place = coded.dictionary.to_numpy(), group * len(coded.dictionary) + coded.indices.to_numpy()
        key = None
        if len(members) * len(values) > 4 * len(group):  # too many to have a place for each
            key, place = np.unique(place, return_inverse=True)
        sums = [np.bincount(place, c).astype(np.int64) for c in (n, true)]
        if key is None:
            key = np.flatnonzero(sums[0])
            sums = [s[key] for s in sums]
        node, value = np.divmod(key, len(values))
        yield pa.RecordBatch.from_pydict({
            "p": nodes["p"].combine_chunks().take(pa.array(node)), "node": nodes["node"].combine_chunks().take(pa.array(node)),
            "f": pa.array(np.full(len(key), f, np.int32)), "value": pa.array(values[value]), "n": pa.array(sums[0]), "n_true": pa.array(sums[1])})


def _level(rows: DataFrame, grow: bool) -> DataFrame:
    """``p, node, n, n_true`` of the open nodes and their best split ``f, value, threshold``, null where a node stays a leaf."""
    counts = rows.select("p", "node", "n", "n_true", "x").mapInArrow(_counted, COUNTS).groupBy("p", "node", "f", "value").agg(
        F.sum("n").alias("n"), F.sum("n_true").alias("n_true"))
    run = Window.partitionBy("p", "node", "f").orderBy("value")
    whole = Window.partitionBy("p", "node", "f")
    sums = {f"{side}_{c}": F.sum(c).over(w) for side, w in (("left", run), ("all", whole)) for c in ("n", "n_true")}
    seen = counts.withColumns(sums | {"after": F.lead("value").over(run)})
    impurity = lambda n, true: true * (n - true) / n
    cost = F.round(impurity(F.col("left_n"), F.col("left_n_true"))
                   + impurity(F.col("all_n") - F.col("left_n"), F.col("all_n_true") - F.col("left_n_true")), 9)
    possible = F.lit(grow) & F.col("after").isNotNull() & (F.col("all_n_true") > 0) & (F.col("all_n_true") < F.col("all_n"))
    split = F.when(possible, F.struct(cost.alias("cost"), "f", "value", "after"))
    best = seen.groupBy("p", "node").agg(F.max("all_n").alias("n"), F.max("all_n_true").alias("n_true"), F.min(split).alias("s"))
    return best.select("p", "node", "n", "n_true", "s.f", "s.value", ((F.col("s.value") + F.col("s.after")) / 2).alias("threshold"))


def explain_predicates(arguments: DataFrame, features: list[str], predicates: list[str], max_depth: int = 60) -> DataFrame:
    """``predicate, depth, nodes, accuracy, rules`` of each predicate's tree; a leaf predicts what most of its rows are, false on a tie."""
    return tree_reports(predicate_trees(arguments, features, predicates, max_depth))


def tree_reports(trees: DataFrame) -> DataFrame:
    """One row for each tree of ``predicate_trees``."""
    leaf, node = F.col("feature").isNull(), F.col("node")
    right = F.when(leaf, F.greatest("n_true", F.col("n") - F.col("n_true"))).otherwise(0)
    text = lambda c: c.cast("string")
    rule = F.when(leaf, F.concat(F.lit("predict "), text((2 * F.col("n_true") > F.col("n")).cast("int")), F.lit(" ("), text(F.col("n_true")), F.lit(" of "), text(F.col("n")), F.lit(" true)")))
    rule = rule.otherwise(F.concat(F.lit("if ("), F.col("feature"), F.lit(" <= "), text(F.col("threshold")), F.lit(") "), text(2 * node), F.lit(" else "), text(2 * node + 1)))
    line = F.struct(node.alias("node"), F.concat(text(node), F.lit(": "), rule).alias("text"))
    depth = F.floor(F.log2(node.cast("double") + 0.5)).cast("int")
    return trees.groupBy("predicate").agg(
        F.max(depth).alias("depth"), F.count("*").alias("nodes"),
        (F.sum(right) / F.sum(F.when(leaf, F.col("n")).otherwise(0))).alias("accuracy"),
        F.array_join(F.array_sort(F.collect_list(line))["text"], "\n").alias("rules"))
