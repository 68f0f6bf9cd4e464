"""Near duplicates among embeddings: random-hyperplane signs in several tables, exact cosines, connected components.

Equal vectors become one node with a weight first. A table's key of a node is the sign of its products with ``bits``
hyperplanes; ``bits`` grows with the logarithm of the number of nodes, and the number of tables follows from it, so that a pair
at the threshold itself meets in some table with probability ``recall`` (closer pairs more surely). Nodes that share a
key are compared by their cosine in doubles. A pair counts in the first table that it shares only, so no pair is counted twice,
and no pair is ever a row: a comparison adds up the links of each node and leaves a spanning tree of what is linked.

Keys that more than ``cell`` nodes share are split. Their nodes first gather in balls: around a pivot, everything within half
the angle of the threshold, so all of a ball is linked to each other without a comparison. Pivots are the least node of a
key, then the pivot of the key's largest ball, so a family of near copies ends up in few balls. A key's nodes are dealt into
units of about ``cell``, those of a large ball into units of their own, and each pair of units meets in one group, but for two of one
ball. A family that holds a third of all rows is thus one ball, which meets the key's other nodes alone.

Defined results: a null or zero vector, and one with a null or non-finite component, links with nothing (0 links, its own component);
so does a vector with any of another length. Rows that repeat are rows of their own, linked with each other. A null
id never names a component unless all its ids are null; ``kept`` is false then. An empty table gives no row. Other columns
of the input are ignored, whatever their names. Vectors that differ by a positive factor have cosine 1 and are linked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sceneframe.llm.components import merged_labels
from sceneframe.session import written

THRESHOLD, RECALL = 0.9, 0.98
CELL = 256  # nodes of a unit: two units meet in one comparison
NODES_A_KEY = 16  # aimed at where vectors have no structure
MARGIN = 1e-9  # far above the error of a product of unit vectors


def shape_of(nodes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of tables."""
    bits = min(62, max(4, math.ceil(math.log2(max(nodes, 1) / NODES_A_KEY + 1))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def nodes_of(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows ``vec_id, body`` (doubles, null where the vector links with nothing) and nodes ``node, body, weight, least`` of them."""
    number = lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))  # noqa: E731  NaN counts as the largest

    def pack(batches):
        for b in batches:
            x, good = b.column("x"), b.column("good").to_pylist()
            flat, ends = np.asarray(x.flatten()) + 0.0, np.cumsum(np.asarray(x.value_lengths().fill_null(0)))
            starts = np.append(0, ends[:-1])
            body = [flat[s:e].tobytes() if ok else None for s, e, ok in zip(starts, ends, good)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(body, pa.binary())], ["vec_id", "body"])

    values = F.col(vector).cast("array<double>")
    good = F.coalesce((F.size(values) > 0) & F.forall(values, number) & F.exists(values, lambda v: v != 0), F.lit(False))
    whole = F.when(good, values).otherwise(F.array().cast("array<double>"))
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), whole.alias("x"), good.alias("good")).mapInArrow(pack, "vec_id bigint, body binary")
    rows = written(rows, "vectors")
    nodes = rows.filter("body is not null").groupBy("body").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    return rows, written(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")


def unit_rows(bodies: list[bytes]) -> np.ndarray:
    """Vectors of one length, scaled to length 1 (by their largest component first, so that squares stay finite)."""
    x = np.frombuffer(b"".join(bodies)).reshape(len(bodies), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def signed(nodes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """The nodes with ``keys``, an array of one key a table; vectors of different lengths never share one."""

    def sign(batches):
        planes, power = {}, 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            bodies = b.column("body").to_pylist()
            length = np.array([len(x) // 8 for x in bodies], np.int64)
            keys = np.zeros((len(bodies), tables), np.int64)
            for n in np.unique(length):
                if n not in planes:
                    planes[n] = np.random.default_rng([seed, n]).standard_normal((n, tables * bits))
                at = np.flatnonzero(length == n)
                above = unit_rows([bodies[k] for k in at]) @ planes[n] >= 0
                keys[at] = above.reshape(len(at), tables, bits) @ power
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("weight"), b.column("least"), b.column("body"),
                                              pa.array(length.astype(np.int32)), flat], ["node", "weight", "least", "body", "dim", "keys"])

    return nodes.select("node", "weight", "least", "body").mapInArrow(
        sign, "node bigint, weight bigint, least bigint, body binary, dim int, keys array<bigint>")


KEY = ["dim", "t", "k"]


def keyed(nodes: DataFrame, *columns: str) -> DataFrame:
    """A row for each node and table."""
    return nodes.select("node", "dim", *columns, F.posexplode("keys").alias("t", "k"))


def within(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs ``node, pivot`` whose cosine is ``least`` or more."""

    def compare(batches):
        for b in batches:
            x, y = b.column("body").to_pylist(), b.column("pivot_body").to_pylist()
            close = np.zeros(len(x), bool)
            for n in {len(v) for v in x}:
                at = [k for k, v in enumerate(x) if len(v) == n]
                close[at] = (unit_rows([x[k] for k in at]) * unit_rows([y[k] for k in at])).sum(1) >= least
            yield b.select(["node", "pivot"]).filter(pa.array(close))

    of_pivot = nodes.select(F.col("node").alias("pivot"), F.col("body").alias("pivot_body"))
    joined = pairs.join(nodes.select("node", "body"), "node").join(of_pivot, "pivot")
    return joined.select("node", "pivot", "body", "pivot_body").mapInArrow(compare, "node bigint, pivot bigint")


def balls(nodes: DataFrame, crowded: DataFrame, threshold: float) -> DataFrame:
    """``node, ball`` of nodes in crowded keys that lie within half the angle of the threshold around the node ``ball``."""
    radius = math.sqrt((1 + threshold) / 2) + MARGIN
    rows = keyed(nodes).join(crowded.select(*KEY), KEY)
    pivots = rows.groupBy(*KEY).agg(F.min("node").alias("pivot"))
    pairs = rows.join(pivots, KEY).select("node", "pivot").distinct()
    first = written(within(pairs, nodes, radius).groupBy("node").agg(F.min("pivot").alias("ball")), "balls")
    sizes = first.groupBy("ball").agg(F.count("*").alias("n"))
    named = first.join(sizes, "ball")
    larger = F.struct("n", (-F.col("ball")).alias("first"))
    pivots = rows.join(named, "node").groupBy(*KEY).agg((-F.max(larger)["first"]).alias("pivot"))
    pairs = rows.join(pivots, KEY).select("node", "pivot").distinct().join(sizes.withColumnRenamed("ball", "pivot"), "pivot")
    near = within(pairs, nodes, radius).join(sizes.withColumnRenamed("ball", "pivot"), "pivot")
    best = near.groupBy("node").agg((-F.max(F.struct("n", (-F.col("pivot")).alias("first")))["first"]).alias("better"))
    return written(first.join(best, "node", "left").select("node", F.coalesce("better", "ball").alias("ball")), "balls")


def unit_counts(crowded: DataFrame, rows: DataFrame, cell: int) -> DataFrame:
    """For each crowded key: ``light``, the number of units of small balls and single nodes, and ``heavy``, the large balls with
    the first of their units and the number of them."""
    per_ball = rows.join(crowded.select(*KEY), KEY).groupBy(*KEY, "ball").agg(F.count("*").alias("n"))
    ceil = lambda n: F.ceil(n / F.lit(cell)).cast("int")
    large = F.col("n") > cell
    found = per_ball.groupBy(*KEY).agg(
        ceil(F.sum(F.when(~large, F.col("n")).otherwise(0))).alias("light"),
        F.array_sort(F.collect_list(F.when(large, F.struct("ball", ceil(F.col("n")).alias("units"))))).alias("large"))
    before = lambda k: F.aggregate(F.slice("large", 1, k), F.col("light"), lambda a, b: a + b["units"])
    heavy = F.transform("large", lambda b, k: F.struct(b["ball"].alias("ball"), before(k).alias("first"), b["units"].alias("units")))
    return found.select(*KEY, "light", heavy.alias("heavy"))


def cells(rows: DataFrame, units: DataFrame) -> DataFrame:
    """The rows with their ``unit``, once for each pair ``low, high`` of units in which they are compared."""
    mine = F.get(F.filter("heavy", lambda b: b["ball"] == F.col("ball")), F.lit(0))
    spread = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    joined = rows.join(units, KEY, "left").withColumn("mine", mine)
    unit = (F.when(F.col("light").isNull(), F.lit(0))
            .when(F.col("mine").isNotNull(), F.col("mine.first") + spread(F.greatest(F.col("mine.units"), F.lit(1))))
            .otherwise(spread(F.greatest(F.col("light"), F.lit(1)))))
    joined = joined.withColumn("unit", unit)
    last = F.aggregate("heavy", F.col("light"), lambda a, b: a + b["units"])
    others = F.filter(F.sequence(F.lit(0), last - 1), lambda u: F.col("mine").isNull() | (u < F.col("mine.first")) | (u >= F.col("mine.first") + F.col("mine.units")))
    others = F.when(F.col("light").isNull(), F.array(F.lit(0))).when(last > 0, others)
    out = joined.withColumn("other", F.explode(others))
    return out.select(*KEY, F.least("unit", "other").alias("low"), F.greatest("unit", "other").alias("high"), "unit", "node", "ball", "weight", "body", "keys")


def runs(batches, names: list[str]):
    """Record batches of sorted rows, cut into tables of equal ``names``; only the rows of one run are held over."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        columns = [np.asarray(table.column(n)) for n in names]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        starts = np.append(0, change)
        for s, e in zip(starts[:-1], starts[1:]):
            if e - s > 1:
                yield table.slice(s, e - s)
        held = table.slice(starts[-1])
    if held is not None and held.num_rows > 1:
        yield held


def linked_pairs(run: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of the linked pairs of a cell that no earlier table holds and no ball."""
    column = lambda n: np.asarray(run.column(n))
    x = unit_rows(run.column("body").to_pylist())
    unit, ball, t = column("unit"), column("ball"), run.column("t")[0].as_py()
    i, j = np.nonzero(np.triu(x @ x.T >= threshold - MARGIN, 1))
    across = run.column("low")[0].as_py() != run.column("high")[0].as_py()
    ok = (ball[i] != ball[j]) & ((unit[i] != unit[j]) | (not across))
    i, j = i[ok], j[ok]
    if t and len(i):
        keys = np.asarray(run.column("keys").combine_chunks().flatten()).reshape(len(x), -1)[:, :t]
        new = ~(keys[i] == keys[j]).any(1)
        i, j = i[new], j[new]
    exact = exact_cosines(run.column("body").to_pylist(), i, j) >= threshold
    return i[exact], j[exact]


def exact_cosines(bodies: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs by scalar product over the product of the lengths."""
    x = np.frombuffer(b"".join(bodies)).reshape(len(bodies), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    square = (x * x).sum(1)
    return (x[i] * x[j]).sum(1) / np.sqrt(square[i] * square[j])


def least_of_tree(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least place that the pairs connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(rows: DataFrame, threshold: float) -> DataFrame:
    """``node, n, other``: of each cell the weight linked with a node, and a node of the tree it belongs to there."""

    def compare(batches):
        for run in runs(batches, [*KEY, "low", "high"]):
            i, j = linked_pairs(run, threshold)
            if len(i):
                node, weight = np.asarray(run.column("node")), np.asarray(run.column("weight"))
                n = np.zeros(len(node), np.int64)
                np.add.at(n, i, weight[j])
                np.add.at(n, j, weight[i])
                at = np.flatnonzero(n)
                root = node[least_of_tree(len(node), i, j)]
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(n[at]), pa.array(root[at])], ["node", "n", "other"])

    order = [*KEY, "low", "high"]
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "node bigint, n bigint, other bigint")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
                    recall: float = RECALL, cell: int = CELL, seed: int = 11) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    rows, nodes = nodes_of(vectors, key, vector)
    bits, tables = shape_of(nodes.count(), threshold, recall)
    nodes = written(signed(nodes, bits, tables, seed), "signed-nodes")
    crowded = written(keyed(nodes).groupBy(*KEY).agg(F.count("*").alias("n")).filter(F.col("n") > cell), "crowded-keys")
    ball = balls(nodes, crowded, threshold)
    named = nodes.join(ball, "node", "left").withColumn("ball", F.coalesce("ball", "node"))
    units = written(unit_counts(crowded, keyed(named, "ball"), cell), "key-units")
    meet = cells(keyed(named, "ball", "weight", "body", "keys"), units)
    found = written(links(meet, threshold), "links")
    of_ball = ball.join(nodes.select("node", "weight"), "node").groupBy("ball").agg(F.sum("weight").alias("in_ball"), F.min("node").alias("hub"))
    counted = (
        nodes.select("node", "weight", "least").join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left")
        .join(ball, "node", "left").join(of_ball, "ball", "left")
        .select("node", "least", (F.coalesce("n", F.lit(0)) + F.coalesce("in_ball", "weight") - 1).alias("n_links"),
                F.coalesce("hub", "node").alias("label")))
    counted = written(counted, "link-counts")
    label = counted.select(F.col("node").alias("other"), F.col("label").alias("b"))
    edges = found.join(counted.select("node", F.col("label").alias("a")), "node").join(label, "other").select("a", "b").filter("a <> b")
    labels = merged_labels(counted.select(F.col("node").alias("id"), "label"), edges.distinct())
    named = counted.drop("label").join(labels.withColumnRenamed("id", "node"), "node")
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    result = named.join(least, "label").select("node", "n_links", "component")
    of_body = nodes.select("node", "body").join(result, "node").select("body", "n_links", "component")
    component = F.when(F.col("body").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return rows.join(of_body, "body", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
