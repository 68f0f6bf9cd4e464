"""Ranked lexical search of many queries at once, with shared term sets evaluated once.

A document's score for an item is a sum over the item's terms, so items that share terms share partial sums. Spark mines the
shared sets: the terms of every item stand in one order (held by most items first), and neighbouring pairs that two or more
items of a block hold become a node of their own, round after round, until no pair is shared. The nodes form a graph in which
each is the sum of two others and each leaf a term with its number of repeats. Tasks then walk over blocks of documents: leaf
accumulators come from the postings, every inner accumulator is made once by adding its two children, level by level, and
items add up their few remaining nodes. Each task keeps its best ``top`` documents of each item; those alone are shuffled.

Documents are read in whole, without a shuffle: a first pass writes the query terms of each document and their counts, from
which the figures of the corpus come (summed per task first). Equal item texts are one query. Queries are dealt into blocks
of about ``block`` texts by a hash; a task holds the graph of one block, and documents are passed once for each block.
Scores are 64-bit integers, so no order of evaluation changes them.

Defined results: a null or empty text, item or document, has no terms and no results; texts of any length are read in whole,
separated by any ASCII character but letters and digits. Rows that repeat an item are answered each; rows that repeat a
document are ranked each, as equal scores are by ascending id, a null id last. An empty table gives no row. Other columns of
either table are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sceneframe.llm.text import whole_text
from sceneframe.session import removed, written

TOP = 20
BLOCK = 1000  # query texts whose graph a task holds
CELLS = 4_000_000  # accumulators a task holds at once
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# the same terms over UTF-8 bytes: letters lowered, every other ASCII character but digits a space
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
POSTINGS = "doc_id bigint, n bigint, terms binary, tfs binary"


class Graph(NamedTuple):
    """The queries of one block. Nodes are numbered with the leaves first, then level by level."""

    terms: list[bytes]
    leaf_term: np.ndarray
    leaf_repeats: np.ndarray
    levels: list[tuple[int, np.ndarray, np.ndarray]]  # first node of the level, left and right children
    nodes: int
    items: np.ndarray
    starts: np.ndarray  # of each item's nodes in parts
    parts: np.ndarray


def query_terms(texts: DataFrame) -> DataFrame:
    """``block, item, term, c``: the distinct terms of each row ``block, item, text`` with their repeats."""
    found = F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(TERM), F.lit(0))
    return texts.select("block", "item", F.explode(found).alias("term")).groupBy("block", "item", "term").agg(F.count("*").alias("c"))


def mined(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query-sharing graph: ``block, node, term, c, left, right, level`` and what is left of each item, ``block, item, node``."""
    leaf = F.md5(F.concat_ws(":", "c", "term"))
    rows = terms.withColumn("node", leaf).withColumn("held", F.count("*").over(Window.partitionBy("block", "node")))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("block", "item").orderBy(F.desc("held"), "node")))
    left = written(rows.select("block", "item", "pos", "node", F.lit(0).alias("level"), "term", "c"), "query-terms")
    nodes = left.select("block", "node", "term", "c", F.lit(None).cast("string").alias("left"),
                        F.lit(None).cast("string").alias("right"), F.lit(0).alias("level")).distinct()
    left = left.drop("term", "c")
    order = Window.partitionBy("block", "item").orderBy("pos")
    while True:
        pairs = left.withColumns({"after": F.lead("node").over(order), "height": F.greatest("level", F.lead("level").over(order))})
        shared = pairs.filter("after is not null").groupBy("block", "node", "after").agg(F.count("*").alias("n")).filter("n > 1")
        ranked = pairs.join(shared, ["block", "node", "after"], "left")
        # a pair merges where it is held by more items than the pairs that overlap it
        strength = F.when(F.col("n").isNotNull(), F.struct("n", F.md5(F.concat("node", "after"))))
        ranked = ranked.withColumn("strength", strength)
        best = (F.col("strength").isNotNull()
                & F.coalesce(F.col("strength") > F.lag("strength").over(order), F.lit(True))
                & F.coalesce(F.col("strength") > F.lead("strength").over(order), F.lit(True)))
        ranked = ranked.withColumn("merges", best)
        ranked = ranked.withColumn("gone", F.coalesce(F.lag("merges").over(order), F.lit(False)))
        step = written(ranked.filter("not gone").select(
            "block", "item", "pos", "merges", F.col("node").alias("first"), F.col("after").alias("second"),
            F.when(F.col("merges"), F.md5(F.concat("node", "after"))).otherwise(F.col("node")).alias("node"),
            F.when(F.col("merges"), F.col("height") + 1).otherwise(F.col("level")).alias("level")), "query-terms")
        new = step.filter("merges").select(
            "block", "node", F.lit(None).cast("string").alias("term"), F.lit(None).cast("bigint").alias("c"),
            F.col("first").alias("left"), F.col("second").alias("right"), "level").distinct()
        if new.isEmpty():
            return nodes, left
        nodes, left = nodes.unionByName(new), step.select("block", "item", "pos", "node", "level")


def graph_of(nodes: DataFrame, left: DataFrame, block: int) -> Graph:
    """The graph of one block, whose size the number of query texts in a block bounds."""
    found = nodes.filter(F.col("block") == block).drop("block").toArrow().sort_by([("level", "ascending"), ("node", "ascending")]).to_pylist()
    number = {r["node"]: k for k, r in enumerate(found)}
    leaves = [r for r in found if not r["level"]]
    terms = sorted({r["term"].encode() for r in leaves})
    term = {t: k for k, t in enumerate(terms)}
    levels = []
    for level in range(1, found[-1]["level"] + 1 if found else 1):
        inner = [r for r in found if r["level"] == level]
        child = lambda side: np.array([number[r[side]] for r in inner], np.int64)
        if inner:
            levels.append((number[inner[0]["node"]], child("left"), child("right")))
    parts = left.filter(F.col("block") == block).select("item", "node").toArrow().sort_by("item")
    items, starts = np.unique(np.asarray(parts.column("item")), return_index=True)
    return Graph(terms, np.array([term[r["term"].encode()] for r in leaves], np.int64), np.array([r["c"] for r in leaves], np.int64), levels,
                 len(found), items, starts, np.array([number[x] for x in parts.column("node").to_pylist()], np.int64))


def postings(docs: DataFrame, graph: Graph, key: str, text: str) -> DataFrame:
    """The query terms of each document that has a term, with their counts, and its length ``n``."""

    def read(batches):
        number = {t: k for k, t in enumerate(graph.terms)}.get
        for b in batches:
            n, terms, tfs, at = [], [], [], []
            for k, body in enumerate(b.column("body").to_pylist()):
                tokens = body.translate(BYTES).split()
                if tokens:
                    ids = np.array([t for t in map(number, tokens) if t is not None], "<i4")
                    ids, counts = np.unique(ids, return_counts=True)
                    at.append(k)
                    n.append(len(tokens))
                    terms.append(ids.tobytes())
                    tfs.append(counts.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(n, pa.int64()),
                                              pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), whole_text(text).cast("binary").alias("body"))
    return rows.mapInArrow(read, POSTINGS)


def figures(found: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms in all of them, and the documents that hold each query term."""

    def count(batches):
        df = np.zeros(terms + 2, np.int64)
        for b in batches:
            df[:terms] += np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), "<i4"), minlength=terms)
            df[terms] += b.num_rows
            df[terms + 1] += int(np.asarray(b.column("n")).sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], ["k", "v"])

    total = np.zeros(terms + 2, np.int64)
    for r in found.select("n", "terms").mapInArrow(count, "k bigint, v bigint").groupBy("k").agg(F.sum("v").alias("v")).collect():
        total[r.k] = r.v
    return int(total[terms]), int(total[terms + 1]), total[:terms]


def accumulators(graph: Graph, weight: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores (items x documents) of the postings ``doc, term, tf`` of documents with the norms ``m``."""
    part = np.zeros((len(graph.terms), len(m)), np.int64)
    part[term, doc] = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
    sums = np.empty((graph.nodes, len(m)), np.int64)
    sums[:len(graph.leaf_term)] = part[graph.leaf_term] * graph.leaf_repeats[:, None]
    for first, left, right in graph.levels:
        np.add(sums[left], sums[right], out=sums[first:first + len(left)])
    return np.add.reduceat(sums[graph.parts], graph.starts, axis=0)


class Best:
    """The ``top`` best documents so far of each item: highest score, then smallest id, null ids last."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.zeros(items, np.int64)  # a score below ``least`` cannot enter
        self.found = np.zeros((4, 0), np.int64)  # item, score, whether the id is null, id

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        item, doc = np.nonzero((scores > 0) & (scores >= self.least[:, None]))
        new = np.stack([item, scores[item, doc], null[doc].astype(np.int64), ids[doc]])
        found = np.concatenate([self.found, new], axis=1)
        found = found[:, np.lexsort((found[3], found[2], -found[1], found[0]))]
        first = np.searchsorted(found[0], found[0])  # where the rows of the item begin
        place = np.arange(found.shape[1]) - first
        full = place == self.top - 1
        self.least[found[0, full]] = found[1, full]
        self.found = found[:, place < self.top]


def best_of_tasks(found: DataFrame, graph: Graph, total: int, length: int, df: np.ndarray, top: int) -> DataFrame:
    """``item, doc_id, score``: the best documents of each item among those that a task has read."""
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    step = max(1, CELLS // (graph.nodes + len(graph.parts) + len(graph.terms)))

    def score(batches):
        best = Best(len(graph.items), top)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                terms = b.column("terms").to_pylist()
                term = np.frombuffer(b"".join(terms), "<i4").astype(np.int64)
                tf = np.frombuffer(b"".join(b.column("tfs").to_pylist()), "<i4").astype(np.int64)
                doc = np.repeat(np.arange(b.num_rows), [len(x) // 4 for x in terms])
                m = 100 - 25 + (25 * np.asarray(b.column("n")) * total) // length
                ids = b.column("doc_id")
                best.add(accumulators(graph, weight, doc, term, tf, m), np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()))
        item, points, null, ids = best.found
        yield pa.RecordBatch.from_arrays([pa.array(graph.items[item], pa.int64()), pa.array(ids, mask=null.astype(bool)), pa.array(points)],
                                         ["item", "doc_id", "score"])

    return found.mapInArrow(score, "item bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", top: int = TOP,
           block: int = BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each item with a score above 0."""
    asked = items.select(F.col(item_key).alias("item_id"), whole_text(text).alias("text"))
    texts = written(asked.select("text").distinct().withColumn("item", F.monotonically_increasing_id()), "query-texts")
    blocks = math.ceil(texts.count() / block)
    terms = query_terms(texts.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(max(blocks, 1))).cast("int")))
    nodes, left = (written(df, "query-graph") for df in mined(terms))
    parts = []
    for number in range(blocks):
        graph = graph_of(nodes, left, number)
        if graph.terms:
            found = written(postings(docs, graph, doc_key, text), "query-postings")
            total, length, df = figures(found, len(graph.terms))
            parts.append(written(best_of_tasks(found, graph, total, length, df, top), "query-best"))
            removed(found)
    best = functools.reduce(DataFrame.unionByName, parts) if parts else texts.select("item", F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return asked.join(texts, "text").join(ranked, "item").select("item_id", "rank", "doc_id", "score")
