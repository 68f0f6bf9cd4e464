import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm_helpers import clashing, rows
from sceneframe.llm import lexical_search as s

ITEM, DOC = "item_id long, text string", "doc_id long, text string"
LOWER = str.maketrans(s.UPPER, s.UPPER.lower())


def words(text):
    return re.findall(s.TERM, (text or "").translate(LOWER))


def brute(docs, items, top=20):
    held = [(d, Counter(words(t))) for d, t, *_ in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    total, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    found = []
    for item, text, *_ in items:
        scored = []
        for d, c, n in held:
            m = 100 - 25 + (25 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in words(text) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        found += [(item, r + 1, d, -score) for r, (score, _, _, d) in enumerate(sorted(scored)[:top])]
    return sorted(found, key=repr)


def corpus(seed, n=150):
    rnd = random.Random(seed)
    vocab = ["the", "Of", "ÄRGER", "ärger", "x1", "été", "日本", "k"] + [f"w{k}" for k in range(60)]
    text = lambda k: rnd.choice([" ", "-", "\n", "_", "\x00"]).join(rnd.choices(vocab, [40 / (r + 1) for r in range(len(vocab))], k=k))
    docs = [(k * 7 % 1009, text(rnd.randint(0, 60))) for k in range(n)] + [(2000 + k, "same words the of") for k in range(n // 2)]
    docs += [(None, "same words the of"), (None, None), (5000, None), (5001, ""), (5002, " .. "), (5003, text(20_000)), (2000, "same words the of")]
    passage = text(30)
    items = [(k, passage[: 20 * k] + " " + text(rnd.randint(1, 25))) for k in range(12)] + [(50, "same words"), (50, "same words"), (51, "OF of Of THE")]
    return docs, items + [(52, None), (53, ""), (54, "unknownterm"), (None, passage), (55, passage), (56, text(3000))]


@pytest.mark.parametrize("seed,block", [(0, 1000), (1, 5)])
def test_equals_brute_force(spark, seed, block):
    docs, items = corpus(seed)
    got = s.search(spark.createDataFrame(docs, DOC).repartition(5), spark.createDataFrame(items, ITEM), block=block)
    assert rows(got) == brute(docs, items)


def test_graph_shares_sums_and_keeps_items_whole(spark):
    items = [(k, f"alpha beta gamma delta own{k} own{k}") for k in range(6)] + [(9, "alpha beta")]
    texts = spark.createDataFrame([(0, k, t) for k, t in items], "block int, item long, text string")
    nodes, left = s.mined(s.query_terms(texts))
    graph = s.graph_of(nodes, left, 0)
    assert len(graph.levels) >= 1 and len(graph.parts) < sum(len(set(t.split())) for _, t in items)
    one = np.arange(len(graph.terms))  # every term in one document: scores count the terms of an item
    got = s.accumulators(graph, np.ones(len(one), np.int64), one * 0, one, one * 0 + 1, np.zeros(1, np.int64)) // 1_000_000
    assert dict(zip(graph.items.tolist(), got[:, 0].tolist())) == {k: len(t.split()) for k, t in items}


def test_ties_by_ascending_id_and_fewer_than_top(spark):
    docs = [(k, "copy of one text") for k in range(50, 0, -1)] + [(99, "else")]
    got = s.search(spark.createDataFrame(docs, DOC).repartition(4), spark.createDataFrame([(1, "copy else")], ITEM)).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [99, *range(1, 20)] and [r.rank for r in got] == [*range(1, 21)]


def test_empty_and_clashing(spark):
    docs, items = corpus(3, 20)
    d, i = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    assert rows(s.search(clashing(d), clashing(i).withColumn("score", i.text))) == brute(docs, items)
    assert s.search(d.limit(0), i).count() == 0 and s.search(d, i.limit(0)).count() == 0
