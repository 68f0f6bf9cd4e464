"""Similarity classes against brute force."""

import random
import re

import numpy as np
import pytest
from llm_helpers import clashing, rows

from sceneframe.llm import jaccard_join as j


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """docs: (doc_id, text); gives (doc_id, n_shingles, component_id), by all pairs that share a shingle."""
    sets, label, holders = [shingle_set(t) for _, t in docs], list(range(len(docs))), {}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for k, s in enumerate(sets):
        near = {}
        for x in s:
            for other in holders.setdefault(x, []):
                near[other] = near.get(other, 0) + 1
            holders[x].append(k)
        for other, common in near.items():
            if 100 * common >= 75 * (len(s) + len(sets[other]) - common):
                label[root(k)] = root(other)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[root(k)] = min(least.get(root(k), d), d)
    return [(d, len(sets[k]), least.get(root(k)) if sets[k] else d) for k, (d, _) in enumerate(docs)]


def family(rnd, base, n, share):
    """Texts that differ from ``base`` in some words."""
    return [" ".join(w if rnd.random() > share else f"z{rnd.randint(0, 400)}" for w in base) for _ in range(n)]


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 3000)}"
    texts = [" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    for share in (0.01, 0.025, 0.04):
        texts += family(rnd, [word() for _ in range(rnd.randint(30, 120))], 40, share)
    # a chain: each text drops words of the one before
    chain = [word() for _ in range(100)]
    texts += [" ".join(chain[6 * k:6 * k + 60]) for k in range(6)]
    # one passage that dominates many texts without linking them
    passage = [word() for _ in range(80)]
    texts += [" ".join(passage + [word() for _ in range(22)]) for _ in range(40)]
    texts += rnd.choices(texts, k=40) + ["a b c", "A b C", "a b c d", "", " "]
    return [(k * 7 % 1009, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(j.report(df)) == sorted(brute(docs), key=repr)


def test_leaders_leave_few_pairs_of_a_large_family(spark):
    # most near copies link to their base but not to each other's leader; the base doesn't have the least id
    rnd, n = np.random.default_rng(6), 120
    base = rnd.integers(0, 2**63, 150).astype("<u8")
    sets = [base, *(np.concatenate([rnd.permutation(base)[:150 - k], rnd.integers(0, 2**63, k).astype("<u8")])
                    for k in rnd.integers(8, 18, n - 1))]
    table = [(int(i), 150, bytearray(np.sort(s).tobytes())) for i, s in zip(np.roll(np.arange(n), 60), sets)]
    df = j.written(spark.createDataFrame(table, "id long, n long, shingles binary"), "family")
    index, bits = j.index_lists(df), j.written(j.bitmaps(df), "bitmaps")
    assert j._cross_pairs(index, df.selectExpr("id", "id as label"), bits).count() > 20 * n
    labels = j.led_labels(df, index, bits)
    assert j._cross_pairs(index, labels, bits).count() < n
    assert j.linked_sets(df).select("label").distinct().count() == 1


def test_odd_inputs(edge, edge_rows, empty):
    want = sorted(brute([r[:2] for r in edge_rows]), key=repr)
    assert rows(j.report(clashing(edge))) == want
    assert j.report(empty).count() == 0 and j.one_per_class(empty).count() == 0


def test_one_document_of_each_class_stays(spark, edge):
    wide = clashing(edge)
    kept = j.one_per_class(wide)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.text)
    assert kept.columns == wide.columns and ids == [-3, 1, 1, 6, 7, 8, 11, 12, 2**62]


def test_one_row_of_repeated_rows_stays(spark, edge):
    got = sorted(r.doc_id for r in j.one_per_class(clashing(edge)).collect() if r.doc_id is not None and (r.text or "").strip())
    assert got == [-3, 1, 1, 7, 8, 11, 12, 2**62]  # id 1 has two texts, one of them in two rows
    nameless = spark.createDataFrame([(None, "a b c d e f"), (None, "u v w x y z"), (None, "u v w x y z")], "doc_id long, text string")
    assert sorted(r.text for r in j.one_per_class(nameless).collect()) == ["a b c d e f", "u v w x y z"]
    text = "one two three four five six seven eight"
    twice = spark.createDataFrame([(k % 3, text) for k in range(9)] + [(7, None), (7, None), (7, " ")], "doc_id long, text string")
    assert rows(j.one_per_class(twice.repartition(4))) == sorted([(0, text), (7, None), (7, None), (7, " ")], key=repr)


def test_real_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(j.report(df)) == sorted(brute([(r.doc_id, r.text) for r in df.collect()]), key=repr)
