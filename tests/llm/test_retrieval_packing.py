"""Packing: every id once, gapless windows, little padding, neighbours together."""

from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from llm_helpers import clashing

from sceneframe.llm import retrieval_packing as r

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, sizes, window):
    """Each document's pieces partition it; each sequence is gapless and full, or of a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for d, start, length, sequence, offset in pieces:
        assert length > 0
        by_doc[d].append((start, length))
        by_sequence[sequence].append((offset, length))
    assert {d: sum(n for _, n in x) for d, x in by_doc.items()} == {d: n for d, n in enumerate(sizes) if n}
    for parts in [*by_doc.values(), *by_sequence.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    for parts in by_sequence.values():
        total = sum(n for _, n in parts)
        assert total == window or total < window and total & (total - 1) == 0


@settings(max_examples=60)
@given(st.lists(st.lists(st.integers(0, 40), max_size=50), max_size=25), st.sampled_from([4, 16, 64]))
def test_every_id_lies_in_one_piece(texts, window):
    check(r.pack_shard([np.array(t, "<u4") for t in texts], window), [len(t) for t in texts], window)


def test_neighbours_share_a_window():
    rnd = np.random.default_rng(0)
    texts = [rnd.integers(1000 * (k % 10), 1000 * (k % 10) + 60, 25).astype("<u4") for k in range(40)]
    together = defaultdict(set)
    for d, _, _, sequence, _ in r.pack_shard(texts, 100):
        together[sequence].add(d % 10)
    assert all(len(kinds) == 1 for kinds in together.values())


def test_bm25_equals_brute_force():
    rnd = np.random.default_rng(1)
    texts = [rnd.integers(0, 30, rnd.integers(1, 20)) for _ in range(12)]
    index = r.Bm25(texts)
    mean = np.mean([len(t) for t in texts])
    df = {t: sum(t in x for x in texts) for t in range(30)}

    def weight(t, x):
        tf = list(x).count(t)
        return np.log1p((12 - df[t] + .5) / (df[t] + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(x) / mean))

    for seed in range(12):
        query = [int(index.terms[i]) for i in index.queries[seed]]
        scores = [sum(weight(t, x) for t in query) for x in texts]
        near = index.neighbours(seed, np.ones(12, bool))
        assert np.allclose(sorted((s for s in scores if s > 0), reverse=True), [scores[k] for k in near], rtol=1e-4)


def test_every_term_of_the_seed_is_scored():
    # 60 rare terms of the seed alone weigh more than the 40 that each neighbour shares one of
    seed = np.concatenate([np.repeat(np.arange(100, 160), 3), np.arange(40)])
    texts = [seed, *[np.array([k, 200 + k, 300 + k]) for k in range(40)], np.array([500, 501, 502])]
    index = r.Bm25(texts)
    assert sorted(index.terms[index.queries[0]].tolist()) == [*range(40), *range(100, 160)]
    assert sorted(index.neighbours(0, np.arange(len(texts)) > 0)) == list(range(1, 41))


def test_long_texts_equal_brute_force_on_the_whole_seed():
    rnd = np.random.default_rng(2)
    texts = [rnd.integers(0, 400, 150) for _ in range(10)]
    index, mean, sets = r.Bm25(texts), 150, [set(x.tolist()) for x in texts]

    def weight(t, x):
        tf, df = (x == t).sum(), sum(t in s for s in sets)
        return np.log1p((10 - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(x) / mean))

    for seed in range(10):
        assert len(sets[seed]) > 24
        scores = np.array([sum(weight(t, x) for t in sets[seed]) for x in texts])
        near = index.neighbours(seed, np.ones(10, bool))
        assert sorted(near) == np.flatnonzero(scores > 0).tolist() and np.allclose(-np.sort(-scores), scores[near], rtol=1e-4)


def test_figures_of_all_documents(edge, edge_rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rests = [([*tokenizer.encode(t or "", add_special_tokens=False).ids, r.END_ID]) for _, t, *_ in edge_rows]
    rests = [x[len(x) // 64 * 64:] for x in rests]
    rows = edge.selectExpr("doc_id as key", "xxhash64(text) as tie", "cast(coalesce(text, '') as binary) as body")
    got = r.corpus_of(r.encoded(rows, PATH), 64)
    want = defaultdict(int)
    for x in rests:
        for t in set(x):
            want[t] += 1
    assert (got.n, got.mean) == (len(rests), np.mean([len(x) for x in rests])) and {t: got.df[t] for t in np.flatnonzero(got.df)} == want
    none = r.corpus_of(r.encoded(empty.selectExpr("doc_id as key", "doc_id as tie", "cast(text as binary) as body"), PATH), 64)
    assert (none.n, none.mean, len(none.df)) == (0, 0, 0)


def test_rarity_is_that_of_all_documents():
    # in these texts 1 is rarer than 2; in all documents 1 is common and 2 is rare
    texts = [np.array(t, "<u4") for t in ([1, 2], [1, 7], [2, 8], [2, 9], [3, 4], [5, 6])]
    df = np.ones(10, np.int64)
    df[1] = 900
    free = np.arange(6) > 0
    assert r.Bm25(texts).neighbours(0, free)[0] == 1
    assert r.Bm25(texts, r.Corpus(1000, 2.0, df)).neighbours(0, free)[0] == 2


def test_rows_and_lists_give_the_same_scores(monkeypatch):
    # terms of all rarities, so that some are rows and some are lists; equal texts tie in their order
    rnd = np.random.default_rng(8)
    texts = [np.minimum(rnd.geometric(0.01, 120), 900) for _ in range(150)]
    texts += texts[:20]
    free = np.arange(170) % 7 > 0
    mixed = r.Bm25(texts)
    assert 0 < len(mixed.rows) < len(mixed.terms) and len(mixed.holder) < sum(map(len, mixed.queries)) / 4
    monkeypatch.setattr(r, "COMMON", 0)
    lists = r.Bm25(texts)
    assert len(lists.rows) == 0
    for seed in range(170):
        a, b = mixed.neighbours(seed, free), lists.neighbours(seed, free)
        assert sorted(a) == sorted(b) and (a == b).mean() > 0.9
        assert all(list(a).index(k) < list(a).index(k + 150) for k in range(20) if free[k] and free[k + 150] and k in a)


def test_terms_are_the_distinct_ids():
    for ids in ([], [3, 1, 3], [60_000, 5, 5], [2]):
        for kind in ("<u2", "<u4"):
            want = np.unique(np.array(ids, kind), return_counts=True)
            got = r.counted(np.array(ids, kind))
            assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_documents(edge, edge_rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    got = r.pack_documents(clashing(edge), PATH, window=64, shard_rows=6).collect()
    assert sum(p.length for p in got) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in edge_rows)
    by_sequence = defaultdict(list)
    for p in got:
        by_sequence[p.sequence_id].append(p)
    for parts in by_sequence.values():
        assert [p.offset for p in sorted(parts, key=lambda p: p.offset)] == [0, *np.cumsum([p.length for p in sorted(parts, key=lambda p: p.offset)])[:-1]]
    assert r.pack_documents(empty, PATH).count() == 0


def tokens_of(spark, arrays):
    rows = [(d, d, bytearray(np.asarray(x, "<u2").tobytes()), d) for d, x in enumerate(arrays)]
    return spark.createDataFrame(rows, "key long, tie long, ids binary, row long").repartition(4)


def test_neighbours_share_a_shard(spark):
    # eight topics of 60 rests, dealt into eight shards; by chance an eighth of a topic would meet
    rnd = np.random.default_rng(4)
    arrays = [np.append(rnd.integers(100 * (d % 8), 100 * (d % 8) + 100, 40), rnd.integers(800, 1000, 40)) for d in range(480)]
    tokens = tokens_of(spark, arrays)
    got = r.dealt(tokens, 4096, "<u2", r.corpus_of(tokens, 4096, "<u2"), 60).collect()
    assert sorted((g.key, bytes(g.ids)) for g in got) == [(d, x.astype("<u2").tobytes()) for d, x in enumerate(arrays)]
    held = defaultdict(list)
    for g in got:
        held[g.shard].append(g.key % 8)
    assert set(held) <= set(range(8)) and max(map(len, held.values())) < 90
    meeting = sum(topics.count(t) for topics in held.values() for t in topics) / (480 * 60)
    assert meeting > 0.6


def test_one_text_in_all_rows_is_spread_over_shards(spark):
    tokens = tokens_of(spark, [np.array([5, 6, 7, 2])] * 2000)
    counts = r.dealt(tokens, 4096, "<u2", r.corpus_of(tokens, 4096, "<u2"), 100).groupBy("shard").count().collect()
    assert len(counts) == 20 and max(c["count"] for c in counts) < 160


def test_a_cell_names_the_nearest_pivots():
    corpus = r.Corpus(100, 4.0, np.full(50, 10))
    pivots = [np.array([1, 2, 3]), np.array([3, 4, 5]), np.array([20, 21]), np.array([30, 31])]
    cells = r.Cells(pivots, corpus)
    rank = [int(np.argmax(cells.columns[p[-1]])) for p in pivots]
    near = cells.of(np.array([4, 5, 5, 3, 1]))
    assert (near // r.PIVOTS ** 2, near // r.PIVOTS % r.PIVOTS) == (rank[1], rank[0])
    assert r.Cells([], r.Corpus(0, 0, np.zeros(0, np.int64))).of(np.zeros(0, np.int64)) == 0


def test_cells_of_blocks_equal_brute_force():
    rnd = np.random.default_rng(6)
    rests = [np.minimum(rnd.geometric(0.02, rnd.integers(0, 90)), 400).astype("<u2") for _ in range(3 * r.BLOCK + 5)]
    df = np.maximum(1, np.bincount(np.concatenate([np.unique(x) for x in rests]), minlength=401))
    cells = r.Cells([x for x in rests if len(x) > 60][:9], r.Corpus(len(rests), 45.0, df))
    got = cells.of_all(rests)
    assert len(set(got.tolist())) > 20 and got.tolist() == [cells.of(x) for x in rests]
    for rest, cell in zip(rests, got.tolist()):
        terms = np.unique(rest)
        score = (cells.idf[terms, None] * cells.columns[terms]).sum(0)
        ranks = [cell // r.PIVOTS ** 2, cell // r.PIVOTS % r.PIVOTS, cell % r.PIVOTS]
        assert len(set(ranks)) == 3 and np.allclose(score[ranks], -np.sort(-score)[:3], atol=1e-5)
    assert cells.of_all([]).tolist() == []
