"""Lattice language model: marginals and base scores against brute force."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, strategies as st
from llm_helpers import clashing

from sceneframe.llm import lattice_lm as m

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = [(bytes([b]), e) for b in b"abc" for e in (False, True)] + [(b"ab", False), (b"bc", True), (b"abc", True), (b"aa", False)]
SCORES = np.log(np.linspace(1, 2, len(PIECES)) / np.linspace(1, 2, len(PIECES)).sum())


def cuts(word):
    """All segmentations into pieces, the last one word-final."""
    score = {p: s for p, s in zip(PIECES, SCORES)}
    for k in range(len(word)):
        for at in itertools.combinations(range(1, len(word)), k):
            parts = [word[i:j] for i, j in zip((0, *at), (*at, len(word)))]
            keys = [(p, i == len(parts) - 1) for i, p in enumerate(parts)]
            if all(x in score for x in keys):
                yield keys, sum(score[x] for x in keys)


@given(st.text(alphabet="abc", min_size=1, max_size=7))
def test_marginal_and_expectations(word):
    lattice, used = m.Lattice(PIECES, SCORES), np.zeros(len(PIECES))
    word = word.encode()
    found = list(cuts(word))
    total = math.log(sum(math.exp(s) for _, s in found))
    lattice.expect(word, used)
    want = Counter()
    for keys, s in found:
        for x in keys:
            want[PIECES.index(x)] += math.exp(s - total)
    assert math.isclose(lattice(word), total) and np.allclose(used, [want[k] for k in range(len(PIECES))])


def test_words_of_one_length_go_together(monkeypatch):
    rnd = np.random.default_rng(5)
    scores = SCORES - 9 * (np.arange(len(SCORES)) % 2)
    lattice, alone = m.Lattice(PIECES, scores), []
    words = ["".join(rnd.choice(list("abc"), 1 + k % 11)).encode() for k in range(400)]
    words += [b"abc" * 200, b"ab" * 30, b"aab" * 9]  # too long for doubles; alone in their lengths
    want, expected = [lattice(w) for w in words], np.zeros(len(PIECES))
    for w in words:
        lattice.expect(w, expected)
    forward = m.Lattice._forward
    monkeypatch.setattr(m.Lattice, "_forward", lambda self, word: alone.append(word) or forward(self, word))
    used = np.zeros(len(PIECES))
    assert np.allclose(lattice.many(words), want, rtol=1e-12)
    lattice.expect_many(words, used)
    assert np.allclose(used, expected) and alone == words[-1:-4:-1] * 2
    assert lattice.many([]).tolist() == [] and len(words[-3]) > lattice.most_bytes


def test_pieces_cover_every_byte():
    pieces, numbers = m.vocabulary(PATH)
    assert {p for p in pieces if len(p[0]) == 1} == {(bytes([b]), e) for b in range(256) for e in (False, True)}
    assert len(pieces) == len(numbers) == 49_406


def brute(rows):
    train = Counter()
    tokens = [[*(t or "").encode().lower().split(), None] for _, t, *_ in rows]
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 1 for r in rows]
    for ws, out in zip(tokens, held):
        if not out:
            train.update(ws)
    n, v = sum(train.values()), len(train)
    return [(r[0], out, len(ws), sum(train[w] > 0 for w in ws), n, sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
            for r, out, ws in zip(rows, held, tokens)]


def test_base_score(spark, edge, edge_rows, empty):
    rows = [r for r in edge_rows if r[0] is None or r[0] < 2**40]
    df = spark.createDataFrame(rows, edge.schema)
    got = sorted(map(tuple, m.score_documents(clashing(df), PATH).collect()), key=repr)
    for a, b in zip(got, sorted(brute(rows), key=repr)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and -math.inf < a[6] < 0
    assert m.score_documents(empty, PATH).count() == 0


@pytest.mark.parametrize("known", [True, False])
def test_known_words_are_likelier(spark, known):
    ids = [d for d in range(40) if (zlib.crc32(str(d).encode()) % 5 == 1) != known][:3]
    rows = [(d, "tarin mola tarin kelo", "", "", 0) for d in range(100, 160) if zlib.crc32(str(d).encode()) % 5 != 1]
    df = spark.createDataFrame(rows + [(ids[0], "tarin mola tarin", "", "", 0), (ids[1], "xqzvv jjkwp xqzvv", "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    score = {r.doc_id: r.score for r in m.score_documents(df, PATH).collect()}
    assert score[ids[0]] > score[ids[1]]
