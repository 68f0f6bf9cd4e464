"""Prefix BPE against the tiktoken library, appends and edits, round trip."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from llm_helpers import clashing

from sceneframe.llm import byte_bpe as b

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ENCODER = b.text_encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text):
    return [int(x) for x in ENCODER.shown(text).split()]


@settings(max_examples=300)
@given(st.text(max_size=80) | st.text(alphabet="ab \n\t' stre \x1c1é—", max_size=80))
def test_equals_library(reference, text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids_of(text) == reference.encode_ordinary(text)
    assert ENCODER.decoded(ENCODER.shown(text)) == text.encode()


def test_hard_pieces(reference):
    rnd = random.Random(0)
    texts = ["a" * 3000, " " * 500, "=" * 777, "ab" * 900, "\n" * 40 + "x", "x  y", " lead", "trail ", "'LL we'll", "😀" * 50]
    texts += ["".join(rnd.choices("aeinorst", k=rnd.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        assert ids_of(text) == reference.encode_ordinary(text)


def test_every_token_encodes_to_itself():
    assert all(ENCODER.bpe.encode(t) == [i] for t, i in random.Random(1).sample(list(ENCODER.bpe.ranks.items()), 4000))


@settings(max_examples=150)
@given(st.text(alphabet="abcdeinost", max_size=300), st.text(alphabet="abcdeinost", max_size=8), st.data())
def test_appends_and_edits_are_exact(piece, new, data):
    bpe, piece, new = ENCODER.bpe, piece.encode(), new.encode()
    table = bpe.extend([], piece)
    assert bpe.read(bpe.extend(list(table), piece + new)) == bpe.encode(piece + new)
    begin = data.draw(st.integers(0, len(piece)))
    stop = data.draw(st.integers(begin, len(piece)))
    fresh, after = bpe.edited(table, piece, begin, stop, new)
    assert after == piece[:begin] + new + piece[stop:] and bpe.read(fresh) == bpe.encode(after) and len(fresh) == len(after)


def test_documents(reference, edge, edge_rows, empty):
    encoded = b.encode_documents(clashing(edge), PATH, public_tokenizers.PATTERN)
    got = sorted(map(tuple, b.decode_documents(encoded, PATH, public_tokenizers.PATTERN).collect()), key=repr)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = []
    for doc, text, *_ in edge_rows:
        ids = reference.encode_ordinary(text or "")
        want.append((doc, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert got == sorted(want, key=repr)
    assert b.decode_documents(b.encode_documents(empty, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).count() == 0


def test_workers_hold_each_run_once_and_few_rows(spark):
    encoder = b.text_encoder.__wrapped__(PATH, public_tokenizers.PATTERN)
    texts = [" ".join(f"run{w}x{i}" for i in range(500)) + " one two" for w in range(3)]
    for text in texts:
        assert encoder.decoded(encoder.shown(text)) == text.encode()
    assert "two" in encoder.run_ids and " two" not in encoder.piece_ids
    assert 2 * (encoder.run_ids.limit + encoder.piece_ids.limit + encoder.bpe._fits.limit) <= 1_000_000  # two generations
    rows = spark.range(2500).selectExpr("id AS doc_id", "repeat('ab ', 3) AS text")
    encoded = b.encode_documents(rows, PATH, public_tokenizers.PATTERN)
    assert b.decode_documents(encoded, PATH, public_tokenizers.PATTERN).distinct().count() == 2500
    assert max(x.num_rows for x in b.parts([b.pa.RecordBatch.from_pydict({"a": list(range(2500))})])) == b.AT_ONCE
