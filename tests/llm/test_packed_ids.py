"""Bit packing round trip, files against the tokenizers library, odd inputs."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, strategies as st
from llm_helpers import clashing, rows

from sceneframe.llm import packed_ids as p
from sceneframe.llm.word_bpe import WordBpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.integers(1, 32), st.data())
def test_packing_is_exact(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=70)), "<u4")
    packed = p.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8) and p.unpack(packed, bits, len(ids)).tolist() == ids.tolist()


@given(st.lists(st.lists(st.integers(0, 8191), max_size=30), max_size=12), st.integers(1, 9))
def test_random_access(texts, block_ids):
    sink = io.BytesIO()
    out = p.ShardWriter(sink, 13, block_ids)
    for d, ids in enumerate(texts):
        out.add(d or None, np.array(ids, "<u4").tobytes())
    out.close()
    shard = p.ShardReader(sink, len(sink.getvalue()))
    bounds = shard.bounds()
    for d in reversed(range(len(texts))):
        assert [i for part in shard.ids(bounds[d], bounds[d + 1]) for i in part] == texts[d]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@given(st.text(max_size=60))
def test_chunks_give_the_ids_of_the_whole_text(tokenizer, text):
    text = text.encode("utf-8", "ignore").decode()
    got = np.frombuffer(ENCODER.encode(text.encode()), "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


ENCODER = WordBpe(PATH, limit=50)


@pytest.mark.parametrize("text", ["Don't É́h ẖ H̱ <|endoftext|> <|ENDOFTEXT|> ΣΑΣ. İ", "a\x1cb\x85c d", "²½ 12a_b ÿ'LL x'S", "\xad soft"])
def test_known_hard_texts(tokenizer, text):
    assert np.frombuffer(ENCODER.encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_files_hold_all_documents_in_order(spark, edge, edge_rows, tokenizer, tmp_path):
    manifest = p.write_ids(clashing(edge), PATH, str(tmp_path / "ids"))
    got = sorted(map(tuple, p.read_ids(manifest).collect()), key=lambda r: r[1])
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    want = sorted((r[0], len(ids(r[1])), zlib.crc32(np.array(ids(r[1]), "<u4").tobytes())) for r in edge_rows if r[0] is not None)
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == want
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]
    order = [-2**63 if r[0] is None else r[0] for r in got]
    assert order == sorted(order)


def test_empty_table(spark, empty, tmp_path):
    assert rows(p.read_ids(p.write_ids(empty, PATH, str(tmp_path / "none")))) == []
