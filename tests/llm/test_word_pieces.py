"""Chunks put together from pieces that were seen before."""

import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa

from sceneframe.llm import word_bpe as w

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_chunks_of_known_pieces_equal_the_library():
    encoder, asked = w.WordBpe(PATH, limit=50), []

    class Counted:
        def tokenize(self, text):
            asked.append(text)
            return encoder.tokenizer.model.tokenize(text)

    encoder.model = Counted()
    rnd = random.Random(3)
    texts = ["'tis", "''s", "it''s", "'", "'s", "a's", "É'LL", "x<|y", "<|endoftext|>", "µß'd12", "--12,5;", "don't.", "naïve,"]
    texts += [" ".join("".join(rnd.choices("abAB'stdÀß1,.<|", k=rnd.randint(1, 9))) for _ in range(9)) for _ in range(600)]
    for text in texts:
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text.encode()) == struct.pack(f"<{len(ids)}I", *ids), text
    asked.clear()
    encoder.encode(b"Unseenword unseenword, (unseenword) UNSEENWORD")
    assert asked.count("unseenword") == 1
    for text in ("x\x00", "word\x7f", "word\x01", "q|", "word<", "Word7", "É,", "ªº", "µ", "A", ",", "Éé", "a\xad"):
        ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text.encode()) == struct.pack(f"<{len(ids)}I", *ids), text


def encoded_all(encoder, texts, kind="<u4"):
    arrays = encoder.encode_all(pa.array([t.encode() for t in texts], pa.binary()), 2, kind)
    return [ids for array in arrays for ids in array.to_pylist()]


def test_texts_encoded_together_equal_the_library(monkeypatch):
    encoder, rnd = w.WordBpe(PATH, limit=40), random.Random(4)
    texts = ["", " ", "\n", "Word.", "word,%% Word", "É, é. Éa!! ß. ÿ; µ: ª) º] ×, ÷.", "it's, 's. ,'s ''s don't.' É's,", "T̈, T̈", "a ≠ ≮ x́, é.",
             "<|endoftext|>", "a<|ENDOFTEXT|>, B.", "x<| |> a|> <|, b", "Σ, ΑΣ. İ, ǰ. ﬁ!", "a\xa0b, c\x85d.", "a\x0b,b.\x0c c,\x0b", "a\x1cB, \x00.", "a…, b,… “a,” —b.",
             "1, a1. 1a, A-b, (C) x.y,z.", "日本,語。A,", "́a, ́,", "x" * 300 + ".", "a,\nB.\r\nc!\tD;", "Ⅷ, ² a². ½,"]
    alphabet = ["a", "B", "the ", "É", "ß", "ç", "x", " ", " ", "\n", "\x0b", "\xa0", "'", "s", "T", ",", ".", "!", "<", "|", ">", "=", "7", "×", "ª", "µ"]
    texts += ["".join(rnd.choices(alphabet, k=rnd.randint(1, 30))) for _ in range(1500)]
    texts += ["".join(rnd.choices([*alphabet, "̈", "̸", "́", "Σ", "…", "K", "日"], k=rnd.randint(1, 20))) for _ in range(1500)]
    want = []
    for text in texts:
        ids = [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want.append(struct.pack(f"<{len(ids)}I", *ids))
    for size in (1, 200, 1 << 20):
        monkeypatch.setattr(w, "SLICE", size)
        got = encoded_all(encoder, texts[:60] if size == 1 else texts)
        assert len(got) == (60 if size == 1 else len(texts))
        for text, a, b in zip(texts, got, want):
            assert a == b, text
    assert encoded_all(encoder, []) == []
    assert encoded_all(encoder, texts, "<u2") == [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in want]


def test_a_word_is_kept_once_whatever_its_marks_and_case():
    encoder = w.WordBpe(PATH)
    marks = ["", ",", ".", "!!", "%%%", ".%%%", ")", '"', "&&&"]
    encoded_all(encoder, [f"{word}{mark}" for word in ("unseenword", "Unseenword", "Éunseen", "éunseen") for mark in marks])
    assert set(encoder.chunks) - {b""} == {b"unseenword", "éunseen".encode(), *(mark.encode() for mark in marks if mark)}
