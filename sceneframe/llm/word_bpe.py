"""Token ids of whole texts by a tokenizers file, chunk by chunk.

The file's splitting pattern never crosses white space, so the ids of a text are those of its white-space-separated chunks
in order. Each task keeps the ids of recent chunks; a chunk it has not seen is put together from
its pieces, and a piece it has not seen goes through the tokenizers library. ``encode_all`` takes an Arrow array of texts:
it looks up each distinct chunk of some megabytes of text once, and the words it has not seen go through the library together.
"""

from __future__ import annotations

import functools
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from sceneframe.llm.recent import Recent

# fixed splitting pattern of the vocabulary file, over lower-cased text
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# printable Latin-1 only: there lower-casing is one to one and normal form C changes nothing
PLAIN = regex.compile(r"[\x21-\x7E\xA1-\xAC\xAE-\xFF]+")
# for texts of Latin-1 without special tokens: there marks behind a letter are made a chunk of their own, since only a piece
# like 's has both, and it begins with its mark
OTHER = r"[^\x00-\x{FF}]|<\|"
MARKED, PARTED = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~]+)(\s|$)", r"\1 \2\3"
WORD = r"^[a-zß-öø-ÿ]+$"
SLICE = 4 << 20  # bytes of text that are looked up together


def byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(0x100 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """``encode(bytes)`` gives the ids of a UTF-8 text as packed little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.shown = byte_characters()
        self.written = dict(enumerate(self.shown))
        self.written_apart = self.written | {ord(" "): " "}
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.chunks = Recent(self._chunk, limit)

    def _chunk(self, chunk: bytes) -> bytes:
        small = chunk.lower()
        if small.isalpha():  # ASCII letters: one piece that is written as it is
            if small != chunk:
                return self.chunks[small]
            return self._ids(small.decode())
        if small[:-1].isalpha() and b"!" <= small[-1:] <= b"~":  # these and one mark or digit, a piece of its own
            return self.chunks[small[:-1]] + self.chunks[small[-1:]]
        text = chunk.decode("utf-8")
        if PLAIN.fullmatch(text) and "<|" not in text:
            lower = text.lower()
            if not lower.isalpha():
                pieces = PIECES.findall(lower)
                if len(pieces) > 1:  # each is a chunk as well, and most have been seen: words and marks
                    return b"".join([self.chunks[piece.encode()] for piece in pieces])
            return self._ids(lower if lower.isascii() else lower.encode("utf-8").decode("latin-1").translate(self.written))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, piece: str) -> bytes:
        """Of one piece, as the vocabulary writes it."""
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def _learn(self, words: list[bytes]) -> None:
        """Ask the library for the unseen ones of some words of small Latin-1 letters, each one piece."""
        chunks = self.chunks
        new = [word for word in words if word not in chunks and word not in chunks.old]
        for word, piece in zip(new, b" ".join(new).decode("latin-1").translate(self.written_apart).split(" ")):
            chunks.keep(word, self._ids(piece))

    def encode_all(self, texts: pa.Array, end_id: int, kind: str = "<u4") -> Iterator[pa.Array]:
        """The packed ids of each text and its end as integers of a ``kind``, for one slice of the texts after the other."""
        texts = texts.cast(pa.large_binary())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE)))
            yield self._encode_slice(texts.slice(at, stop - at), end_id, kind)
            at = stop

    def _encode_slice(self, texts: pa.Array, end_id: int, kind: str) -> pa.Array:
        texts = texts.cast(pa.large_string())
        latin = pc.invert(pc.match_substring_regex(texts, OTHER))
        texts = pc.if_else(latin, pc.utf8_lower(pc.replace_substring_regex(texts, MARKED, PARTED)), texts)
        split = pc.ascii_split_whitespace(texts)
        found = split.flatten().dictionary_encode()
        chunks = found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        self._learn(chunks[pc.match_substring_regex(found.dictionary, WORD).to_numpy(zero_copy_only=False)].tolist())
        ids = [*map(self.chunks.__getitem__, chunks), struct.pack("<I", end_id)]
        data = np.frombuffer(b"".join(ids), "<u4").astype(kind)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4 * data.itemsize
        table = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(data)])
        borders = np.asarray(split.offsets) - split.offsets[0].as_py()
        taken = table.take(pa.array(np.insert(found.indices.to_numpy(), borders[1:], len(chunks))))  # with the end behind each text
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[borders + np.arange(len(borders))]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), taken.buffers()[2]])


@functools.cache
def word_bpe(path: str) -> WordBpe:
    """One per worker process, so its chunks serve all tasks that the process runs."""
    return WordBpe(path)
