"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that its encoding can end with. The table of these last tokens is
built from left to right: a token fits behind a prefix when it is compatible with that prefix's last token, that is, when
BPE would keep the border between the two. Reading the table backwards gives the encoding. So an append goes on where the
table ends, and after an edit the table is rebuilt from the edit only until it agrees with the old one again.

Texts are cut by the vocabulary's pattern; pieces never cross from non-space to space, so the ids of such runs are kept per
worker process, in a bounded cache; a run of one piece is kept once. There is no shuffle.

Defined results: a null text counts as empty and has no ids; a text of any length is encoded whole; every row gets a row;
only the named columns are read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from sceneframe.llm.recent import Recent
from sceneframe.llm.text import whole_text

NEVER = 1 << 60
AT_ONCE = 1000  # documents of a batch that are Python objects together


class Endings:
    """Every way in which the bytes read so far can begin or be a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.made = ranks, {}
        self.beginnings = {t[:n] for t in ranks for n in range(len(t) + 1)}

    def of(self, read: bytes) -> Ending:
        """The ending of some bytes, made when it is first met; there are no more of them than beginnings of tokens."""
        while read not in self.beginnings:
            read = read[1:]
        if read not in self.made:
            self.made[read] = Ending(self, read)
        return self.made[read]


class Ending(dict):
    """The longest end of the bytes read so far that begins a token; ``ending[byte]`` is the one after the next byte."""

    __slots__ = ("among", "read", "tokens")

    def __init__(self, among: Endings, read: bytes):
        super().__init__()
        self.among, self.read = among, read
        tails = [read[i:] for i in range(len(read))]
        self.tokens = [(len(t), among.ranks[t]) for t in tails if t in among.ranks]  # all that end here, longest first

    def __missing__(self, byte: int) -> Ending:
        self[byte] = after = self.among.of(self.read + bytes([byte]))
        return after


class ByteBpe:
    """Encoder over ranks (token bytes -> id); ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], memory: int = 200_000):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._ending = Endings(ranks).of(b"")
        self._spines = {}
        self._fits = Recent(self._keeps_border, memory)

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge gives a token of two bytes or more: merge by rank until two parts are left."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                raise ValueError(f"token {token!r} cannot be merged from its bytes")
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """Parts that stand at the left (0) or right (1) border while the token grows, each with the rank that ends it."""
        key = 2 * token + side
        if key not in self._spines:
            part, ends, out = self.tokens[token], NEVER, []
            while True:
                out.append((part, ends))
                if len(part) == 1:
                    break
                ends = self.ranks[part]
                part = self._halves(part)[side]
            self._spines[key] = out
        return self._spines[key]

    def _keeps_border(self, pair: int) -> bool:
        """No part at the right border of the first token ever merges with one at the left border of the second.

        ``pair`` holds the first token in its upper bits, the second in its lower 32.
        """
        get = self.ranks.get
        for left, left_ends in self._spine(pair >> 32, 1):
            for right, right_ends in self._spine(pair & 0xFFFFFFFF, 0):
                rank = get(left + right)
                # of equal ranks the leftmost merge comes first
                if rank is not None and rank < left_ends and rank <= right_ends and self._together(left, right, left_ends, right_ends):
                    return False
        return True

    def _together(self, left: bytes, right: bytes, left_ends: int, right_ends: int) -> bool:
        """Both parts are there at the same time: each is made before the other ends."""
        made = lambda part: -1 if len(part) == 1 else self.ranks[part]
        return made(left) <= right_ends and made(right) < left_ends

    def extend(self, table: list[int], piece: bytes, stop: int | None = None) -> list[int]:
        """Grow the table of last tokens, by prefix length from 1, to the whole piece (or to ``stop`` bytes)."""
        fits, at = self._fits, len(table)
        ending = self._ending
        for byte in piece[max(0, at - self.longest):at]:  # no token that ends later begins before these
            ending = ending[byte]
        for end, byte in enumerate(piece[at:stop], at):
            ending = ending[byte]
            for size, token in ending.tokens:
                if size > end or fits[table[end - size] << 32 | token]:
                    table.append(token)
                    break
            else:
                raise ValueError("a byte of the text is not in the vocabulary")
        return table

    def edited(self, table: list[int], piece: bytes, begin: int, stop: int, new: bytes) -> tuple[list[int], bytes]:
        """Table and bytes after ``piece[begin:stop]`` became ``new``; work stops where the old table holds again."""
        after = piece[:begin] + new + piece[stop:]
        shift, fresh, same = len(after) - len(piece), table[:begin], 0
        while len(fresh) < len(after):
            at = len(fresh)
            self.extend(fresh, after, at + 1)
            # a cell depends on the last ``longest`` cells and bytes
            same = same + 1 if at >= begin + len(new) and fresh[at] == table[at - shift] else 0
            if same >= self.longest:
                fresh += table[at + 1 - shift:]
        return fresh, after

    def read(self, table: list[int]) -> list[int]:
        """The encoding: last tokens from the end of the piece to its start."""
        ids, end = [], len(table)
        while end:
            ids.append(table[end - 1])
            end -= len(self.tokens[table[end - 1]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        return self.read(self.extend([], piece))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextEncoder:
    """Encodes texts piece by piece; ids come as decimal numbers joined by spaces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = 150_000):
        self.bpe = ByteBpe(ranks)
        # space as Unicode defines it, whatever the engine's \s is
        unicode_space = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pieces = regex.compile(unicode_space)
        self.wide_gap = regex.compile(r"[\p{White_Space}\x1c-\x1f] ")
        self.numbers = {i: b"%d" % i for i in ranks.values()}
        self.piece_ids = Recent(self._piece, memory // 2)
        self.run_ids = Recent(self._run, memory)

    def split(self, text: str) -> list[str]:
        return self.pieces.findall(text)

    def _piece(self, piece: str) -> bytes:
        return b" ".join(map(self.numbers.__getitem__, self.bpe.encode(piece.encode("utf-8"))))

    def _run(self, run: str) -> bytes:
        pieces = self.split(" " + run)
        if len(pieces) == 1:  # kept as a run, so not once more as a piece
            return self._piece(pieces[0])
        return b" ".join(map(self.piece_ids.__getitem__, pieces))

    def _shown(self, text: str) -> bytes:
        return b" ".join(map(self.piece_ids.__getitem__, self.split(text)))

    def shown(self, text: str) -> bytes:
        """All ids of the text."""
        if not text:
            return b""
        if self.wide_gap.search(text):  # a space after a space: only the pattern knows where that is cut
            return self._shown(text)
        first, *rest = text.split(" ")
        runs = list(map(self.run_ids.__getitem__, rest))
        return b" ".join([self._shown(first), *runs] if first else runs)

    def decoded(self, shown: bytes) -> bytes:
        return decoded(shown, self.bytes_of)

    @functools.cached_property
    def bytes_of(self) -> dict[bytes, bytes]:
        return shown_tokens(self.bpe.ranks)


def shown_tokens(ranks: dict[bytes, int]) -> dict[bytes, bytes]:
    """Bytes of each token by its decimal number."""
    return {b"%d" % i: t for t, i in ranks.items()}


def decoded(shown: bytes, bytes_of: dict[bytes, bytes]) -> bytes:
    return b"".join(map(bytes_of.__getitem__, shown.split(b" "))) if shown else b""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.cache
def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One per worker process."""
    return TextEncoder(read_ranks(path), pattern)


@functools.cache
def token_bytes(path: str) -> dict[bytes, bytes]:
    """One per worker process; decoding runs in workers of its own, which hold no encoder."""
    return shown_tokens(read_ranks(path))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``AT_ONCE`` rows."""
    return (batch.slice(at, AT_ONCE) for batch in batches for at in range(0, batch.num_rows, AT_ONCE))


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document ``doc_id, n_tokens`` and the ``ids`` as decimal numbers joined by spaces."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        for batch in parts(batches):
            ids = [encoder.shown(t) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc": batch.column("doc"), "n_tokens": pa.array([x.count(b" ") + 1 if x else 0 for x in ids], pa.int64()),
                "ids": pa.array(ids, pa.binary()).cast(pa.string())})

    rows = docs.select(F.col(key).cast("bigint").alias("doc"), whole_text(text).alias("body"))
    return rows.mapInArrow(encode, "doc long, n_tokens long, ids string").withColumnRenamed("doc", key)


def decode_documents(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded documents; ``decoded_sha256`` is over the decoded bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = token_bytes(path)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in parts(batches):
            ids = batch.column("ids").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc": batch.column("doc"), "n_tokens": batch.column("n_tokens"), "ids_sha256": pa.array(map(digest, ids), pa.string()),
                "decoded_sha256": pa.array([digest(decoded(x, bytes_of)) for x in ids], pa.string())})

    rows = encoded.withColumnRenamed(key, "doc")
    return rows.mapInArrow(decode, "doc long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("doc", key)
