"""Pack documents into token windows, each filled with lexical neighbours of its seed.

Whole windows of a long document are cut off first. The rest of each document is indexed: BM25 over all its distinct
token ids, with the number, mean length and document frequencies of the rests of the whole table. Documents are dealt into
shards by content: the ``NEAREST`` most similar of ``PIVOTS`` documents, in order, are the cell of a rest; cells lie side by
side in one order, which is cut into shards of about ``SHARD_ROWS`` documents, so that the index of one shard fits one task. A
cell larger than a shard is spread over several by a hash. Pivots are the documents with the least hashes of their rests, a
fixed number at every size; all else covers the whole table. A seed is compared with the rests of its own shard. Until all is used, the longest unused rest seeds a window, its
neighbours are scored through the inverted index, and the window takes them in descending score while they fit; the last
one is cut to fill it exactly and its remainder stays in the index. What a shard has left at its end is cut into powers of
two, which need no padding.

Defined results: a null text counts as empty and has the end id alone; every row is packed by itself, repeated ones
included, and its id is only carried along, so equal rows may lie in several shards; scores that tie are taken in the order of the shard's rows; an empty table
gives no piece.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sceneframe.llm.text import whole_text
from sceneframe.session import written
from sceneframe.llm.word_bpe import word_bpe

END_ID = 2
WINDOW = 4096
SHARD_ROWS = 2000
PIVOTS, NEAREST = 64, 3
BLOCK = 64  # rests whose cells are found together
DRAW_BITS = 31
COMMON = 50
K1, B = 1.2, 0.75  # usual BM25 constants
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Corpus(NamedTuple):
    """What BM25 needs to know of all texts."""

    n: int
    mean: float  # length
    df: np.ndarray  # of each term


def rest_of(ids: np.ndarray, window: int) -> np.ndarray:
    """What is left behind the whole windows."""
    return ids[len(ids) // window * window:]


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and where each begins among the sorted ids; a stable sort of two-byte ids is a radix sort."""
    ids = np.sort(ids, kind="stable")
    new = np.ones(len(ids), bool)
    np.not_equal(ids[1:], ids[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return ids[first], first


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms and how often each occurs."""
    terms, first = terms_of(ids)
    times = np.full(len(terms), len(ids))
    times[:-1] = first[1:]
    times -= first
    return terms, times


class Bm25:
    """Index over the distinct terms of some token arrays, weighted by ``corpus`` or else by these alone.

    Terms that more than a ``COMMON``-th of the texts hold are rows of weights of all texts, the others are lists.
    """

    def __init__(self, texts: list[np.ndarray], corpus: Corpus | None = None):
        sets = [counted(t) for t in texts]
        sizes = np.array([len(s[0]) for s in sets], np.int64)
        terms = np.concatenate([s[0] for s in sets]) if sets else np.zeros(0, np.int64)
        tf = np.concatenate([s[1] for s in sets]).astype(np.float32) if sets else np.zeros(0, np.float32)
        holder = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        length = np.array([len(t) for t in texts], np.float32)
        held = np.bincount(terms)
        self.terms = np.flatnonzero(held)
        index = (np.cumsum(held > 0) - 1)[terms]
        held = held[self.terms]
        n, mean, df = (corpus.n, corpus.mean, corpus.df[self.terms]) if corpus else (len(sets), length.mean() if sets else 0, held)
        norm = K1 * (1 - B + B * length / max(mean, 1))
        idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        weight = idf[index] * tf * (K1 + 1) / (tf + norm[holder])
        common = held * COMMON > len(sets)
        self.row = np.where(common, np.cumsum(common) - 1, -1)  # of each term, -1 if it has a list
        in_row = common[index]
        self.rows = np.zeros((int(common.sum()), len(sets)), np.float32)
        self.rows[self.row[index[in_row]], holder[in_row]] = weight[in_row]
        listed = np.flatnonzero(~in_row)
        order = listed[np.argsort(index[listed], kind="stable")]
        self.holder, self.weight = holder[order], weight[order]
        self.first = np.append(0, np.cumsum(np.where(common, 0, held)))
        self.queries = np.split(index, np.cumsum(sizes)[:-1]) if sets else []  # the query of each text: all its terms
        self.n = len(sets)

    def neighbours(self, seed: int, free: np.ndarray) -> np.ndarray:
        """Free texts that share a query term with ``seed``, best first."""
        row = self.row[self.queries[seed]]
        score = self.rows[row[row >= 0]].sum(0, dtype=np.float32).astype(np.float64)
        spans = [slice(self.first[t], self.first[t + 1]) for t in self.queries[seed][row < 0]]
        if spans:
            score += np.bincount(np.concatenate([self.holder[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        found = np.flatnonzero((score > 0) & free)
        return found[np.argsort(-score[found], kind="stable")]


class Rests:
    """What is left of each text, and the window that is being filled from it."""

    def __init__(self, starts: list[int], lengths: list[int], window: int):
        self.at, self.size, self.window = list(starts), np.array(lengths, np.int64), window
        self.held, self.fill = [], 0

    def take(self, k: int) -> None:
        """Put as much of rest ``k`` into the window as it has room for."""
        n = min(int(self.size[k]), self.window - self.fill)
        if n:
            self.held.append((k, self.at[k], n))
            self.at[k] += n
            self.size[k] -= n
            self.fill += n


def pack_shard(ids: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(text, start, length, sequence, offset)`` that cover every id of the shard once."""
    pieces, sequence, starts = [], 0, []
    for d, x in enumerate(ids):
        whole = len(x) // window * window
        pieces += [(d, at, window, sequence + at // window, 0) for at in range(0, whole, window)]
        sequence += whole // window
        starts.append(whole)
    rests = Rests(starts, [len(x) - start for x, start in zip(ids, starts)], window)
    index = Bm25([rest_of(x, window) for x in ids], corpus)
    order = sorted(range(len(ids)), key=lambda k: (-rests.size[k], k))
    for turn, seed in enumerate(order):  # all before ``turn`` is used up
        if not rests.size[seed]:
            continue
        rests.held, rests.fill = [], 0
        rests.take(seed)
        near = index.neighbours(seed, rests.size > 0) if rests.fill < window else []
        later = np.asarray(near, np.int64)
        while len(later := later[rests.size[later] <= window - rests.fill]):  # whole neighbours first, each that fits what is left
            n = int(np.searchsorted(np.cumsum(rests.size[later]), window - rests.fill, side="right"))
            for k in later[:n]:
                rests.take(k)
            later = later[n:]
        for k in near:  # then the best of the others is cut
            if rests.fill == window:
                break
            rests.take(k)
        for k in order[turn:] if rests.fill < window else []:  # no neighbour left
            rests.take(k)
            if rests.fill == window:
                break
        sequence = _lay(pieces, rests.held, rests.fill, window, sequence)
    return pieces


def _lay(pieces: list, held: list[tuple[int, int, int]], fill: int, window: int, sequence: int) -> int:
    """Append the held parts, end to end; a window that is not full becomes sequences of powers of two."""
    cuts = [window] if fill == window else [1 << b for b in reversed(range(window.bit_length())) if fill >> b & 1]
    room = iter(cuts)
    free, offset = next(room), 0
    for d, at, n in held:
        while n:
            part = min(n, free - offset)
            pieces.append((d, at, part, sequence, offset))
            at, n, offset = at + part, n - part, offset + part
            if offset == free:
                free, offset, sequence = next(room, 0), 0, sequence + 1
    return sequence


def id_type(tokenizer: str) -> str:
    """The smaller of two integer types that holds every id of the vocabulary."""
    return "<u2" if word_bpe(tokenizer).vocabulary <= 1 << 16 else "<u4"


def encoded(rows: DataFrame, tokenizer: str, end_id: int = END_ID, kind: str = "<u4") -> DataFrame:
    """``key, tie, ids`` of the rows ``key, tie, body``: the packed ids of each text and its end, as integers of a ``kind``."""

    def encode(batches):
        encoder = word_bpe(tokenizer)
        for b in batches:
            for ids in encoder.encode_all(b.column("body"), end_id, kind):
                part, b = b.slice(0, len(ids)), b.slice(len(ids))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("tie"), ids.cast(pa.binary())], ["key", "tie", "ids"])

    return rows.select("key", "tie", "body").mapInArrow(encode, "key long, tie long, ids binary")


def corpus_of(tokens: DataFrame, window: int, kind: str = "<u4") -> Corpus:
    """Figures of all rests: one row for each token id of the vocabulary at most comes to the driver."""

    def count(batches):
        df, n, length = np.zeros(0, np.int64), 0, 0
        for b in batches:
            for x in b.column("ids").to_numpy(zero_copy_only=False):
                rest = rest_of(np.frombuffer(x, kind), window)
                terms, _ = terms_of(rest)
                if len(terms) and terms[-1] >= len(df):
                    df = np.append(df, np.zeros(terms[-1] + 1 - len(df), np.int64))
                df[terms] += 1
                n, length = n + 1, length + len(rest)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(term, [-1, -2])), pa.array(np.append(df[term], [n, length]))], ["term", "n"])

    counts = tokens.select("ids").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in counts.collect()}
    n, length = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(max(found, default=-1) + 1, np.int64)
    df[list(found)] = list(found.values())
    return Corpus(n, length / max(n, 1), df)


class Cells:
    """Where rests lie among some pivots: the ranks of the nearest ones are the digits of a cell."""

    def __init__(self, pivots: list[np.ndarray], corpus: Corpus):
        self.idf = np.log1p((corpus.n - corpus.df + 0.5) / (corpus.df + 0.5)).astype(np.float32)
        columns = np.zeros((len(self.idf), max(1, len(pivots))), np.float32)
        for j, pivot in enumerate(pivots):
            terms = np.unique(pivot)
            columns[terms, j] = self.idf[terms] / max(np.linalg.norm(self.idf[terms]), 1e-9)
        likeness = columns.T @ columns
        direction = np.linalg.svd(likeness - likeness.mean(0))[0][:, 0]  # similar pivots get neighbouring ranks
        self.columns = np.ascontiguousarray(columns[:, np.argsort(direction, kind="stable")])

        self.held = np.flatnonzero(self.columns.any(1))  # terms of pivots; the others weigh nothing
        self.place = np.full(len(self.idf), len(self.held))
        self.place[self.held] = np.arange(len(self.held))
        self.weight = np.append(self.idf[self.held, None] * self.columns[self.held], np.zeros((1, self.columns.shape[1]), np.float32), axis=0)

    def of(self, rest: np.ndarray) -> int:
        return int(self.of_all([rest])[0])

    def of_all(self, rests: list[np.ndarray]) -> np.ndarray:
        """The cell of each rest; blocks of them become rows of zeros and ones that are multiplied with the pivots."""
        cells = np.zeros(len(rests), np.int64)
        rows = np.zeros((BLOCK, len(self.weight)), np.float32)
        for at in range(0, len(rests), BLOCK):
            block = rests[at:at + BLOCK]
            rows[:] = 0
            rows[np.repeat(np.arange(len(block)), [len(x) for x in block]), self.place[np.concatenate(block)]] = 1
            near = np.argsort(-(rows[:len(block)] @ self.weight), axis=1, kind="stable")[:, :NEAREST]
            for ranks in near.T:
                cells[at:at + BLOCK] = cells[at:at + BLOCK] * PIVOTS + ranks
        return cells


def cells_of(tokens: DataFrame, window: int, kind: str, corpus: Corpus) -> Cells:
    """The cells around the ``PIVOTS`` different rests with the least hashes; only these come to the driver."""
    size = np.dtype(kind).itemsize * window
    rest = F.expr(f"substring(ids, cast(octet_length(ids) div {size} * {size} + 1 as int), {size})")
    rests = tokens.select(rest.alias("rest")).where(F.octet_length("rest") > 0).withColumn("draw", F.xxhash64("rest"))
    least = [r.draw for r in rests.select("draw").distinct().orderBy("draw").limit(PIVOTS).collect()]
    found = rests.where(F.col("draw").isin(least)).groupBy("draw").agg(F.min("rest").alias("rest")).orderBy("draw").collect()
    return Cells([np.frombuffer(r.rest, kind) for r in found], corpus)


def dealt(tokens: DataFrame, window: int, kind: str, corpus: Corpus, shard_rows: int) -> DataFrame:
    """``key, tie, ids, shard`` of all rows: neighbours among the cells share a shard.

    One row for each cell, ``PIVOTS ** NEAREST`` at most, comes to the driver.
    """
    cells = cells_of(tokens, window, kind, corpus)

    def number(ids: pa.Array) -> np.ndarray:
        return cells.of_all([rest_of(np.frombuffer(x, kind), window) for x in ids.to_numpy(zero_copy_only=False)])

    def count(batches):
        for b in batches:
            cell, n = np.unique(number(b.column("ids")), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    counts = tokens.select("ids").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = counts.sort_by("cell")
    known, size = (counts.column(c).to_numpy() for c in ("cell", "n"))
    before = np.cumsum(size) - size
    shards = max(1, math.ceil(corpus.n / shard_rows))

    def deal(batches):
        for b in batches:
            at = np.minimum(np.searchsorted(known, number(b.column("ids"))), len(known) - 1)
            place = before[at] + (b.column("draw").to_numpy() * size[at] >> DRAW_BITS)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("tie"), b.column("ids"), pa.array(place * shards // corpus.n)],
                                             ["key", "tie", "ids", "shard"])

    draw = F.xxhash64("key", "tie", "row").bitwiseAND(F.lit((1 << DRAW_BITS) - 1))
    return tokens.select("key", "tie", "ids", draw.alias("draw")).mapInArrow(deal, "key long, tie long, ids binary, shard long")


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", window: int = WINDOW,
                   shard_rows: int = SHARD_ROWS, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: token ids are written once, counted over all documents
    and shuffled once, by shard."""
    body = whole_text(text).cast("binary")
    rows = docs.select(F.col(key).cast("bigint").alias("key"), body.alias("body")).withColumn("tie", F.xxhash64("body"))
    kind = id_type(tokenizer)
    tokens = written(encoded(rows, tokenizer, end_id, kind).withColumn("row", F.monotonically_increasing_id()), "token-ids")
    corpus = corpus_of(tokens, window, kind)

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("tie", "ascending")])
        keys, number = table.column("key").to_pylist(), table.column("shard")[0].as_py()
        ids = [np.frombuffer(x, kind) for x in table.column("ids").to_pylist()]
        pieces = pack_shard(ids, window, corpus)
        crc = [zlib.crc32(ids[d][at:at + n].astype("<u4").tobytes()) for d, at, n, _, _ in pieces]
        column = lambda values: pa.array(values, pa.int64())
        return pa.table({
            "doc_id": column([keys[p[0]] for p in pieces]), "start": column([p[1] for p in pieces]),
            "length": column([p[2] for p in pieces]), "ids_crc32": column(crc),
            "doc_tokens": column([len(ids[p[0]]) for p in pieces]),
            "sequence_id": column([(number << 32) + p[3] for p in pieces]), "offset": column([p[4] for p in pieces])})

    return dealt(tokens, window, kind, corpus, shard_rows).groupBy("shard").applyInArrow(shard, PIECES)
