"""Language model scores by a subword lattice.

The probability of a word is the sum over all its segmentations, by a forward recursion over its bytes in log space. One
segmentation is the word itself, if training has it, with its absolutely discounted unigram score; the others cut it into
pieces of an existing vocabulary, the last of them word-final. The piece scores start from the vocabulary's own cuts of
the training words and are refined by expected counts over all segmentations; as they speak for new words, every distinct
training word counts once. A document is its words and one end, so its score is its log10 marginal probability, and the
probabilities of all texts sum to one. Beside it stands the base score, a word unigram with add-half smoothing.

Word counts cover all training documents: every task counts its words, the counts meet in buckets by word (one entry per
word and task, so a word that all documents hold stays light) and are written. Piece counts follow from the counts of
distinct words. Documents are then dealt into blocks; a block asks the buckets once for each of its distinct words, and
a bucket runs the lattice once for each word of the corpus. Only the piece scores, as many as the vocabulary has pieces,
reach every task.

Defined results: a null text counts as empty, so it is one end token; a document with a null id has the crc32 of an empty
text and belongs to the training documents; without any training document all counts are 0 and scores follow from the
smoothing and the vocabulary alone; a word of any length is scored whole; every row gets a row; only the named columns are read.
"""

from __future__ import annotations

import functools
import json
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.llm.text import whole_text
from sceneframe.llm.word_bpe import byte_characters, word_bpe
from sceneframe.session import written

HOLD_OUT = 5  # documents whose crc32 modulo this is 1 are held out
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
FLUSH_WORDS = 400_000
END = b" "  # no word is a space
WORD_END = "</w>"
DISCOUNT = 0.75  # of every known word's count, for the lattice
REFINEMENTS = 1  # passes of expected counts; further ones gain under 0.05 per word
LOG10 = math.log(10)
EXPONENTS = 600  # natural exponents that scaled probabilities may reach in doubles, either way
TOGETHER, FEW = 4096, 8  # words of one length that go through the lattice together, at most and at least


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(HOLD_OUT)) == 1


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, then the end."""
    return [*text.lower().split(), END]


@functools.cache
def vocabulary(path: str) -> tuple[list[tuple[bytes, bool]], dict[str, int]]:
    """The pieces as (bytes, ends a word) by number, and the number of each written piece."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    byte = {c: b for b, c in enumerate(byte_characters())}
    added = {x["content"] for x in content["added_tokens"]}
    pieces, numbers = [], {}
    for written_piece in content["model"]["vocab"]:
        if written_piece not in added:
            body = written_piece.removesuffix(WORD_END)
            numbers[written_piece] = len(pieces)
            pieces.append((bytes(byte[c] for c in body), body != written_piece))
    return pieces, numbers


class Trie:
    """The prefixes of all pieces as numbered nodes, the empty one being 0, and the pieces that end at each (-1: none)."""

    def __init__(self, pieces: list[tuple[bytes, bool]]):
        nodes, edges = {b"": 0}, []
        for body, _ in pieces:
            for end in range(1, len(body) + 1):
                if body[:end] not in nodes:
                    nodes[body[:end]] = len(nodes)
                    edges.append(nodes[body[:end - 1]] << 8 | body[end - 1])
        edges = np.array(edges, np.int64)
        order = np.argsort(edges)
        self.edges, self.targets = edges[order], order + 1
        self.inner, self.final = (np.full(len(nodes), -1, np.int64) for _ in range(2))
        for number, (body, ends) in enumerate(pieces):
            (self.final if ends else self.inner)[nodes[body]] = number

    def follow(self, node: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes go on with these bytes, and where to."""
        edge = node << 8 | byte
        at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
        going = np.flatnonzero(self.edges[at] == edge)
        return going, self.targets[at[going]]


@functools.cache
def _trie(path: str) -> Trie:
    return Trie(vocabulary(path)[0])


class Lattice:
    """Marginal log probability of a word over its cuts into pieces, by natural logarithm.

    Words of one length go through the recursion together, as scaled probabilities in doubles. Words too long for these, and
    the few of a rare length, go one by one in log space.
    """

    def __init__(self, pieces: list[tuple[bytes, bool]], scores: np.ndarray, trie: Trie | None = None):
        self.pieces, self.scores, self.trie = pieces, scores, trie or Trie(pieces)
        self.shift = -scores.min() / 2  # per byte; keeps scaled scores in half the range
        self.most_bytes = int(EXPONENTS / max(self.shift, 1))

    @functools.cached_property
    def _tables(self) -> tuple[dict, dict, int]:
        inner, final = {}, {}
        for number, ((body, ends), score) in enumerate(zip(self.pieces, self.scores.tolist())):
            (final if ends else inner)[body] = (score, number)
        return inner, final, max(len(body) for body, _ in self.pieces)

    def _forward(self, word: bytes) -> tuple[list[float], list[list]]:
        """Log probability of every prefix, and the arcs (from, score, piece) that end at each place."""
        alpha, arcs, n = [0.0], [[]], len(word)
        inner, final, longest = self._tables
        for end in range(1, n + 1):
            get = (inner if end < n else final).get
            here = [(i, *hit) for i in range(max(0, end - longest), end) if (hit := get(word[i:end]))]
            terms = [alpha[i] + score for i, score, _ in here]
            most = max(terms, default=-math.inf)
            alpha.append(most if len(terms) < 2 else most + math.log(sum([math.exp(t - most) for t in terms])))
            arcs.append(here)
        return alpha, arcs

    def __call__(self, word: bytes) -> float:
        return self._forward(word)[0][-1]

    def expect(self, word: bytes, used: np.ndarray) -> None:
        """Add the expected uses of every piece in ``word``."""
        alpha, arcs = self._forward(word)
        weight = [0.0] * len(word) + [1.0]  # posterior of each place
        for end in range(len(word), 0, -1):
            if weight[end]:
                for i, score, number in arcs[end]:
                    share = weight[end] * math.exp(alpha[i] + score - alpha[end])
                    used[number] += share
                    weight[i] += share

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, list[list[tuple]]]:
        """As ``_forward``, for words of one length: scaled probabilities, place by word, and arcs (from, words, pieces, scaled share)."""
        n = len(words[0])
        text = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n).T.astype(np.int64)
        alpha, arcs = np.zeros((n + 1, len(words))), [[] for _ in range(n + 1)]
        alpha[0] = 1
        for i in range(n):
            which = np.flatnonzero(alpha[i])
            node = np.zeros(len(which), np.int64)
            for end in range(i + 1, n + 1):
                going, node = self.trie.follow(node, text[end - 1, which])
                which = which[going]
                if not len(which):
                    break
                number = (self.trie.inner if end < n else self.trie.final)[node]
                is_piece = np.flatnonzero(number >= 0)
                here, number = which[is_piece], number[is_piece]
                share = alpha[i, here] * np.exp(self.scores[number] + self.shift * (end - i))
                alpha[end, here] += share
                arcs[end].append((i, here, number, share))
        return alpha, arcs

    def _groups(self, words: list[bytes]) -> Iterator[tuple[bool, np.ndarray, list[bytes]]]:
        """Places and words of each length, and whether these go together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        for places in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            for at in range(0, len(places), TOGETHER):
                part = places[at:at + TOGETHER]
                if len(part):
                    yield len(part) >= FEW and size[part[0]] <= self.most_bytes, part, [words[k] for k in part]

    def many(self, words: list[bytes]) -> np.ndarray:
        """The score of each word."""
        out = np.zeros(len(words))
        for together, places, ws in self._groups(words):
            out[places] = np.log(self._together(ws)[0][-1]) - self.shift * len(ws[0]) if together else [self(w) for w in ws]
        return out

    def expect_many(self, words: list[bytes], used: np.ndarray) -> None:
        """Add the expected uses of every piece in all ``words``."""
        for together, _, ws in self._groups(words):
            if not together:
                for w in ws:
                    self.expect(w, used)
                continue
            alpha, arcs = self._together(ws)
            weight, numbers, shares = np.zeros_like(alpha), [], []
            weight[-1] = 1
            for end in range(len(ws[0]), 0, -1):
                for i, here, number, share in arcs[end]:
                    share = weight[end, here] * share / alpha[end, here]
                    weight[i, here] += share
                    numbers.append(number)
                    shares.append(share)
            used += np.bincount(np.concatenate(numbers), np.concatenate(shares), len(used)) if numbers else 0


def _bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


def _by_bucket(words, buckets: int) -> dict[int, list[bytes]]:
    """Words of each bucket, sorted."""
    dealt = defaultdict(list)
    for w in words:
        dealt[_bucket(w, buckets)].append(w)
    return {b: sorted(ws) for b, ws in dealt.items()}


def _packed(words: list[bytes]) -> bytes:
    """Words hold no line feed."""
    return b"\n".join(words)


def word_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """Training counts, one row per bucket: ``bucket``, packed ``words`` and ``counts``; ``rows`` has body and held_out."""

    def rows_of(counted: Counter) -> pa.RecordBatch:
        dealt = _by_bucket(counted, buckets)
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array(list(dealt), pa.int64()), "words": pa.array([_packed(ws) for ws in dealt.values()], pa.binary()),
            "counts": pa.array([np.array([counted[w] for w in ws], "<u8").tobytes() for ws in dealt.values()], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Counter()
        for batch in batches:
            for body in batch.column("body").to_pylist():
                counted.update(tokens(body))
                if len(counted) > FLUSH_WORDS:
                    yield rows_of(counted)
                    counted = Counter()
        if counted:
            yield rows_of(counted)

    def total(table: pa.Table) -> pa.Table:
        counted = Counter()
        for words, counts in zip(table.column("words").to_pylist(), table.column("counts").to_pylist()):
            for w, n in zip(words.split(b"\n"), np.frombuffer(counts, "<u8").tolist()):
                counted[w] += n
        ws = sorted(counted)
        return pa.table({"bucket": table.column("bucket")[:1], "words": pa.array([_packed(ws)], pa.binary()),
                         "counts": pa.array([np.array([counted[w] for w in ws], "<u8").tobytes()], pa.binary()),
                         "n_words": pa.array([len(ws)], pa.int64()), "n_tokens": pa.array([sum(counted.values())], pa.int64())})

    schema = "bucket long, words binary, counts binary"
    parts = rows.filter(~F.col("held_out")).select("body").mapInArrow(count, schema)
    return written(parts.groupBy("bucket").applyInArrow(total, schema + ", n_words long, n_tokens long"), "word-counts")


def _scores(used: np.ndarray) -> np.ndarray:
    return np.log((used + 0.01) / (used.sum() + 0.01 * len(used)))


def piece_scores(counts: DataFrame, path: str, refinements: int = REFINEMENTS) -> np.ndarray:
    """Natural log scores of the pieces from all distinct training words."""
    size = len(vocabulary(path)[0])

    def use(scores: bytes | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, numbers = vocabulary(path)
            encoder, used = word_bpe(path), np.zeros(size)
            lattice = Lattice(pieces, np.frombuffer(scores), _trie(path)) if scores else None
            for batch in batches:
                for words in batch.column("words").to_pylist():
                    distinct = [w for w in words.split(b"\n") if w != END]
                    if lattice:
                        lattice.expect_many(distinct, used)
                        continue
                    for w in distinct:
                        for t in encoder.model.tokenize("".join(map(encoder.shown.__getitem__, w))):
                            used[numbers[t.value]] += 1
            piece = np.flatnonzero(used)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int64()), "n": pa.array(used[piece], pa.float64())})

        return count

    scores = None
    for _ in range(refinements + 1):
        # at most one row per piece of the vocabulary
        found = counts.select("words").mapInArrow(use(scores), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        used = np.zeros(size)
        for r in found:
            used[r.piece] = r.n
        scores = _scores(used).tobytes()
    return np.frombuffer(scores)


def score_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(whole_text(text))).alias("b")).first()["b"] or 0
    homes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BLOCK_BYTES))
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), held_out(F.col(key)).alias("held_out"),
                       whole_text(text).cast("binary").alias("body"))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("doc", "body"), F.lit(homes)))
    counts = word_counts(rows, buckets)
    whole = counts.agg(F.sum("n_tokens").alias("n"), F.sum("n_words").alias("v")).first()
    n, v = whole["n"] or 0, whole["v"] or 0
    scores = piece_scores(counts, path).tobytes()

    def ask(table: pa.Table) -> pa.Table:
        seen = set()
        for body in table.column("body").to_pylist():
            seen.update(tokens(body))
        dealt = _by_bucket(seen, buckets)
        return pa.table({"bucket": pa.array(list(dealt), pa.int64()), "home": pa.array([table.column("home")[0].as_py()] * len(dealt), pa.int64()),
                         "words": pa.array([_packed(ws) for ws in dealt.values()], pa.binary())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        pieces, _ = vocabulary(path)
        count = {}
        for words, times in zip(known.column("words").to_pylist(), known.column("counts").to_pylist()):
            count.update(zip(words.split(b"\n"), np.frombuffer(times, "<u8").tolist()))
        lattice = Lattice(pieces, np.frombuffer(scores), _trie(path))
        lists = [words.split(b"\n") for words in asked.column("words").to_pylist()]
        distinct = sorted(set().union(*lists) - {END})  # every word of the corpus once
        cut = dict(zip(distinct, lattice.many(distinct).tolist())) | {END: 0.0}
        return pa.table({
            "home": asked.column("home"), "bucket": asked.column("bucket"),
            "counts": pa.array([np.array([count.get(w, 0) for w in ws], "<u8").tobytes() for ws in lists], pa.binary()),
            "cuts": pa.array([np.array([cut[w] for w in ws]).tobytes() for ws in lists], pa.binary())})

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        texts = [tokens(body) for body in table.column("body").to_pylist()]
        dealt = _by_bucket(set().union(*texts), buckets)
        came = dict(zip(replies.column("bucket").to_pylist(), zip(replies.column("counts").to_pylist(), replies.column("cuts").to_pylist())))
        number, count, cut = {}, [], []
        for b, ws in dealt.items():
            number.update(zip(ws, range(len(number), len(number) + len(ws))))
            count.append(np.frombuffer(came[b][0], "<u8"))
            cut.append(np.frombuffer(came[b][1]))
        count, cut = np.concatenate(count), np.concatenate(cut)
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        own = np.maximum(count - DISCOUNT, 0)  # a known word as a piece of its own
        share = np.array([1.0 if w == END else DISCOUNT * v + 1 for w in number])
        with np.errstate(divide="ignore"):
            model = (np.logaddexp(np.log(own), np.log(share) + cut) - math.log(n + 2)) / LOG10
        at = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in texts]
        return pa.table({
            "doc": table.column("doc"), "held_out": table.column("held_out"), "n_tokens": pa.array([len(k) for k in at], pa.int64()),
            "n_known": pa.array([int((count[k] > 0).sum()) for k in at], pa.int64()), "train_tokens": pa.array([n] * len(at), pa.int64()),
            "base_score": pa.array([float(base[k].sum()) for k in at]), "score": pa.array([float(model[k].sum()) for k in at])})

    asked = rows.groupBy("home").applyInArrow(ask, "bucket long, home long, words binary")
    replies = asked.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(answer, "home long, bucket long, counts binary, cuts binary")
    replies = replies.filter("home is not null")
    done = rows.groupBy("home").cogroup(replies.groupBy("home")).applyInArrow(
        score, "doc long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.withColumnRenamed("doc", key)
