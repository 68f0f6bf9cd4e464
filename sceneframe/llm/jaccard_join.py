"""Exact Jaccard self-join on five-word shingles, as classes of linked documents.

Two documents link when ``100 * intersection >= 75 * union`` of their shingle sets. The join returns the connected classes
and not all pairs; it does so without losing a link:

1. Blocks. Documents are dealt into blocks by a hash. Each block sends every shingle hash of the lower hash range once, so
   a shingle of all documents costs one entry per block; the buckets answer which of them other blocks hold too. A document
   that links must share at least ``s - g`` of its ``s`` sampled shingles, ``g`` being what a partner may lack. All others
   are done. Equal sets become one set.
2. Index lists. Among the sets left, shingles are ranked by the number of sets that hold them, again through blocks. A
   set's prefix of ``n - ceil(3n/4) + 1`` rarest shingles meets that of every partner. Lists keep set size, position and a
   bitmap of the whole set. A list is two blocks by position: up to ``n/7`` and beyond. The smaller set of a pair can only
   be met in the first, so the second is skipped for it; what differs in two bitmaps differs in the sets, so pairs with too
   many different bits are skipped too.
3. Answers from similar sets. The sets of a list are first held against its leaders, the one with the fewest rarer shingles
   and one drawn by a hash; a set that links to one takes over the leader's class and is never probed against that class
   again. Rounds repeat while they find links. The last round probes
   the lists for pairs of different classes only, so its candidates hold every link that can still join two classes.

Candidates are verified on the whole sets. Shingles are 64-bit hashes, equal sets 128-bit digests.

Defined results: null and wordless texts have no shingles and link with nothing; fewer than five words are one shingle;
a null ``doc_id`` is never a class id unless a class has no other; rows that repeat ``doc_id`` and text give a row each.
Columns other than the named ones are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.llm.components import merged_labels
from sceneframe.llm.recent import Recent
from sceneframe.llm.text import whole_text
from sceneframe.session import passing_tables, written

SHINGLE = 5
SAMPLED = 0.4  # part of the hash range that the first filter looks at
BLOCK_BYTES = 8 << 20
BUCKET_ENTRIES = 1 << 20
BITMAP_WORDS = 16  # 64-bit words of a set's bitmap
SAMPLE_LIMIT = np.uint64(int(SAMPLED * 2**64))


@functools.cache
def _word_hashes() -> Recent:
    return Recent(xxhash.xxh3_64_intdigest)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; ``bytes.lower`` and ``bytes.split`` act on A-Z and on ASCII white space only."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    count = len(words) - width + 1
    rolled = hashes[:count].copy()
    for k in range(1, width):
        rolled = _mixed(rolled) + hashes[k:k + count]
    return np.unique(_mixed(rolled))


def may_lack(n: np.ndarray | int):
    """Shingles of a set of size ``n`` that a linked set may lack: ``n - ceil(3n/4)``."""
    return n // 4


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= 75 * (len(x) + len(y) - common)


def _arrays(column: pa.ChunkedArray, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(b, kind) for b in column.to_pylist()]


def _joined(parts: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _sent(home: int, tokens: np.ndarray, buckets: int) -> pa.Table:
    """Tokens of a block with their counts, one row per bucket."""
    tokens, counts = np.unique(tokens, return_counts=True)
    bucket = (_mixed(tokens) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [(b, order[ends[b]:ends[b + 1]]) for b in range(buckets) if ends[b] < ends[b + 1]]
    return pa.table({
        "bucket": pa.array([b for b, _ in rows], pa.int64()), "home": pa.array([home] * len(rows), pa.int64()),
        "tokens": pa.array([tokens[i].tobytes() for _, i in rows], pa.binary()),
        "counts": pa.array([counts[i].astype("<u4").tobytes() for _, i in rows], pa.binary())})


def _meet(table: pa.Table, kind: str) -> pa.Table:
    """Tokens of a bucket that occur twice or more in all blocks together, sent back to the blocks with their counts."""
    tokens, counts = _arrays(table.column("tokens"), kind), _arrays(table.column("counts"), "<u4")
    _, where = np.unique(_joined(tokens, kind), return_inverse=True)
    total = np.bincount(where, _joined(counts, "<u4")).astype("<u4")[where]
    out_tokens, out_counts, at = [], [], 0
    for t in tokens:
        n = total[at:at + len(t)]
        out_tokens.append(t[n > 1].tobytes())
        out_counts.append(n[n > 1].tobytes())
        at += len(t)
    return pa.table({"home": table.column("home"), "tokens": pa.array(out_tokens, pa.binary()), "counts": pa.array(out_counts, pa.binary())})


SENT = "bucket long, home long, tokens binary, counts binary"
MET = "home long, tokens binary, counts binary"


def _lookup(answers: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens and counts that came back to a block."""
    tokens = _joined(_arrays(answers.column("tokens"), kind), kind)
    counts = _joined(_arrays(answers.column("counts"), "<u4"), "<u4")
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _found(tokens: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The count of each token, 1 where it didn't come back."""
    if not len(known):
        return np.ones(len(tokens), np.uint32)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, counts[at], 1).astype(np.uint32)


def _short(tokens: np.ndarray) -> np.ndarray:
    """32 of the 64 bits: a chance equality only keeps a document in."""
    return (_mixed(tokens) >> np.uint64(32)).astype("<u4").astype(np.uint64)


def _distinct_sets(bodies: list[bytes]) -> list[np.ndarray]:
    return list({s.tobytes(): s for s in map(shingles, bodies)}.values())


def profiles(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: ``doc, tie, n`` (set size), the digest ``d1, d2`` and, where a link is possible, the ``shingles``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), whole_text(text).cast("binary").alias("body"))
    rows = rows.withColumn("tie", F.xxhash64(F.col("body").cast("string")))
    size = docs.agg(F.sum(F.octet_length(whole_text(text))).alias("b")).first()["b"] or 0
    homes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BLOCK_BYTES))
    buckets = max(1, math.ceil(SAMPLED * size / 6 / BUCKET_ENTRIES))  # a shingle for about six bytes of text
    rows = rows.withColumn("home", F.pmod(F.xxhash64("doc", "tie"), F.lit(homes)))

    def send(table: pa.Table) -> pa.Table:
        sets = _distinct_sets(table.column("body").to_pylist())
        tokens = _joined([_short(s[s < SAMPLE_LIMIT]) for s in sets], "<u8")
        return _sent(table.column("home")[0].as_py(), tokens, buckets)

    def decide(table: pa.Table, answers: pa.Table) -> pa.Table:
        known, counts = _lookup(answers, "<u8")
        n, d1, d2, kept = [], [], [], []
        for body in table.column("body").to_pylist():
            s = shingles(body)
            digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8")
            sample = s[s < SAMPLE_LIMIT]
            shared = int((_found(_short(sample), known, counts) > 1).sum())
            n.append(len(s))
            d1.append(int(digest[0]))
            d2.append(int(digest[1]))
            kept.append(s.tobytes() if len(s) and shared >= len(sample) - may_lack(len(s)) else None)
        return pa.table({"doc": table.column("doc"), "tie": table.column("tie"), "n": pa.array(n, pa.int64()), "d1": pa.array(d1, pa.int64()),
                         "d2": pa.array(d2, pa.int64()), "shingles": pa.array(kept, pa.binary())})

    sent = rows.groupBy("home").applyInArrow(send, SENT)
    met = sent.groupBy("bucket").applyInArrow(lambda t: _meet(t, "<u8"), MET)
    return written(rows.groupBy("home").cogroup(met.groupBy("home")).applyInArrow(
        decide, "doc long, tie long, n long, d1 long, d2 long, shingles binary"), "profiles")


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens that fall on each bit: two bitmaps differ in no more bits than their sets in tokens."""
    at = (_mixed(tokens ^ np.uint64(0x5555555555555555)) % np.uint64(64 * BITMAP_WORDS)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * BITMAP_WORDS).astype(np.uint8) & 1).view(np.int64)


def bitmaps(sets: DataFrame) -> DataFrame:
    """``id, bits`` of every set."""

    def build(batches):
        for batch in batches:
            bits = [bitmap(np.frombuffer(x, "<u8")).tolist() for x in batch.column("shingles").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "bits": pa.array(bits, pa.list_(pa.int64()))})

    return sets.select("id", "shingles").mapInArrow(build, "id long, bits array<long>")


def index_lists(sets: DataFrame) -> DataFrame:
    """``token, id, n, at``: the prefix of every set (id, n, shingles), rarest first, without shingles that one set holds."""
    spark = sets.sparkSession
    entries = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    homes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries / BUCKET_ENTRIES))
    buckets = max(1, math.ceil(entries / BUCKET_ENTRIES))
    rows = sets.withColumn("home", F.pmod(F.xxhash64("id"), F.lit(homes)))

    def send(table: pa.Table) -> pa.Table:
        return _sent(table.column("home")[0].as_py(), _joined(_arrays(table.column("shingles"), "<u8"), "<u8"), buckets)

    def prefixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        known, counts = _lookup(answers, "<u8")
        out = [[], [], [], []]
        for number, s in zip(table.column("id").to_pylist(), _arrays(table.column("shingles"), "<u8")):
            held = _found(s, known, counts)
            order = np.lexsort((s, held))[:may_lack(len(s)) + 1]
            at = np.flatnonzero(held[order] > 1)
            out[0].append(s[order][at].view(np.int64))
            out[1].append(np.full(len(at), number))
            out[2].append(np.full(len(at), len(s)))
            out[3].append(at)
        names = ("token", "id", "n", "at")
        return pa.table({k: pa.array(_joined(v, np.int64).astype(np.int64)) for k, v in zip(names, out)})

    sent = rows.groupBy("home").applyInArrow(send, SENT)
    met = sent.groupBy("bucket").applyInArrow(lambda t: _meet(t, "<u8"), MET)
    return written(rows.groupBy("home").cogroup(met.groupBy("home")).applyInArrow(
        prefixes, "token long, id long, n long, at long"), "index-lists")


def can_link(n1: Column, at1: Column, n2: Column, at2: Column) -> Column:
    """Whether sets that share a shingle at these positions can reach the overlap ``3 (n1 + n2) / 7``."""
    return (4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)) & (7 * F.least(n1 - at1, n2 - at2) >= 3 * (n1 + n2))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, la, lb) whose whole sets link."""

    def check(batches):
        for batch in batches:
            hit = [linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"))
                   for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["la", "lb"]).filter(pa.array(hit, pa.bool_()))

    side = lambda a, x: sets.select(F.col("id").alias(a), F.col("shingles").alias(x))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("la", "lb", "x", "y")
    return both.mapInArrow(check, "la long, lb long").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()


def _close(n1: Column, bits1: Column, n2: Column, bits2: Column) -> Column:
    """Whether the bitmaps differ in at most as many bits as linked sets may in tokens, ``n1 + n2 - 2 * overlap``."""
    different = sum((F.bit_count(bits1[w].bitwiseXOR(bits2[w])) for w in range(BITMAP_WORDS)), F.lit(0))
    return 7 * different <= n1 + n2


def _leader_pairs(index: DataFrame, labels: DataFrame, bits: DataFrame, turn: int) -> DataFrame:
    """Candidates of every set with the two leaders of its lists, where they are of another class: at most two per entry.

    One leader has the fewest rarer shingles before the list's, so of a family of copies it is one with few changes of its
    own, which most of the others link to. The other is drawn anew in every turn.
    """
    entries = index.join(labels, "id")
    leads = entries.groupBy("token").agg(
        F.min(F.struct("at", "id", "n", "label")).alias("central"),
        F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("draw"), "at", "id", "n", "label")).alias("drawn"),
        F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    drawn = F.struct("drawn.at", "drawn.id", "drawn.n", "drawn.label")
    leader = leads.select("token", F.explode(F.array_distinct(F.array("central", drawn))).alias("lead"))
    met = entries.join(leader, "token").filter(
        (F.col("label") != F.col("lead.label")) & can_link(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at")))
    pairs = met.select(F.col("lead.id").alias("a"), F.col("id").alias("b"), F.col("lead.label").alias("la"), F.col("label").alias("lb"),
                       F.col("lead.n").alias("na"), F.col("n").alias("nb")).distinct()
    side = lambda k: bits.select(F.col("id").alias(k), F.col("bits").alias(f"bits_{k}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").filter(_close(F.col("na"), F.col("bits_a"), F.col("nb"), F.col("bits_b")))
    return close.select("a", "b", "la", "lb")


def _cross_pairs(index: DataFrame, labels: DataFrame, bits: DataFrame) -> DataFrame:
    """All candidates between different classes."""
    entries = index.join(labels, "id")
    mixed = entries.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token")
    entries = written(entries.join(mixed, "token").join(bits, "id"), "mixed-lists")
    side = lambda rows, k: rows.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "at", "label", "bits")])
    smaller = (F.col("n_1") < F.col("n_2")) | ((F.col("n_1") == F.col("n_2")) & (F.col("id_1") < F.col("id_2")))
    pairs = side(entries.filter("7 * at <= n"), 1).join(side(entries, 2), "token").filter(
        (F.col("label_1") != F.col("label_2")) & smaller & can_link(F.col("n_1"), F.col("at_1"), F.col("n_2"), F.col("at_2"))
        & _close(F.col("n_1"), F.col("bits_1"), F.col("n_2"), F.col("bits_2")))
    return pairs.select(F.col("id_1").alias("a"), F.col("id_2").alias("b"), F.col("label_1").alias("la"), F.col("label_2").alias("lb")).distinct()


def led_labels(sets: DataFrame, index: DataFrame, bits: DataFrame) -> DataFrame:
    """``id, label`` of the classes that links with leaders make."""
    labels = sets.select("id", F.col("id").alias("label"))
    for turn in itertools.count():
        links = written(verified(_leader_pairs(index, labels, bits, turn), sets), "links")
        if links.isEmpty():
            return labels
        labels = merged_labels(labels, links)


def linked_sets(sets: DataFrame) -> DataFrame:
    """``id, label`` of the classes of linked sets, for ``sets`` (id, n, shingles) that are already written."""
    index, bits = index_lists(sets), written(bitmaps(sets), "bitmaps")
    labels = led_labels(sets, index, bits)
    return merged_labels(labels, verified(_cross_pairs(index, labels, bits), sets))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: ``doc, tie`` (the row), ``n_shingles``, ``component_id``, the least id of its class, and ``label``, the class itself.

    Where ids repeat or are null, several classes may have one least id; the label tells them apart.
    """
    profile = profiles(docs, text, key)
    equal = profile.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc").alias("least"), F.max("n").alias("n"), F.any_value("shingles", True).alias("shingles"))
    # sets are numbered once, in a written table; equal sets are one from here on
    equal = written(equal.withColumn("id", F.monotonically_increasing_id()), "equal-sets")
    labels = linked_sets(equal.filter(F.col("shingles").isNotNull()).select("id", "n", "shingles"))
    of_class = equal.select("id", "d1", "d2", "least").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = of_class.groupBy("label").agg(F.min("least").alias("component_id"))
    by_set = of_class.join(least, "label").select("d1", "d2", "component_id", "label")
    return (
        profile.select("doc", "tie", "n", "d1", "d2").join(by_set, ["d1", "d2"], "left")
        .select("doc", "tie", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"), "label")
    )


def report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return classes(docs, text, key).select(F.col("doc").alias(key), "n_shingles", "component_id")


def one_per_class(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class, that of the least id, in its own columns; rows without a word all stay.

    Of rows that share the least id and the text, that of the least number in a written table stays.
    """
    numbered = written(docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("bigint").alias("d"), F.xxhash64(whole_text(text)).alias("t"))
                       .withColumn("number", F.monotonically_increasing_id()), "numbered-rows")
    with passing_tables(docs.sparkSession):
        found = written(classes(numbered.select(F.col(f"row.{text}").alias("text"), "d"), "text", "d"), "classes", keep=True)
    first = found.filter("n_shingles > 0").groupBy("label").agg(F.min(F.struct("doc", "tie")).alias("f"))
    stay = first.select("f.doc", "f.tie")
    same = lambda: F.col("d").eqNullSafe(F.col("doc")) & (F.col("t") == F.col("tie"))
    kept = numbered.select("d", "t", "number").join(stay, same(), "left_semi").groupBy("d", "t").agg(F.min("number").alias("number")).select("number")
    wordless = found.filter("n_shingles = 0").select("doc", "tie").distinct()
    kept = kept.unionByName(numbered.select("d", "t", "number").join(wordless, same(), "left_semi").select("number"))
    return numbered.join(kept, "number", "left_semi").select("row.*")
