"""Language identification in two steps: the family first, then one-versus-one within it.

Features are relative frequencies of hashed letter 1- to 4-grams of the whole text. A linear support vector machine per
family (one versus the rest) picks the family; for every pair of languages of one family another one votes between the
two. Machines are fitted by ``pyspark.ml`` on a bounded sample: at most ``SAMPLE_PER_LANGUAGE`` training documents of each
language, those with the least hash of the id. Every document is then classified on its whole text, in one pass without a
shuffle; only the weights (a vector per machine) travel.

Families are fixed values; a learned language outside the table is a family of its own, so its label comes from the first
step alone.

Defined results: ``und`` with score 0 for a null text or one without a letter; ``und`` for all where no training label
exists; a null id has the crc32 of an empty text and is held out; null labels are never learned from. Ties go to the
language that sorts first. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from sceneframe.llm.text import whole_text
from sceneframe.session import written

HOLD_OUT = 5  # documents whose crc32 modulo this is 0 are held out
SAMPLE_PER_LANGUAGE = 1000
WIDTH = 4
SIZE = 1 << 12
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"\P{L}+")

# fixed families
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
}
FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages}


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(HOLD_OUT)) == 0


def family(language: str) -> str:
    return FAMILY_OF.get(language, language)


def grams(text: str) -> np.ndarray:
    """Feature numbers of all letter 1- to 4-grams; runs of other characters count as one space."""
    letters = NOT_LETTERS.sub(" ", f" {text.lower()} ")
    code = np.frombuffer(letters.encode("utf-32-le"), "<u4").astype(np.uint64)
    rolled, found = np.zeros(len(code), np.uint64), []
    for width in range(1, WIDTH + 1):
        rolled = rolled[:len(code) - width + 1] * np.uint64(0x9E3779B97F4A7C15) + code[width - 1:]
        mixed = (rolled ^ (rolled >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        found.append((mixed >> np.uint64(64 - SIZE.bit_length() + 1)).astype(np.int64))
    return np.concatenate(found)


def features(text: str) -> np.ndarray:
    at = grams(text)
    return np.bincount(at, minlength=SIZE) * (1000 / len(at))  # in thousandths


def sample(docs: DataFrame, text: str, key: str, label: str, per_language: int) -> DataFrame:
    """``lang, body`` of the training sample; a text leaves its task only if the hash threshold lets its row through.

    The thresholds, one a language, are literals of the filter.
    """
    rows = docs.filter(~held_out(F.col(key)) & F.col(label).isNotNull()).select(
        F.col(label).alias("lang"), F.col(text).alias("body"), F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("at"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    # about twice the bound by the threshold, then exactly the bound
    below = [F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, -(-(2 * per_language << 30) // n))]
    some = rows.filter(F.col("at") < F.create_map(*below)[F.col("lang")] if below else F.lit(False))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at", F.xxhash64("body")))
    return some.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("lang", "body")


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [(lang, body) for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if body and LETTER.search(body)]
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([x[0] for x in keep], pa.string()),
            "x": pa.array([features(x[1]).tolist() for x in keep], pa.list_(pa.float64()))})


def _machine(rows: DataFrame, positive: Column) -> np.ndarray:
    """Weights and intercept of one linear machine."""
    fitted = LinearSVC(maxIter=20, regParam=1e-3, standardization=False, aggregationDepth=2).fit(
        rows.select(array_to_vector("x").alias("features"), positive.cast("double").alias("label")))
    return np.append(fitted.coefficients.toArray(), fitted.intercept)


class Model:
    """Machines by family and by pair of languages; ``predict`` gives (language, score)."""

    def __init__(self, languages: list[str]):
        self.languages = sorted(languages)
        self.families = sorted({family(x) for x in self.languages})
        self.members = {f: [x for x in self.languages if family(x) == f] for f in self.families}
        self.pairs = [p for f in self.families for p in combinations(self.members[f], 2)]
        self.weights = np.zeros((0, SIZE + 1))

    def fit(self, rows: DataFrame) -> Model:
        """One machine per family and per pair; their number depends on the languages alone."""
        machines = []
        if len(self.families) > 1:
            machines += [_machine(rows, F.col("lang").isin(self.members[f])) for f in self.families[:1 if len(self.families) == 2 else None]]
        machines += [_machine(rows.filter(F.col("lang").isin(*p)), F.col("lang") == p[0]) for p in self.pairs]
        if machines:
            self.weights = np.array(machines)
        return self

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        x = features(text)
        margin = self.weights[:, :-1] @ x + self.weights[:, -1]
        n = len(self.families)
        first = 0 if n == 1 else 1 if n == 2 else n
        side = [margin[0], -margin[0]] if n == 2 else margin[:first]
        best = int(np.argmax(side)) if n > 1 else 0
        sure = _sigmoid(side[best]) if n > 1 else 1.0
        members = self.members[self.families[best]]
        votes = dict.fromkeys(members, 0.0)
        for (a, b), m in zip(self.pairs, margin[first:]):
            if a in votes:
                # a vote each, the margin parts equal votes
                votes[a if m >= 0 else b] += 1
                votes[a] += 1e-3 * np.tanh(m)
                votes[b] -= 1e-3 * np.tanh(m)
        winner = max(members, key=lambda x: (votes[x], -members.index(x)))
        for (a, b), m in zip(self.pairs, margin[first:]):
            if winner in (a, b):
                sure = min(sure, _sigmoid(m if winner == a else -m))
        return winner, float(sure)


def _sigmoid(margin: float) -> float:
    return 1 / (1 + np.exp(-2 * np.clip(margin, -30, 30)))


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", label: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    rows = written(sample(docs, text, key, label, per_language).mapInArrow(_vectors, "lang string, x array<double>"), "language-sample")
    found = rows.groupBy("lang").count().collect()  # one row per language
    return Model([r.lang for r in found]).fit(rows)


def classify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: ``doc_id, held_out, lang_pred, score``."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc": batch.column("doc"), "held_out": batch.column("held_out"), "lang_pred": pa.array([x[0] for x in found], pa.string()),
                "score": pa.array([x[1] for x in found], pa.float64())})

    rows = docs.select(F.col(key).cast("bigint").alias("doc"), held_out(F.col(key)).alias("held_out"), whole_text(text).alias("body"))
    return rows.mapInArrow(predict, "doc long, held_out boolean, lang_pred string, score double").withColumnRenamed("doc", key)


def identify(docs: DataFrame, text: str = "text", key: str = "doc_id", label: str = "lang") -> DataFrame:
    return classify(docs, fit(docs, text, key, label), text, key)
