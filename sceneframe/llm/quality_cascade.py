"""Quality rules as a short-circuit cascade.

Every rule is a boolean column that rejects a document. ``plan_cascade`` measures on a sample what each rule costs and
how much it rejects, and orders the rules by rejection per cost; ``keep`` then evaluates them as one CASE expression, so a
document pays only for the rules up to the first that rejects it. The order changes the work, never the verdict.

Defined results: a null text counts as empty and is rejected by the base rule (under 50 words); null values in other
columns, repeated rows and extra columns have no influence; an empty table gives an empty table. A text of any length is
measured whole, inside its own row, so there is no shuffle.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.llm.text import let, lines, whole_text, words
from sceneframe.session import written

SYMBOLS = r"[#*$%&|<>]"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"

# fixed limits of the rules; shares are of the words or lines of the document
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PERCENT = 20
MIN_LETTER_PERCENT = 70
MAX_DUPLICATE_LINES_PERCENT = 50
MAX_MEAN_WORD = 25


def n_symbols(text: Column) -> Column:
    return (F.size(F.split(text, SYMBOLS)) - 1).cast("bigint")


def n_duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    spoken = F.filter(lines(text), lambda line: line.rlike(WORD_CHARACTER))
    return let(spoken, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("bigint")


def n_repeat_words(word: Column) -> Column:
    """Words inside a three-word window that the text has twice or more, the first one included."""
    count = F.greatest(F.size(word) - 2, F.lit(0))
    windows = F.transform(
        F.arrays_zip(F.slice(word, 1, count).alias("a"), F.slice(word, 2, count).alias("b"), F.slice(word, 3, count).alias("c")),
        lambda w: F.xxhash64(w["a"], w["b"], w["c"]),
    )

    def covered(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spread(rows: Column) -> Column:
            n = F.size(rows)
            later = F.slice(rows, 2, n - 1)
            pairs = F.filter(F.arrays_zip(F.slice(rows, 1, n - 1).alias("p"), later.alias("q")), lambda z: z["p"]["h"] == z["q"]["h"])
            return F.flatten(F.transform(pairs, lambda z: F.array(
                z["p"]["i"], z["p"]["i"] + 1, z["p"]["i"] + 2, z["q"]["i"], z["q"]["i"] + 1, z["q"]["i"] + 2)))

        # the usual case, no window twice, stops at the count of distinct hashes
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            F.size(F.array_distinct(let(ranked, spread))))

    return let(windows, covered).cast("bigint")


def with_words(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``_row`` (the carried columns), ``_text`` and ``_words``; the columns of ``docs`` cannot clash with them."""
    body = docs.select(F.struct(*(carry or docs.columns)).alias("_row"), whole_text(text).alias("_text"))
    return body.withColumn("_words", words(F.col("_text")))


@dataclass(frozen=True)
class Rule:
    """A named column that is true where the document is rejected."""

    name: str
    rejects: Column


def base_failed(n_words: Column, repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * repeat_words > MAX_REPEAT_PERCENT * n_words)


def base_rules() -> list[Rule]:
    """The two base rules over ``_text`` and ``_words``."""
    n = F.size("_words")
    return [
        Rule("few_words", n < MIN_WORDS),
        Rule("repeated_words", 100 * n_repeat_words(F.col("_words")) > MAX_REPEAT_PERCENT * n),
    ]


def text_rules(symbols: Column | None = None, duplicate_lines: Column | None = None) -> list[Rule]:
    """The further rules over ``_text`` and ``_words``; counts that are at hand already may be passed in."""
    n, text, word = F.size("_words"), F.col("_text"), F.col("_words")
    symbols = n_symbols(text) if symbols is None else symbols
    repeated = n_duplicate_lines(text) if duplicate_lines is None else duplicate_lines
    lettered = F.size(F.filter(word, lambda w: w.rlike(r"\p{L}")))
    return [
        Rule("symbols", 100 * symbols > MAX_SYMBOLS_PERCENT * n),
        Rule("few_letters", 100 * lettered < MIN_LETTER_PERCENT * n),
        Rule("duplicate_lines", 100 * repeated > MAX_DUPLICATE_LINES_PERCENT * F.size(lines(text))),
        Rule("long_words", F.length(F.concat_ws("", word)) > MAX_MEAN_WORD * n),
    ]


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float
    rejected: float


def plan_cascade(docs: DataFrame, rules: list[Rule], sample_rows: int = 2000, text: str = "text") -> tuple[list[Rule], list[Measured]]:
    """Rules in descending rejection per cost, and the measurements.

    The sample is about ``sample_rows`` documents, written once; only the order of the rules depends on it. Each rule is timed by one aggregate over the sample, the better of two runs.
    """
    total = max(docs.count(), 1)
    share = min(1.0, sample_rows / total)
    picked = docs.select(F.col(text).alias("text")).sample(share, seed=7)
    sample = with_words(written(picked.repartition(4), "quality-sample"))
    measured = []
    for rule in rules:
        best, share_rejected = float("inf"), 0.0
        for _ in range(2):
            start = time.perf_counter()
            row = sample.agg(F.count("*").alias("n"), F.sum(rule.rejects.cast("bigint")).alias("r")).first()
            best = min(best, time.perf_counter() - start)
            share_rejected = (row["r"] or 0) / max(row["n"], 1)
        measured.append(Measured(rule.name, best, share_rejected))
    ranked = sorted(range(len(rules)), key=lambda i: (-measured[i].rejected / max(measured[i].seconds, 1e-9), measured[i].seconds))
    return [rules[i] for i in ranked], [measured[i] for i in ranked]


def passes(ordered: list[Rule]) -> Column:
    """True where no rule rejects; evaluation stops at the first that does."""
    chain = None
    for rule in ordered:
        hit = F.coalesce(rule.rejects, F.lit(False))
        chain = F.when(hit, False) if chain is None else chain.when(hit, False)
    return F.lit(True) if chain is None else chain.otherwise(True)


def keep(docs: DataFrame, sample_rows: int = 2000, text: str = "text") -> DataFrame:
    """Documents that all rules pass, with their own columns."""
    ordered, _ = plan_cascade(docs, base_rules() + text_rules(), sample_rows, text)
    return with_words(docs, text).filter(passes(ordered)).select("_row.*")


def measure(docs: DataFrame, sample_rows: int = 2000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: the base counts, ``base_failed`` and ``kept``."""
    ordered, _ = plan_cascade(docs, text_rules(), sample_rows, text)
    by_name = {r.name: r for r in text_rules(F.col("n_symbols"), F.col("n_dup_lines"))}
    stats = (
        with_words(docs, text, [key])
        .withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("word_chars", F.length(F.concat_ws("", "_words")).cast("bigint"))
        .withColumn("n_symbols", n_symbols(F.col("_text")))
        .withColumn("n_dup_lines", n_duplicate_lines(F.col("_text")))
        .withColumn("n_repeat_words", n_repeat_words(F.col("_words")))
        .withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    )
    verdict = F.when(F.col("base_failed"), False).otherwise(passes([by_name[r.name] for r in ordered]))
    return stats.select(
        f"_row.{key}", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"))
