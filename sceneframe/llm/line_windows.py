"""Line dedup over overlapping three-line windows.

Every three consecutive lines that hold a word form a window; its 128-bit hash is counted over the whole corpus. Of a
window that occurs more than once the first occurrence stays, by ``doc_id`` and place; the lines that later occurrences
cover are merged and removed, but for those that the first occurrence of the same window covers itself (overlaps within
one document). Lines without a word are never hashed and stay.

Windows are (hash, document, place) rows: the count combines before its shuffle, the join back is by hash and may be split
by AQE where one window is in a third of all documents. Texts are shuffled once, to meet their lists of lines.

Defined results: a null text stays null; texts with fewer than three lines with a word stay whole; a null ``doc_id`` sorts
first; rows with the same ``doc_id`` and text count as one document and get one result each; documents with the same
``doc_id`` and different texts are ordered by a hash of the text. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.llm.text import let, lines, whole_text
from sceneframe.session import written

WIDTH = 3
WITH_WORD = r"[^\x20\x09-\x0D]"


def spoken_lines(text: Column) -> Column:
    """The lines with a word, with their numbers: ``array<struct<line, at>>``."""
    numbered = F.transform(lines(text), lambda line, at: F.struct(line.alias("line"), at.alias("at")))
    return F.filter(numbered, lambda x: x["line"].rlike(WITH_WORD))


def windows(docs: DataFrame) -> DataFrame:
    """``doc, tie, place, h1, h2`` of every window; ``docs`` has ``doc, tie, text``."""

    def hashes(spoken: Column) -> Column:
        count = F.greatest(F.size(spoken) - (WIDTH - 1), F.lit(0))
        parts = F.arrays_zip(*[F.slice(spoken, k + 1, count).alias(f"l{k}") for k in range(WIDTH)])
        line = lambda w: [w[f"l{k}"]["line"] for k in range(WIDTH)]
        return F.transform(parts, lambda w: F.struct(
            F.xxhash64(F.lit(1), *line(w)).alias("h1"), F.xxhash64(F.lit(2), *line(w)).alias("h2")))

    found = docs.filter(F.col("text").isNotNull()).select("doc", "tie", F.posexplode(let(spoken_lines(F.col("text")), hashes)).alias("place", "h"))
    return found.select("doc", "tie", "place", "h.h1", "h.h2")


def later_places(found: DataFrame) -> DataFrame:
    """Per document the line places (among lines with a word) that later occurrences cover."""
    place = F.struct("doc", "tie", "place")
    repeated = (
        found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first"))
        .filter("n > 1").select("h1", "h2", "first")
    )
    later = found.join(repeated, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    home = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("tie") == F.col("first.tie"))
    begin = F.when(home, F.greatest("place", F.col("first.place") + WIDTH)).otherwise(F.col("place"))
    return (
        later.select("doc", "tie", F.explode(F.sequence(begin, F.col("place") + WIDTH - 1)).alias("covered"))
        .groupBy("doc", "tie").agg(F.collect_set("covered").alias("covered"))
    )


def _without(text: Column, covered: Column) -> Column:
    def rest(all_lines: Column) -> Column:
        gone = let(spoken_lines(text), lambda s: F.transform(covered, lambda p: s[p]["at"]))
        kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: all_lines[i]), "\n")

    return let(lines(text), rest)


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``row`` (the columns of ``docs``), ``text`` without the removed lines, ``n_lines`` and ``n_removed``."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("bigint").alias("doc"),
                       F.xxhash64(whole_text(text)).alias("tie"), F.col(text).alias("text"))
    # rows that repeat both id and text are one document
    found = windows(rows).groupBy("doc", "tie", "place", "h1", "h2").agg(F.lit(1).alias("one")).drop("one")
    covered = later_places(written(found, "line-windows"))
    joined = rows.alias("r").join(
        covered.select(F.col("doc").alias("d"), F.col("tie").alias("t"), "covered"),
        F.col("doc").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    return joined.select(
        "row", F.when(F.col("covered").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("covered"))).alias("text"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines(F.col("text")))).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("bigint").alias("n_removed"))


def report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: ``doc_id``, ``n_lines``, ``n_removed`` and the text that is left."""
    return dedup_lines(docs, text, key).select(f"row.{key}", "n_lines", "n_removed", "text")


def cleaned(docs: DataFrame, text: str = "text", key: str = "doc_id", length: str | None = "n_chars") -> DataFrame:
    """The documents without repeated passages, in their own columns; those left without a word go.

    ``length`` names the column that holds the number of characters and is set anew.
    """
    done = dedup_lines(docs, text, key).filter((F.col("n_removed") == 0) | F.col("text").rlike(WITH_WORD))
    value = lambda c: (F.col("text") if c == text else F.length("text").cast("bigint") if c == length else F.col(f"row.`{c}`"))
    return done.select(*[value(c).alias(c) for c in docs.columns])
