"""The append-only trial log: one JSON array ``[eval, {config}, {defaults}]`` after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sceneframe.sources.json_values import read_json_values, row_values

CUT_LINES = r"\n(?=\s*\[)"  # where entries begin after one that was broken off


def _entries(pieces: DataFrame, *keep: str) -> DataFrame:
    parsed = pieces.select(*keep, "_piece", F.from_json("_piece", "array<string>").alias("_e"))
    as_map = "map<string,string>"
    eval = F.regexp_replace(F.get("_e", F.lit(0)), '^"|"$', "").try_cast("double")
    config = F.from_json(F.get("_e", F.lit(1)), as_map)
    readable = eval.isNotNull() & config.isNotNull()
    return parsed.select(
        *keep,
        F.when(readable, eval).alias("eval"),
        F.when(readable, config).alias("config"),
        F.when(readable, F.from_json(F.get("_e", F.lit(2)), as_map)).alias("defaults"),
        F.when(~readable, F.col("_piece")).alias("malformed"),
    )


def parse_trial_values(values: DataFrame) -> DataFrame:
    """``(line, eval, config, defaults, malformed)`` of values ``(ordinal, text)``; ``line`` is the ordinal.

    A diverged run logs ``NaN``, which is kept. An entry that cannot be read has a null ``eval`` and its text in ``malformed``.
    Where an entry was broken off, those that begin on later lines are read for themselves, under its ordinal.
    """
    whole = F.from_json("text", "array<string>").isNotNull()
    lines = F.when(whole, F.array("text")).otherwise(F.split("text", CUT_LINES))
    return _entries(values.select(F.col("ordinal").alias("line"), F.explode(lines).alias("_piece")), "line")


def parse_trial_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """As ``parse_trial_values`` for rows of text that each hold whole arrays, back to back; ``line`` has gaps between tasks."""
    pieces = row_values(lines, value).select(F.monotonically_increasing_id().alias("line"), F.col("text").alias("_piece"))
    return _entries(pieces, "line")


def read_trial_log(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a log of any size, whatever stands in its strings and however its lines are broken."""
    return parse_trial_values(read_json_values(spark, path))


def trial_lines(trials: DataFrame) -> DataFrame:
    """Log lines of ``(eval, config, defaults)`` rows."""
    return trials.select(
        F.concat(F.lit("["), F.col("eval").cast("string"), F.lit(", "), F.to_json("config"), F.lit(", "),
                 F.to_json("defaults"), F.lit("]")).alias("value")
    )


def append_trial_log(trials: DataFrame, path: str) -> None:
    """Append finished trials; each job adds its own files, so no lock is needed."""
    trial_lines(trials).write.mode("append").text(path)
