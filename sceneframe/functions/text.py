"""Free-text detector answers and small string formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The text patterns of detector answers.
PROMPT_PATTERN = r"(?s)<\|im_start\|>.*?assistant"
FENCE_PATTERN = "```(json)?"
FLAT_OBJECT_PATTERN = r"(\{[^{}]*\})"
TRAILING_COMMA_PATTERN = r"(?U),\s*\}"

_ANSWER_FIELDS = "label string, class string, bbox_2d array<double>, bbox array<double>, _malformed string"


def parse_answer_objects(answer: Column) -> Column:
    """Every whole flat JSON object of an answer as ``array<struct<class, bbox>>``.

    Malformed objects and a truncated tail are skipped. An empty label falls through to the
    class and an empty first box to the second; only nulls drop an object.
    """
    body = F.regexp_replace(F.regexp_replace(answer, PROMPT_PATTERN, ""), FENCE_PATTERN, "")
    pieces = F.regexp_extract_all(body, F.lit(FLAT_OBJECT_PATTERN), 1)
    parsed = F.transform(
        pieces,
        lambda piece: F.from_json(
            F.regexp_replace(piece, TRAILING_COMMA_PATTERN, "}"),
            _ANSWER_FIELDS,
            {"columnNameOfCorruptRecord": "_malformed", "allowSingleQuotes": "false"},
        ),
    )
    def label(o: Column) -> Column:
        return F.coalesce(F.nullif(o["label"], F.lit("")), o["class"])

    def box(o: Column) -> Column:
        return F.coalesce(F.when(F.size(o["bbox_2d"]) > 0, o["bbox_2d"]), o["bbox"])

    kept = F.filter(parsed, lambda o: o["_malformed"].isNull() & label(o).isNotNull() & box(o).isNotNull())
    return F.transform(kept, lambda o: F.struct(label(o).alias("class"), box(o).alias("bbox")))


def frame_key(video_id: Column, fid: Column) -> Column:
    """``<video>/<six-digit frame>``."""
    return F.format_string("%s/%06d", video_id.cast("string"), fid.cast("long"))


def frame_group(key: Column) -> Column:
    """The video part of a frame key."""
    return F.split_part(key, F.lit("/"), F.lit(1))


def parse_frame_path(path: Column) -> Column:
    """``video_id`` and ``fid`` of a ``<video>/<fid:06d>.jpg`` path; null when it does not fit."""
    pattern = r"([^/]+)/([0-9]{6,})[.]jpg$"
    return F.when(
        path.rlike(pattern),
        F.struct(
            F.regexp_extract(path, pattern, 1).alias("video_id"),
            F.regexp_extract(path, pattern, 2).cast("long").alias("fid"),
        ),
    )


def keeps_frame(fid: Column, fps: int, source_fps: int = 30) -> Column:
    """Frame subsampling: keep every ``max(1, source_fps div fps)``-th source frame."""
    return fid % F.lit(max(1, source_fps // fps)) == 0


def config_key(config: Column) -> Column:
    """Canonical text of a config map: entries sorted by key."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(config))))


def elapsed_seconds(text: Column) -> Column:
    """Seconds of ``[D-][[HH:]MM:]SS``; null for any other text."""
    days = F.when(F.instr(text, "-") > 0, F.split_part(text, F.lit("-"), F.lit(1)).try_cast("long")).otherwise(F.lit(0))
    clock = F.reverse(F.split(F.regexp_replace(text, "^[0-9]+-", ""), ":"))
    part = lambda k: F.when(F.size(clock) > k, F.get(clock, F.lit(k)).try_cast("long")).otherwise(F.lit(0))
    return F.when(F.size(clock) <= 3, ((days * 24 + part(2)) * 60 + part(1)) * 60 + part(0))


def memory_megabytes(text: Column) -> Column:
    """Megabytes of ``NNN[K|M|G]``; any other last character counts as bytes."""
    number = text.substr(F.lit(1), F.length(text) - 1).try_cast("double")
    unit = F.substring(text, -1, 1)
    return (
        F.when(unit == "K", number / 1024)
        .when(unit == "M", number)
        .when(unit == "G", number * 1024)
        .otherwise(number / 1024 / 1024)
    )
