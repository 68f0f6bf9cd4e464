"""Dataset reports: primary categories, viability, label metrics, audits and run sizing."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.functions.boxes import box_area
from sceneframe.functions.text import elapsed_seconds, memory_megabytes

VIABLE_TRANSITIONS = 5000  # fixed value: default bar of the viability report


def appearance(fid: Column, pos: Column, digits: int = 18) -> Column:
    """Sort key of a detection: frame first, then the position inside it, packed into one decimal.

    A decimal keeps the minimum in a hash aggregate; a struct would force a sort of the detections.
    """
    whole = "decimal(38,0)"
    return (fid.cast(whole) * F.lit(Decimal(10 ** digits)) + pos.cast(whole)).cast(whole)


def primary_category(detections: DataFrame, categories: DataFrame, videos: DataFrame | None = None,
                     video: str = "video_id", tid: str = "tid", first: Column | None = None) -> DataFrame:
    """Category of the track seen in the most frames; ties by total area, then by first appearance.

    Two aggregations and no window: each combines map-side, so a hot video costs one partial row
    per track and task. ``first`` orders appearances, by default frame and position. With ``videos``
    given, videos without detections appear with a null primary.
    """
    area = box_area(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    seen = first if first is not None else appearance(F.col("fid"), F.col("pos"))
    tracks = detections.groupBy(video, tid).agg(
        F.count("*").alias("n"), F.sum(area).alias("area"), F.min(seen).alias("first")
    )
    best = tracks.groupBy(video).agg(
        F.min_by(tid, F.struct(-F.col("n"), -F.col("area"), F.col("first"))).alias(tid)
    )
    named = best.join(categories, [video, tid], "left").select(video, F.col("category").alias("primary"))
    return named if videos is None else videos.select(video).join(named, video, "left")


def category_filter(detections: DataFrame, category: str, primaries: DataFrame | None = None,
                    subjects: DataFrame | None = None, strict: bool = True, video: str = "video_id") -> DataFrame:
    """Keep videos whose primary category (strict) or any subject (loose) equals ``category``."""
    if strict:
        chosen = primaries.where(F.col("primary") == category)
    else:
        chosen = subjects.where(F.col("category") == category)
    return detections.join(chosen.select(video), video, "left_semi")


def category_video_counts(subjects: DataFrame, video: str = "video_id", category: str = "category") -> DataFrame:
    """Videos containing each category, most common first."""
    return (
        subjects.select(video, category).distinct()
        .groupBy(category).agg(F.count("*").alias("videos"))
        .orderBy(F.col("videos").desc(), category)
    )


def video_frame_counts(frames: DataFrame, video: str = "video_id") -> DataFrame:
    return frames.groupBy(video).agg(F.count("*").alias("frames"))


def viability(subjects: DataFrame, frames: DataFrame, threshold: int = VIABLE_TRANSITIONS,
              video: str = "video_id", category: str = "category", primaries: DataFrame | None = None) -> DataFrame:
    """Per category: listed videos, videos with frames, frames, transitions and the verdict.

    A video counts for every category listed in it (loose), or with ``primaries`` (video, primary) for its primary one
    only (strict). Frames are counted once per video before they meet the categories.
    """
    counts = video_frame_counts(frames, video)
    listed = subjects.select(video, category).distinct()
    if primaries is not None:
        listed = primaries.where("primary is not null").select(video, F.col("primary").alias(category)).distinct()
    return (
        listed.join(counts, video, "left")
        .groupBy(category).agg(
            F.count("*").alias("listed_videos"),
            F.count("frames").alias("videos"),
            F.coalesce(F.sum("frames"), F.lit(0)).alias("frames"),
            F.coalesce(F.sum(F.greatest(F.col("frames") - 1, F.lit(0))), F.lit(0)).alias("transitions"),
        )
        .withColumn("viable", F.col("transitions") >= threshold)
    )


def viability_total(frames: DataFrame, threshold: int = VIABLE_TRANSITIONS, video: str = "video_id") -> DataFrame:
    """The same report over all videos; a video counts once however many categories it has."""
    return (
        video_frame_counts(frames, video)
        .agg(
            F.count("*").alias("videos"),
            F.coalesce(F.sum("frames"), F.lit(0)).alias("frames"),
            F.coalesce(F.sum(F.col("frames") - 1), F.lit(0)).alias("transitions"),
        )
        .withColumn("viable", F.col("transitions") >= threshold)
    )


def annotation_metrics(images: DataFrame, objects: str = "objects") -> DataFrame:
    """Long report ``(metric, item, value)``: images, objects, objects per image, label counts.

    ``objects`` is an array of structs with a ``class`` field. One scan: each image emits its
    facts and one aggregation counts them.
    """
    n = F.size(F.coalesce(F.col(objects), F.array()))
    facts = F.concat(
        F.array(
            F.struct(F.lit("images").alias("metric"), F.lit("").alias("item"), F.lit(1).cast("long").alias("value")),
            F.struct(F.lit("objects").alias("metric"), F.lit("").alias("item"), n.cast("long").alias("value")),
            F.struct(F.lit("objects_per_image").alias("metric"), n.cast("string").alias("item"), F.lit(1).cast("long").alias("value")),
        ),
        F.transform(
            F.col(objects),
            lambda o: F.struct(F.lit("label").alias("metric"), o["class"].alias("item"), F.lit(1).cast("long").alias("value")),
        ),
    )
    return images.select(F.inline(facts)).groupBy("metric", "item").agg(F.sum("value").alias("value"))


def top_labels(detections: DataFrame, label: str, n: int = 10) -> DataFrame:
    """The ``n`` most common labels."""
    return (
        detections.groupBy(label).agg(F.count("*").alias("objects"))
        .orderBy(F.col("objects").desc(), label).limit(n)
    )


def category_audit(primaries: DataFrame, category: str) -> DataFrame:
    """Histogram of loaded primaries with the violations of the requested category."""
    return (
        primaries.groupBy("primary").agg(F.count("*").alias("videos"))
        .withColumn("violation", ~F.col("primary").eqNullSafe(F.lit(category)))
    )


def audit_verdict(primaries: DataFrame, category: str) -> DataFrame:
    """One row: loaded videos, violations and whether the audit passes."""
    bad = F.count_if(~F.col("primary").eqNullSafe(F.lit(category)))
    return primaries.agg(F.count("*").alias("videos"), bad.alias("violations")).withColumn(
        "passed", F.col("violations") == 0
    )


def load_summary(loaded_videos: DataFrame, states: DataFrame, video: str = "video_id") -> DataFrame:
    """Videos with their primary and number of states; a matching video without frames counts as loaded.

    The ids stay a table (one row per video) instead of one array, so the result scales with it.
    """
    counts = states.groupBy(video).agg(F.count("*").alias("states"))
    return loaded_videos.join(counts, video, "left").withColumn("states", F.coalesce(F.col("states"), F.lit(0)))


def load_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("num_videos"), F.coalesce(F.sum("states"), F.lit(0)).alias("num_states"))


def manifest_guard(manifest: DataFrame, requested: str | None, column: str = "category_filter") -> DataFrame:
    """The manifest row, or an error when it was written for another category."""
    same = F.col(column).eqNullSafe(F.lit(requested))
    message = F.concat(F.lit("manifest was written for category "), F.coalesce(F.col(column), F.lit("none")),
                       F.lit(f", requested {requested}"))
    return manifest.where(F.when(same, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def run_sizing_from_history(jobs: DataFrame, elapsed: str = "elapsed", memory: str = "max_rss") -> DataFrame:
    """Time and memory requests from past runs: the maxima plus a quarter and a fixed slack.

    Rows with an empty elapsed time are ignored; integer arithmetic throughout.
    """
    used = jobs.where(F.col(elapsed) != "")
    # fixed values: 5/4 headroom, 1800 s and 2048 MB slack, 16384 MB floor
    return (
        used.agg(
            F.count("*").alias("runs"),
            F.max(elapsed_seconds(F.col(elapsed))).alias("max_seconds"),
            F.floor(F.coalesce(F.max(F.when(F.col(memory) != "", memory_megabytes(F.col(memory)))), F.lit(0.0))).alias("max_mb"),
        )
        .withColumn("request_seconds", F.floor(F.col("max_seconds") * 5 / 4) + 1800)
        .withColumn("request_mb", F.greatest(F.floor(F.col("max_mb") * 5 / 4) + 2048, F.lit(16384)))
        .withColumn("request_gb", F.ceil(F.col("request_mb") / 1024))
    )
