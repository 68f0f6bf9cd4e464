"""Dataset plans: annotations to slots, transitions and splits, each one lazy plan up to its write."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sceneframe.functions.boxes import MAX_OBJECTS
from sceneframe.functions.text import frame_key
from sceneframe.operators.profile import category_filter, primary_category
from sceneframe.operators.slots import frames_present, name_objects, subject_categories
from sceneframe.operators.transitions import endpoints, positional_split, sequential_in_group
from sceneframe.operators.ordering import natural_position, total_rows
from sceneframe.plans.scenes import scene_slots
from sceneframe.sources.annotations import video_detections


def loaded_detections(detections: DataFrame, subjects: DataFrame, frames: DataFrame | None = None,
                      category: str | None = None, strict: bool = True, order: list[str] = ["pos"],
                      subject_order: list[str] = ["pos"], frame_keys: list[str] = ["video_id", "fid"],
                      first=None) -> DataFrame:
    """Named detections of the frames that exist, of the videos of one category.

    The category is tested first, on one row per video, so the other joins see only its videos.
    """
    categories = subject_categories(subjects, order=subject_order)
    kept = detections
    if category is not None:
        primaries = primary_category(detections, categories, first=first) if strict else None
        kept = category_filter(kept, category, primaries, subjects, strict)
    if frames is not None:
        kept = frames_present(kept, frames, frame_keys)
    return name_objects(kept, categories)


def video_slots(detections: DataFrame, subjects: DataFrame, frames: DataFrame | None = None, state: str = "state_id",
                order: list[str] = ["pos"], unique: bool = False, k: int = MAX_OBJECTS, **options) -> DataFrame:
    """Slots of every loaded frame; names of a video frame may repeat unless ``unique``."""
    named = loaded_detections(detections, subjects, frames, order=order, **options)
    return scene_slots(named, state, "name", order, unique, k)


def video_splits(frames: DataFrame, video: str = "video_id", fid: str = "fid", small_set: int | None = None) -> DataFrame:
    """Endpoints ``(video, position, state, split)`` of the sequential transitions: all pre, then all suc, cut by position.

    ``frames`` are the loaded frames; frame numbers may restart in every video. With ``small_set`` every endpoint is in all
    splits when there are fewer frames than that.
    """
    pairs = sequential_in_group(frames, video, fid)
    placed = natural_position(pairs, [video, "pre"], "number")
    count = total_rows(placed)
    ends = endpoints(placed, "number", total=count, keep=[video])
    return positional_split(ends, states=total_rows(frames), rows=count * 2, small_set=small_set)


def annotation_slots(docs: DataFrame, k: int = MAX_OBJECTS) -> DataFrame:
    """Slots of every frame of annotation documents; names may repeat in a frame."""
    return scene_slots(video_detections(docs), "state_id", "name", ["pos"], False, k)


def annotation_splits(docs: DataFrame, small_set: int | None = None) -> DataFrame:
    """Endpoints of the sequential transitions between the frames with objects, with their ``state_id``."""
    frames = video_detections(docs).select("video_id", "fid").distinct()
    return video_splits(frames, small_set=small_set).withColumn("state_id", frame_key(F.col("video_id"), F.col("state")))


def write_splits(slots: DataFrame, splits: DataFrame, keys: list[str], path: str) -> None:
    """Slot features of every split as Parquet, one folder per split.

    ``keys`` are the columns of ``slots`` that identify a state, the frame or state number last; those before it, such as
    the video, are columns of ``splits`` too.
    """
    *group, state = keys
    members = splits.select(*group, F.col("state").alias(state), "position", "split")
    slots.join(members, keys).write.mode("overwrite").partitionBy("split").parquet(path)
