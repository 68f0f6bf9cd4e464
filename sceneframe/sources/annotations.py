"""Readers for video annotations, labelled images, detector answers, frames, archives and name files.

Every schema is explicit: keys such as ``subject/objects`` may be absent from a document.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sceneframe.functions.arrays import exploded
from sceneframe.functions.boxes import normalized_to_corners
from sceneframe.functions.text import frame_key, parse_answer_objects, parse_frame_path
from sceneframe.operators.slots import skip_empty as without_empty
from sceneframe.sources.json_values import read_json_values
from sceneframe.sources.listing import list_files

# The input formats.
VIDEO_SCHEMA = (
    "video_id string, width int, height int, frame_count int, "
    "`subject/objects` array<struct<tid:int,category:string>>, "
    "trajectories array<array<struct<tid:int,bbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>>>>"
)
IMAGE_SCHEMA = "image string, objects array<struct<class:string,bbox:array<double>>>"
ANSWER_SCHEMA = "image string, output string"
NAMES_SCHEMA = (
    "image_ids array<string>, frame_ids array<string>, object_names array<array<string>>, category_filter string"
)


def read_video_annotations(spark: SparkSession, path: str, split: str | None = None,
                           max_videos: int | None = None, multi_line: bool = True) -> DataFrame:
    """Annotation documents, one row per video.

    ``multi_line`` reads one document per file; without it, JSON lines, which is how a large corpus
    of small documents should be stored. ``max_videos`` takes the first files (or video ids of JSON
    lines) in sorted name order, before any category filter.
    """
    folder = f"{path}/{split}" if split else path
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    if listing.select("path").isEmpty():
        raise FileNotFoundError(f"no annotation documents in {folder}")
    docs = (
        spark.read.schema(VIDEO_SCHEMA).option("multiLine", multi_line)
        .option("pathGlobFilter", "*.json").json(folder)
    )
    if max_videos is None:
        return docs
    name = F.col("_metadata.file_name") if multi_line else F.col("video_id")
    named = docs.select("*", name.alias("_name"))
    first = named.select("_name").distinct().orderBy("_name").limit(max_videos)
    return named.join(first, "_name", "left_semi").drop("_name")


def video_detections(docs: DataFrame) -> DataFrame:
    """``(state_id, video_id, fid, pos, tid, category, name, box, size)``: one row per object of a frame.

    ``state_id`` is the frame key, which tells the frames of all videos apart.

    The subject list travels in the same document, so naming an object needs no join. The last
    subject with a track id wins and an unlisted track is called ``obj<tid>``.
    """
    frames = docs.select("video_id", "width", "height", F.col("subject/objects").alias("_subjects"),
                         F.posexplode("trajectories").alias("fid", "_objects"))
    objects = frames.select("video_id", "width", "height", "_subjects", "fid", F.posexplode("_objects").alias("pos", "_o"))
    same = F.filter(F.coalesce("_subjects", F.array()), lambda s: s["tid"] == F.col("_o.tid"))
    category = F.try_element_at(same, F.lit(-1))["category"]
    return objects.select(
        frame_key(F.col("video_id"), F.col("fid")).alias("state_id"),
        "video_id", "fid", "pos", F.col("_o.tid").alias("tid"), category.alias("category"),
        F.coalesce(category, F.concat(F.lit("obj"), F.col("_o.tid").cast("string"))).alias("name"),
        *[F.col(f"_o.bbox.{c}").alias(c) for c in ["xmin", "ymin", "xmax", "ymax"]], "width", "height",
    )


def video_subjects(docs: DataFrame) -> DataFrame:
    """``(video_id, tid, category, pos)`` in listed order."""
    listed = docs.select("video_id", F.posexplode("subject/objects").alias("pos", "_s"))
    return listed.select("video_id", F.col("_s.tid").alias("tid"), F.col("_s.category").alias("category"), "pos")


def read_array_elements(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of one array a file as rows of ``schema`` with their ``ord``; many tasks share a file."""
    values = read_json_values(spark, path, elements=True)
    return values.select(F.from_json("text", schema).alias("_v"), F.col("ordinal").alias("ord")).select("_v.*", "ord")


def read_labeled_images(spark: SparkSession, path: str, max_images: int | None = None,
                        skip_empty: bool = True, multi_line: bool = True) -> DataFrame:
    """Labelled images in source order (``ord``); the cut to ``max_images`` comes before dropping empty ones.

    ``multi_line`` reads one array a file, whose elements ``ord`` counts from 0; without it, JSON lines. Files count in the
    order of their names, whatever order they are packed into tasks.
    """
    if multi_line:
        images = read_array_elements(spark, path, IMAGE_SCHEMA)
        images = images if max_images is None else images.where(F.col("ord") < max_images)
        return without_empty(images) if skip_empty else images
    images = spark.read.schema(IMAGE_SCHEMA).json(path).withColumn("ord", F.monotonically_increasing_id())
    if max_images is not None:
        place = ["_metadata.file_path", "_metadata.file_block_start", "ord"]
        images = images.select("*", F.struct(*place).alias("_place")).orderBy("_place").limit(max_images).drop("_place")
    return without_empty(images) if skip_empty else images


def image_detections(images: DataFrame, width: Column | int | None = None, height: Column | int | None = None) -> DataFrame:
    """``(state_id, image, pos, class, category, box, size)``: one row per labelled object; the image is the state.

    The format has no image size; pass a column of ``images`` or a number where slots are to follow.
    """
    size = {n: v if isinstance(v, Column) else F.lit(v).cast("int") for n, v in (("width", width), ("height", height))}
    objects = exploded(images.withColumns({f"_{n}": v for n, v in size.items()}), "objects", "pos", "_o", ["image", "_width", "_height"])
    return objects.select(
        F.col("image").alias("state_id"), "image", "pos", F.col("_o.class").alias("class"), F.col("_o.class").alias("category"),
        *[F.col("_o.bbox")[i].alias(c) for i, c in enumerate(["xmin", "ymin", "xmax", "ymax"])],
        F.col("_width").alias("width"), F.col("_height").alias("height"),
    )


def read_vlm_answers(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Detector answers ``(image, output)``: JSON lines, or one array a file with ``multi_line``."""
    if multi_line:
        return read_array_elements(spark, path, ANSWER_SCHEMA).drop("ord")
    return spark.read.schema(ANSWER_SCHEMA).json(path)


def labelled_from_answers(answers: DataFrame) -> DataFrame:
    """Detector answers as labelled images ``(image, objects)``."""
    return answers.select("image", parse_answer_objects(F.col("output")).alias("objects"))


def normalized_detections(images: DataFrame) -> DataFrame:
    """``detections`` of normalised ``[x, y, w, h]`` boxes as corner pixels; boxless images vanish.

    ``images`` holds ``image, width, height, detections array<struct<label, bounding_box>>``.
    """
    boxes = exploded(images, "detections", "pos", "_d", ["image", "width", "height"])
    held = boxes.where(F.size("_d.bounding_box") > 0)
    corners = normalized_to_corners(F.col("_d.bounding_box"), F.col("width"), F.col("height"))
    return held.select("image", "pos", F.col("_d.label").alias("class"), corners.alias("_c")).select(
        "image", "pos", "class", "_c.*"
    )


def frames_from_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """``(video_id, fid)`` of every ``<video>/<fid:06d>.jpg`` path; other files are ignored."""
    return paths.select(parse_frame_path(F.col(path)).alias("_f")).where(F.col("_f").isNotNull()).select("_f.*")


def list_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frame listing of a folder tree; only names are read, never the image bytes."""
    return frames_from_paths(list_files(spark, folder).where(F.endswith("path", F.lit(".jpg"))))


def read_frames_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images ``(origin, height, width, channels, data)``; ``data`` holds BGR bytes row by row."""
    return spark.read.format("image").load(path).select(
        "image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data"
    )


def decode_archives(files: DataFrame, schema: str, rows_per_batch: int = 1024) -> DataFrame:
    """Rows of ``.npz`` contents ``(path, content)``: ``file``, ``row`` and the arrays named in ``schema``.

    Every named array is sliced along its first axis and flattened per row.
    """
    fields = [part.split()[0] for part in schema.split(",")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                with np.load(io.BytesIO(content)) as archive:
                    arrays = [archive[f] for f in fields]
                count = len(arrays[0])
                for start in range(0, count, rows_per_batch):
                    stop = min(count, start + rows_per_batch)
                    columns = {f: list(a[start:stop].reshape(stop - start, -1)) for f, a in zip(fields, arrays)}
                    yield pd.DataFrame({"file": file, "row": np.arange(start, stop), **columns})

    return files.select("path", "content").mapInPandas(decode, f"file string, row long, {schema}")


def read_array_archive(spark: SparkSession, path: str, schema: str, rows_per_batch: int = 1024) -> DataFrame:
    """Archives of a folder, one task per file; convert to Parquet once and read that afterwards."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    return decode_archives(files, schema, rows_per_batch)


def read_names_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(ordinal, id, object_names)`` of a saved names file; frame ids fall back to image ids."""
    saved = spark.read.schema(NAMES_SCHEMA).option("multiLine", True).json(path)
    ids = F.coalesce("frame_ids", "image_ids")
    return saved.select(F.posexplode(F.arrays_zip(ids.alias("id"), F.col("object_names"))).alias("ordinal", "_s")).select(
        "ordinal", "_s.id", "_s.object_names"
    )


def with_saved_names(states: DataFrame, saved: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Replace rebuilt names by the saved ones where the ordinal is known."""
    held = saved.select(ordinal, F.col("object_names").alias("_saved"), F.col("id").alias("_id"))
    return (
        states.join(held, ordinal, "left")
        .withColumn("object_names", F.coalesce("_saved", "object_names"))
        .withColumn("id", F.coalesce("_id", "id"))
        .drop("_saved", "_id")
    )
