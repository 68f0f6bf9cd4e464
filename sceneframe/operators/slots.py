"""Objects of a state: naming, ranking into slots, unique names and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sceneframe.functions.boxes import MAX_OBJECTS


def subject_categories(subjects: DataFrame, video: str = "video_id", tid: str = "tid",
                       category: str = "category", order: list[str] = ["pos"]) -> DataFrame:
    """One category per ``(video, tid)``; the last listed one wins."""
    return subjects.groupBy(video, tid).agg(F.max_by(category, F.struct(*order)).alias(category))


def name_objects(detections: DataFrame, categories: DataFrame, video: str = "video_id", tid: str = "tid",
                 category: str = "category", name: str = "name") -> DataFrame:
    """Attach the category of the tracked subject, ``obj<tid>`` when the subject is unknown.

    No broadcast hint: Spark broadcasts only below its size threshold, otherwise AQE splits a hot
    video on the detections side of the sort-merge join.
    """
    known = categories.select(video, tid, F.col(category).alias("_category"))
    return (
        detections.join(known, [video, tid], "left")
        .withColumn(name, F.coalesce(F.col("_category"), F.concat(F.lit("obj"), F.col(tid).cast("string"))))
        .drop("_category")
    )


def frames_present(detections: DataFrame, frames: DataFrame, keys: list[str] = ["video_id", "fid"]) -> DataFrame:
    """Keep detections of frames whose image exists."""
    return detections.join(frames.select(*keys), keys, "left_semi")


def rank_slots(detections: DataFrame, state: str, area: Column, order: list[str] = ["pos"],
               k: int = MAX_OBJECTS) -> DataFrame:
    """Slots 0..k-1 by descending area, ties in input order.

    ``row_number() <= k`` becomes a partial and a final group limit, so at most ``k`` rows per state
    and input partition are shuffled even when one state holds most rows.
    """
    by_area = Window.partitionBy(state).orderBy(F.col("_area").desc(), *order)
    return (
        detections.withColumn("_area", area)
        .withColumn("_rank", F.row_number().over(by_area))
        .where(F.col("_rank") <= k)
        .withColumn("slot", (F.col("_rank") - 1).cast("int"))
        .drop("_area", "_rank")
    )


def unique_names(slots: DataFrame, state: str, category: str, name: str = "name") -> DataFrame:
    """``dog`` when the class occurs once among the kept slots, else ``dog_0, dog_1, ...`` in slot order.

    Runs on ranked slots (at most k rows per state) and reuses their partitioning by state.
    """
    # one sort serves both: the count frame spans the whole (state, class) group
    same = Window.partitionBy(state, category).orderBy("slot")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = F.row_number().over(same) - 1
    return (
        slots.withColumn("_same", F.count("*").over(whole))
        .withColumn("_nth", nth)
        .withColumn(
            name,
            F.when(F.col("_same") == 1, F.col(category)).otherwise(
                F.concat_ws("_", F.col(category), F.col("_nth").cast("string"))
            ),
        )
        .drop("_same", "_nth")
    )


def pad_slots(slots: DataFrame, state: str, zeros: list[str], name: str = "name", k: int = MAX_OBJECTS) -> DataFrame:
    """Exactly ``k`` rows per state: missing slots get zeros, the name ``pad_<slot>`` and ``is_pad``.

    Ranked slots are already partitioned by state and bounded by ``k``, so counting them needs no
    further shuffle or sort. The last real slot of a state emits the tail of a constant pad array.
    """
    types = dict(slots.dtypes)
    fields = ["slot", name, *zeros]
    real = F.struct(*[F.col(c).alias(c) for c in fields], F.lit(False).alias("is_pad"))
    pads = F.array(*[
        F.struct(
            F.lit(i).cast(types["slot"]).alias("slot"),
            F.lit(f"pad_{i}").alias(name),
            *[F.lit(0).cast(types[c]).alias(c) for c in zeros],
            F.lit(True).alias("is_pad"),
        )
        for i in range(k)
    ])
    counted = slots.withColumn("_n", F.count("*").over(Window.partitionBy(state)).cast("int"))
    tail = F.when(F.col("slot") == F.col("_n") - 1, F.slice(pads, F.col("_n") + 1, F.lit(k))).otherwise(
        F.slice(pads, 1, 0)
    )
    return counted.select(state, F.inline(F.concat(F.array(real), tail)))


def explode_subset(df: DataFrame, array: str, position: str, element: str) -> DataFrame:
    """Rows of an array column with their position; states with an empty array vanish."""
    return df.select("*", F.posexplode(array).alias(position, element)).drop(array)


def skip_empty(images: DataFrame, objects: str = "objects") -> DataFrame:
    """Drop images or frames whose object array is empty or null."""
    return images.where(F.size(F.coalesce(F.col(objects), F.array())) > 0)


def label_subset(df: DataFrame, label: str, labels: list) -> DataFrame:
    return df.where(F.col(label).isin(list(labels)))


def bind_names(bindings: DataFrame, slots: DataFrame, state: str, obj: str, name: str = "name") -> DataFrame:
    """Name of the bound object of each state, ``obj_<i>`` when that slot has no name."""
    names = slots.select(state, F.col("slot").alias(obj), F.col(name).alias("_name"))
    return (
        bindings.join(names, [state, obj], "left")
        .withColumn("argument_name", F.coalesce(F.col("_name"), F.concat(F.lit("obj_"), F.col(obj).cast("string"))))
        .drop("_name")
    )


def state_names(states: DataFrame, names: DataFrame | list[str], state: str, column: str = "object_names") -> DataFrame:
    """Attach object names: per state from a table, or one shared list for every state."""
    if isinstance(names, DataFrame):
        return states.join(names.select(state, column), state, "left")
    return states.withColumn(column, F.array(*[F.lit(n) for n in names]))
