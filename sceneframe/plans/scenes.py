"""The scene plan: detections -> named, ranked, padded slots -> canvas boxes and grid bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sceneframe.functions.boxes import MAX_OBJECTS, box_area, canvas_box, grid_bin
from sceneframe.operators.slots import pad_slots, rank_slots, unique_names

BINS = ["x1b", "y1b", "x2b", "y2b"]


def raw_area():
    return box_area(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))


def scene_slots(detections: DataFrame, state: str = "state_id", category: str = "category",
                order: list[str] = ["pos"], unique: bool = True, k: int = MAX_OBJECTS) -> DataFrame:
    """The ``k`` largest named, binned and padded objects of every state, in one shuffle by state."""
    ranked = rank_slots(detections, state, raw_area(), order, k)
    named = unique_names(ranked, state, category) if unique else ranked.withColumn("name", F.col(category))
    box = canvas_box(*[F.col(c) for c in ["xmin", "ymin", "xmax", "ymax", "width", "height"]])
    binned = named.withColumn("_box", box).select(
        state, "slot", "name", *[grid_bin(F.col(f"_box.{c}")).alias(b) for c, b in zip(["cx1", "cy1", "cx2", "cy2"], BINS)]
    )
    return pad_slots(binned, state, BINS, "name", k)
