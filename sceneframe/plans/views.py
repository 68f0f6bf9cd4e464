"""Stand-in views: the given tables read in the shapes of the scene data model.

Each Spark view has a DuckDB text of the same name in upper case, used by the oracles.
No view needs a window, so a hot key costs nothing here.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

from sceneframe.functions.arrays import exploded
from sceneframe.functions.codes import unit_slice
from sceneframe.operators.profile import appearance


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """One row per object: a line of an order. ``p1, p2, p3`` order the objects of a state."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("state_id"),
        (F.col("l_orderkey") % 50).alias("video_id"),
        F.col("l_orderkey").alias("fid"),
        F.col("l_linenumber").alias("p1"), F.col("l_partkey").alias("p2"), F.col("l_suppkey").alias("p3"),
        F.col("l_linenumber").alias("tid"),
        (F.col("l_quantity").cast("long") * 10).alias("xmin"),
        F.round(F.col("l_discount") * 1000).cast("long").alias("ymin"),
        (F.col("l_quantity").cast("long") * 10 + F.floor(F.col("l_extendedprice") / 300)).alias("xmax"),
        (F.round(F.col("l_discount") * 1000).cast("long") + F.round(F.col("l_tax") * 5000).cast("long") + 20).alias("ymax"),
        F.lit(900).alias("width"),
        F.lit(600).alias("height"),
    )
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("p2"), F.col("p_type").alias("category"))
    return lines.join(part, "p2")


ORDER = ["p1", "p2", "p3"]


def seen_first():
    """Appearance key of a detection; the position is packed from its three parts."""
    p1, p2, p3 = (F.col(c).cast("decimal(38,0)") for c in ORDER)
    position = p1 * F.lit(Decimal(10 ** 21)) + p2 * F.lit(Decimal(10 ** 10)) + p3
    return appearance(F.col("fid"), position, 22)


DETECTIONS = """
detections as (
  select l_orderkey as state_id, l_orderkey % 50 as video_id, l_orderkey as fid,
         l_linenumber as p1, l_partkey as p2, l_suppkey as p3,
         l_linenumber as tid, p_type as category,
         cast(l_quantity as bigint)*10 as xmin,
         cast(round(l_discount*1000) as bigint) as ymin,
         cast(l_quantity as bigint)*10 + cast(floor(l_extendedprice/300) as bigint) as xmax,
         cast(round(l_discount*1000) as bigint) + cast(round(l_tax*5000) as bigint) + 20 as ymax,
         900 as width, 600 as height
  from lineitem join part on l_partkey = p_partkey)"""


def subjects(spark: SparkSession, sf: str) -> DataFrame:
    """Listed subjects of each video with repeated tracks; track 7 is never listed."""
    return (
        detections(spark, sf).where(F.col("tid") != 7)
        .select("video_id", "tid", "category", "fid", *ORDER)
    )


SUBJECTS = """
subjects as (select video_id, tid, category, fid, p1, p2, p3 from detections where tid <> 7)"""

CATEGORIES = """
categories as (
  select video_id, tid, category from (
    select *, row_number() over (partition by video_id, tid order by fid desc, p1 desc, p2 desc, p3 desc) as r
    from subjects) where r = 1)"""

PRIMARIES = """
tracks as (
  select video_id, tid, count(*) as n, sum((xmax-xmin)*(ymax-ymin)) as area, min((fid, p1, p2, p3)) as first_seen
  from detections group by video_id, tid),
primaries as (
  select t.video_id, c.category as primary_category from (
    select *, row_number() over (partition by video_id order by n desc, area desc, first_seen) as r from tracks) t
  left join categories c on t.video_id = c.video_id and t.tid = c.tid where r = 1)"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of a video: the events of a user."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("fid"),
        (F.col("event_type") != "error").alias("has_jpg"), F.col("event_type").alias("category"),
    )


FRAMES = """
frames as (select user_id as video_id, event_id as fid, event_type <> 'error' as has_jpg,
                  event_type as category from events)"""


def vlm_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Detector answers with a prompt, a fence, a trailing comma and a truncated tail."""
    e = F.col("event_id").cast("string")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("image"),
        F.concat(
            F.lit('<|im_start|>user list<|im_end|><|im_start|>assistant ```json [{"class":"'), F.col("event_type"),
            F.lit('","bbox_2d":['), (F.col("event_id") % 900).cast("string"),
            F.lit(',10,990,500],},{"label":"x'), e,
            F.lit('","bbox":[1,2,3,4]},{"label":"","class":"'), F.col("event_type"),
            F.lit('","bbox_2d":[],"bbox":['), e,
            F.lit(',2]},{"bad" 1},{"class":"nobox"},{"class":"cut","bbox_2d":[1,'),
        ).alias("output"),
    )


VLM = """
answers as (select event_id as image, event_type as et from events)"""


def codes(spark: SparkSession, sf: str) -> DataFrame:
    """Encoder output: 64 bits per state (8 units of 8 predicates) and the action taken."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("state_id"), F.col("label").alias("action"),
        F.transform("embedding", lambda x: (x > 0).cast("int")).alias("bits"),
    )


CODES = """
codes as (select vec_id as state_id, label as action, i as idx, cast(embedding[i+1] > 0 as int) as bit
          from embeddings, range(64) t(i))"""


def attention(spark: SparkSession, sf: str) -> DataFrame:
    """Attention of 4 units with 2 arguments over 8 objects, as nested arrays."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("state_id"),
        F.array(*[
            F.array(*[F.slice(e, u * 16 + a * 8 + 1, 8).cast("array<double>") for a in range(2)]) for u in range(4)
        ]).alias("attention"),
    )


ATTENTION = """
attention as (select vec_id as state_id, i // 16 as unit, (i // 8) % 2 as arg, i % 8 as obj,
                     cast(embedding[i+1] as double) as w from embeddings, range(64) t(i))"""


def transition_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of both ends: state ``i`` and ``i + 1`` under the action of ``i``."""
    c = codes(spark, sf)
    suc = c.select((F.col("state_id") - 1).alias("state_id"), F.col("bits").alias("suc"))
    return c.join(suc, "state_id").select(F.col("state_id").alias("pre_id"), "action", F.col("bits").alias("pre"), "suc")


TRANSITION_CODES = CODES + """,
tcodes as (select a.state_id as pre_id, a.action, a.idx, a.bit as pre, b.bit as suc
           from codes a join codes b on b.state_id = a.state_id + 1 and b.idx = a.idx)"""


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """8 x 8 images, one row per pixel."""
    return (
        table(spark, sf, "embeddings").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("idx", "v"))
        .select("img", F.floor(F.col("idx") / 8).cast("int").alias("y"), (F.col("idx") % 8).alias("x"),
                F.col("v").cast("double").alias("v"))
    )


PIXELS = """
pixels as (select vec_id as img, cast(i // 8 as int) as y, cast(i % 8 as int) as x,
                  cast(embedding[i+1] as double) as v from embeddings, range(64) t(i))"""


def epoch_log(spark: SparkSession, sf: str) -> DataFrame:
    """Training curves: runs of 100 epochs."""
    return table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 100).alias("run"), (F.col("event_id") % 100).alias("epoch"),
        (F.col("value") / 500).alias("val_loss"),
    )


EPOCH_LOG = """
epoch_log as (select event_id // 100 as run, event_id % 100 as epoch, value/500 as val_loss from events)"""


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """Trial table: an evaluation and a config of three keys."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("trial"), F.col("p_retailprice").alias("eval"),
        F.create_map(
            F.lit("u"), F.col("p_brand"), F.lit("a"), F.col("p_type"), F.lit("p"), F.col("p_size").cast("string")
        ).alias("config"),
    )


TRIALS = """
trials as (select p_partkey as trial, p_retailprice as eval, p_brand as u, p_type as a,
                  cast(p_size as varchar) as p from part)"""


def bits_long(df: DataFrame, column: str, name: str, keep: list[str]) -> DataFrame:
    return exploded(df, column, "idx", name, keep)


def units(spark: SparkSession, sf: str, n: int = 8, predicates: int = 8) -> DataFrame:
    """Codes with one array per unit."""
    return codes(spark, sf).select(
        "state_id", "action", F.array(*[unit_slice(F.col("bits"), u, predicates) for u in range(n)]).alias("units")
    )
