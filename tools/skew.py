"""Time operators on even and on skewed keys: python tools/skew.py [copies of lineitem].

The skewed input gives one key a third of all rows. A hot key that lands in one task shows as a
multiple of the even time; work that is split or combined early shows about the same time.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import functions as F  # noqa: E402

from bench import session  # noqa: E402
from sceneframe.operators import curves, ordering, profile, slots, transitions  # noqa: E402
from sceneframe.plans.scenes import scene_slots  # noqa: E402
from sceneframe.session import scratch_path  # noqa: E402


def main(copies: int) -> None:
    spark = session(8)
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    path = scratch_path(spark, "skew")
    lines.withColumn("row", F.monotonically_increasing_id()).repartition(32).write.parquet(path)
    base = spark.read.parquet(path)

    def data(hot: bool):
        key = F.col("l_orderkey") * copies + F.col("copy")
        state = F.when(F.col("row") % 3 == 0, F.lit(-1)).otherwise(key) if hot else key
        return base.select(
            state.alias("state_id"), state.alias("video_id"), F.col("row").alias("fid"), F.col("row").alias("pos"),
            (F.col("l_partkey") % 50).alias("tid"), F.concat(F.lit("c"), (F.col("l_suppkey") % 9).cast("string")).alias("category"),
            F.col("l_linenumber").alias("xmin"), F.lit(0).alias("ymin"), (F.col("l_linenumber") + F.col("l_partkey") % 700).alias("xmax"),
            (F.col("l_suppkey") % 500).alias("ymax"), F.lit(900).alias("width"), F.lit(600).alias("height"), F.col("l_quantity").alias("v"))

    jobs = {
        "scene_slots": lambda d: scene_slots(d),
        "sequential_in_group": lambda d: transitions.sequential_in_group(d, "video_id", "fid"),
        "primary_category": lambda d: profile.primary_category(d, slots.subject_categories(d)),
        "name_objects": lambda d: slots.name_objects(d, slots.subject_categories(d)),
        "natural_position": lambda d: ordering.natural_position(d.select("state_id", "fid"), ["state_id", "fid"], partitions=32),
        "hashed_position": lambda d: ordering.hashed_position(d.select("state_id", "fid"), ["fid"]),
    }
    for name, job in jobs.items():
        took = {}
        for hot in (False, True):
            d = data(hot)
            start = time.time()
            job(d).write.format("noop").mode("overwrite").save()
            took[hot] = time.time() - start
        print(f"{name:22s} even {took[False]:6.1f}s  hot {took[True]:6.1f}s", flush=True)
    n = base.count()
    for hot in (False, True):
        length = n // 3 if hot else 1000
        ids = spark.range(n)
        log = ids.select(F.floor(F.col("id") / length).alias("run"), (F.col("id") % length).alias("epoch"), (F.xxhash64("id") % 1000 / 1000.0).alias("v"))
        start = time.time()
        curves.plateau_stop(log, "run", "epoch", "v").write.format("noop").mode("overwrite").save()
        print(f"plateau_stop           {'hot ' if hot else 'even'} {time.time() - start:6.1f}s", flush=True)


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 20)
