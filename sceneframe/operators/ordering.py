"""Dense positions and stable hash orders without a one-task window.

Two ways to number the rows 0 .. N-1:

* ``hashed_position``: order of a keyed hash. The leading hash bits give evenly filled
  buckets that any executor recomputes identically, so nothing has to be written.
* ``natural_position``: a given order. Range partitioning splits by the whole order, so one
  hot leading key spreads over many tasks. The ranges come from a sample, therefore the
  numbered rows are written once to the shared folder before offsets are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sceneframe.session import written

HASH_BITS = 60
ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def stable_hash(*keys: Column | str, seed: int = 0) -> Column:
    """Non-negative 60-bit number from an md5 of the keys and the seed.

    It depends on values only, never on partitioning, so a retried task repeats it exactly.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def _offsets(counts: DataFrame, total: str | None) -> DataFrame:
    """Rows before each bucket and, when named, the total. One row per bucket, a fixed small number."""
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(everything))
    return offsets.drop("_n")


def hashed_position(df: DataFrame, keys: list[str], seed: int = 0, name: str = "position",
                    total: str | None = None, bucket_bits: int = 12) -> DataFrame:
    """Add the dense 0-based position in hash order. ``keys`` must identify a row.

    ``total`` names an extra column with the number of rows, known from the bucket counts.
    """
    bucket = F.shiftright(stable_hash(*keys, seed=seed), HASH_BITS - bucket_bits)
    counts = df.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("_n"))
    work = df.withColumn("_h", stable_hash(*keys, seed=seed)).withColumn(
        "_bucket", F.shiftright("_h", HASH_BITS - bucket_bits)
    )
    within = Window.partitionBy("_bucket").orderBy("_h", *keys)
    ranked = work.withColumn("_rank", F.row_number().over(within) - 1)
    # at most 2**bucket_bits offset rows, whatever the data size
    return (
        ranked.join(F.broadcast(_offsets(counts, total)), "_bucket")
        .withColumn(name, (F.col("_before") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_h", "_rank", "_before")
    )


def natural_position(df: DataFrame, order: list[str], name: str = "position", total: str | None = None,
                     partitions: int | None = None) -> DataFrame:
    """Add the dense 0-based position in the given total order, and the number of rows as ``total``.

    One shuffle and one write of ``df``; pass only the id columns and join features back later.
    The write happens when the operator is called.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = written(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id()),
        "positions",
    )
    bucket = F.shiftright("_mid", ROW_BITS)
    counts = numbered.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("_n"))
    # one offset row per range partition
    return (
        numbered.withColumn("_bucket", bucket)
        .join(F.broadcast(_offsets(counts, total)), "_bucket")
        .withColumn(name, F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
        .drop("_bucket", "_mid", "_before")
    )


def total_rows(df: DataFrame) -> Column:
    """Row count of ``df`` as a scalar subquery, evaluated inside the same job."""
    return df.agg(F.count("*").alias("n")).scalar()


def with_halo(df: DataFrame, group: str, position: str, before: int, chunk: int) -> DataFrame:
    """Copy each row into the chunk it belongs to and into the later chunks whose frames reach back to it.

    A sliding frame of ``before`` earlier rows can then run per ``(group, _chunk)``; keep the rows
    with ``_own = _chunk`` afterwards. ``position`` must be a dense ordinal inside the group, so a
    chunk holds at most ``chunk + before`` rows however large the group is.
    """
    own = F.floor(F.col(position) / F.lit(chunk))
    reach = F.floor((F.col(position) + F.lit(before)) / F.lit(chunk))
    return df.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(own, reach)))
