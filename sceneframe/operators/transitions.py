"""Pairs of states, splits and successor tables. Everything carries ids; features join on demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sceneframe.operators.ordering import hashed_position, natural_position, stable_hash, total_rows

# Fixed values of the split rule.
TRAIN_SHARE = 0.9
VALIDATION_SHARE = 0.95
SMALL_SET = 100


def sequential_in_group(frames: DataFrame, group: str, fid: str, chunk: int = 100_000) -> DataFrame:
    """Consecutive frames of one group as ``(group, pre, suc)``; gaps in ``fid`` do not break a pair.

    ``fid`` is an integer unique inside the group, so a chunk of the frame axis holds at most
    ``chunk`` rows and a hot video spreads over many tasks. Only the first and last frame of each
    chunk meet in a window per group, which links neighbouring chunks.
    """
    keyed = frames.select(group, F.col(fid).alias("pre")).withColumn("_chunk", F.floor(F.col("pre") / F.lit(chunk)))
    inside = Window.partitionBy(group, "_chunk").orderBy("pre")
    linked = keyed.withColumn("suc", F.lead("pre").over(inside)).withColumn("_prev", F.lag("pre").over(inside))
    edges = linked.where(F.col("suc").isNull() | F.col("_prev").isNull())
    across = Window.partitionBy(group).orderBy("pre")
    stitched = (
        edges.withColumn("_next", F.lead("pre").over(across))
        .where(F.col("suc").isNull() & F.col("_next").isNotNull())
        .select(group, "pre", F.col("_next").alias("suc"))
    )
    return linked.where(F.col("suc").isNotNull()).select(group, "pre", "suc").unionByName(stitched)


def sequential_global(states: DataFrame, state: str, order: list[str]) -> DataFrame:
    """Each state with its successor in the whole source order."""
    placed = natural_position(states.select(*dict.fromkeys([state, *order])), order)
    # each row takes part as a predecessor and as the successor of the position before it
    sides = placed.select(
        F.inline(F.array(
            F.struct(F.col("position").alias("position"), F.col(state).alias("pre"), F.lit(None).cast(placed.schema[state].dataType).alias("suc")),
            F.struct((F.col("position") - 1).alias("position"), F.lit(None).cast(placed.schema[state].dataType).alias("pre"), F.col(state).alias("suc")),
        ))
    )
    return (
        sides.groupBy("position").agg(F.max("pre").alias("pre"), F.max("suc").alias("suc"))
        .where(F.col("pre").isNotNull() & F.col("suc").isNotNull())
    )


def pair_counts(states: DataFrame, group: str) -> DataFrame:
    """Number of ordered pairs of different states per group, N(N-1), without forming them."""
    return states.groupBy(group).agg(F.count("*").alias("states")).withColumn(
        "pairs", F.col("states") * (F.col("states") - 1)
    )


def gather_transitions(transitions: DataFrame, states: DataFrame, state: str, features: list[str]) -> DataFrame:
    """Features of both ends of each transition, prefixed ``pre_`` and ``suc_``."""
    pre = states.select(F.col(state).alias("pre"), *[F.col(f).alias(f"pre_{f}") for f in features])
    suc = states.select(F.col(state).alias("suc"), *[F.col(f).alias(f"suc_{f}") for f in features])
    return transitions.join(pre, "pre").join(suc, "suc")


def endpoints(transitions: DataFrame, number: str, interleaved: bool = False, total: Column | None = None,
              keep: list[str] = []) -> DataFrame:
    """Both ends of every transition in one order: all pre then all suc, or pre and suc alternating.

    ``total`` is the number of transitions when the caller knows it; it is counted otherwise. ``keep`` names columns of the
    transition that both ends carry, such as the video where state numbers restart in each video.
    """
    t = F.col(number)
    if interleaved:
        pre_at, suc_at = t * 2, t * 2 + 1
    else:
        pre_at, suc_at = t, t + (total if total is not None else total_rows(transitions))
    return transitions.select(
        *keep,
        F.inline(F.array(
            F.struct(pre_at.cast("long").alias("position"), F.col("pre").alias("state")),
            F.struct(suc_at.cast("long").alias("position"), F.col("suc").alias("state")),
        ))
    )


def split_of(position: Column, n: Column) -> Column:
    """Split name by position: the first 90 %, the next 5 %, the rest."""
    return (
        F.when(position < F.floor(n * F.lit(TRAIN_SHARE)), "train")
        .when(position < F.floor(n * F.lit(VALIDATION_SHARE)), "val")
        .otherwise("test")
    )


def positional_split(placed: DataFrame, position: str = "position", states: Column | None = None,
                     rows: Column | None = None, small_set: int | None = None) -> DataFrame:
    """Add ``split``. ``rows`` is the number of rows when known, counted otherwise.

    With ``small_set`` every row is in all three splits when there are fewer states than that (``SMALL_SET`` is the usual
    number). ``states`` counts the states when ``placed`` holds endpoints; by default its rows.
    """
    n = rows if rows is not None else total_rows(placed)
    if small_set is None:
        return placed.withColumn("_rows", n).withColumn("split", split_of(F.col(position), F.col("_rows"))).drop("_rows")
    counted = placed.withColumn("_rows", n).withColumn("_states", states if states is not None else F.col("_rows"))
    names = F.when(F.col("_states") < small_set, F.array(F.lit("train"), F.lit("val"), F.lit("test"))).otherwise(
        F.array(split_of(F.col(position), F.col("_rows")))
    )
    return counted.withColumn("split", F.explode(names)).drop("_rows", "_states")


def split_by_group(states: DataFrame, group: str, seed: int = 0) -> DataFrame:
    """Same shares, but a whole group falls into one split, so no group leaks between them."""
    share = stable_hash(group, seed=seed) / F.lit(float(1 << 60))
    return states.withColumn(
        "split",
        F.when(share < TRAIN_SHARE, "train").when(share < VALIDATION_SHARE, "val").otherwise("test"),
    )


def one_random_successor(successors: DataFrame, pre: str = "pre", suc: str = "suc", seed: int = 0) -> DataFrame:
    """One successor per state, drawn by hash; a plain aggregate, so hot states combine map-side."""
    return successors.groupBy(pre).agg(F.min_by(suc, stable_hash(pre, suc, seed=seed)).alias(suc))


def expand_successors(states: DataFrame, state: str, successors: str) -> DataFrame:
    """Every ``(pre, suc)`` of a successor list column."""
    return states.select(F.col(state).alias("pre"), F.explode(successors).alias("suc"))


def legal_transitions(observed: DataFrame, legal: DataFrame, valid: DataFrame, state: str) -> DataFrame:
    """Flag each observed ``(pre, suc)``: a known successor pair whose two states are valid."""
    known = legal.select("pre", "suc").distinct().withColumn("_known", F.lit(True))
    ok = valid.select(state).distinct()
    return (
        observed.join(known, ["pre", "suc"], "left")
        .join(ok.select(F.col(state).alias("pre"), F.lit(True).alias("_pre_ok")), "pre", "left")
        .join(ok.select(F.col(state).alias("suc"), F.lit(True).alias("_suc_ok")), "suc", "left")
        .withColumn("is_legal", F.col("_known").isNotNull() & F.col("_pre_ok").isNotNull() & F.col("_suc_ok").isNotNull())
        .drop("_known", "_pre_ok", "_suc_ok")
    )


def batches(rows: DataFrame, keys: list[str], size: int, seed: int = 0) -> DataFrame:
    """Batch number of each row after a reproducible shuffle."""
    return hashed_position(rows, keys, seed).withColumn("batch", F.floor(F.col("position") / F.lit(size)))
