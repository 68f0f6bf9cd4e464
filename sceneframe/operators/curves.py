"""Training curves: stopping rules over sliding windows of epochs and scheduled values.

Epochs of a run may have gaps and start anywhere; windows count observations. They run over chunks of a run with a halo
of the preceding observations, so a very long run spreads over many tasks and the result does not depend on the chunk.
Medians over windows longer than ``LONG_WINDOW`` come from an ordered structure that moves with the window instead of a
percentile that is built anew for each row; the result is the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sceneframe.operators.ordering import with_halo

# Defaults of the rules.
SAMPLE = 20
SMOOTH = 3
PLATEAU = 0.001
MIN_GRADIENT = -0.0001
HIGH_VALUE = 0.2
DELAY_MARGIN = 0.1

LONG_WINDOW = 64


def _numbered(log: DataFrame, run: str, epoch: str, chunk: int) -> DataFrame:
    """Add ``_at``, the 0-based number of each observation in its run.

    Observations are counted per chunk of the epoch axis; only the counts of a run, one per chunk, meet in one window.
    """
    placed = log.withColumn("_part", F.floor(F.col(epoch) / F.lit(chunk)))
    before = Window.partitionBy(run).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(run, "_part").agg(F.count("*").alias("_n")).select(
        run, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(run, "_part").orderBy(epoch)) - 1
    return placed.withColumn("_rank", rank).join(counts, [run, "_part"]).withColumn("_at", F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before")


def _first_firing(log: DataFrame, run: str, epoch: str, value: str, fires, start: Column | float, sample: int,
                  chunk: int, prepare=None) -> DataFrame:
    """First epoch of each run where ``fires(window)`` holds; null when it never does.

    ``prepare`` adds columns that ``fires`` needs to the chunks with their halos.

    A rule needs more than ``sample`` observations of the run.
    """
    spread = with_halo(_numbered(log.select(run, epoch, value), run, epoch, chunk), run, "_at", sample - 1, chunk)
    spread = prepare(spread) if prepare else spread
    window = Window.partitionBy(run, "_chunk").orderBy("_at")
    judged = spread.withColumn("_fires", fires(window)).where(F.col("_own") == F.col("_chunk"))
    begin = start if isinstance(start, Column) else F.lit(start)
    stop = F.when(F.col("_fires") & (F.col("_at") >= sample) & (F.col(epoch) >= begin), F.col(epoch))
    return judged.groupBy(run).agg(F.min(stop).alias("stop_epoch"))


def plateau_stop(log: DataFrame, run: str, epoch: str, value: str, threshold: float = PLATEAU, start=0,
                 sample: int = SAMPLE, chunk: int = 100_000) -> DataFrame:
    """Stops when the last values differ by at most ``threshold``."""
    def fires(w):
        last = w.rowsBetween(-(sample - 1), 0)
        return F.max(value).over(last) - F.min(value).over(last) <= threshold

    return _first_firing(log, run, epoch, value, fires, start, sample, chunk)


def gradient_stop(log: DataFrame, run: str, epoch: str, value: str, min_gradient: float = MIN_GRADIENT,
                  sample: int = SAMPLE, smooth: int = SMOOTH, chunk: int = 100_000) -> DataFrame:
    """Stops when the smoothed descent over the window is no steeper than ``min_gradient``."""
    def fires(w):
        newest = F.avg(value).over(w.rowsBetween(-(smooth - 1), 0))
        oldest = F.avg(value).over(w.rowsBetween(-(sample - 1), -(sample - smooth)))
        return (newest - oldest) / sample >= min_gradient

    return _first_firing(log, run, epoch, value, fires, 0, sample, chunk)


def sliding_median(values: np.ndarray, known: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the last ``sample`` places at each place, and where there is one; only ``known`` values count.

    Values are ranked once, NaN last; the window keeps its ranks in order while they come and go, a logarithm of its length each.
    """
    levels, rank = np.unique(values[known], return_inverse=True)
    places = np.full(len(values), np.nan)
    places[known] = rank
    window = pd.Series(places).rolling(sample, min_periods=1)
    low, high = (window.quantile(0.5, interpolation=side).to_numpy() for side in ("lower", "higher"))
    there = ~np.isnan(low)
    median = np.full(len(values), np.nan)
    below, above = levels[low[there].astype(np.int64)], levels[high[there].astype(np.int64)]
    median[there] = np.where(below == above, below, 0.5 * below + 0.5 * above)
    return median, there


def _with_median(spread: DataFrame, run: str, value: str, sample: int) -> DataFrame:
    """Add ``_median`` of the last ``sample`` observations; a group is one chunk and its halo."""
    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        column = table.column(value).cast(pa.float64())
        known = column.is_valid().to_numpy(zero_copy_only=False)
        median, there = sliding_median(column.to_numpy(zero_copy_only=False), known, sample)
        return table.append_column("_median", pa.array(median, mask=~there))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema)
    return spread.groupBy(run, "_chunk").applyInArrow(add, f"{fields}, _median double")


def _median_stop(log: DataFrame, run: str, epoch: str, value: str, bound: Column, start, sample: int, chunk: int) -> DataFrame:
    """Stops when the median of the last values is at least ``bound``."""
    if sample > LONG_WINDOW:
        return _first_firing(log, run, epoch, value, lambda w: F.col("_median") >= bound, start, sample, chunk,
                             lambda spread: _with_median(spread, run, value, sample))
    median = F.percentile(value, 0.5)
    return _first_firing(log, run, epoch, value, lambda w: median.over(w.rowsBetween(-(sample - 1), 0)) >= bound, start, sample, chunk)


def high_value_stop(log: DataFrame, run: str, epoch: str, value: str, threshold: float = HIGH_VALUE, start=0,
                    sample: int = SAMPLE, chunk: int = 100_000) -> DataFrame:
    """Stops when the median of the last values is at least ``threshold``."""
    return _median_stop(log, run, epoch, value, F.lit(threshold), start, sample, chunk)


def linear_bound_stop(log: DataFrame, run: str, epoch: str, value: str, epoch_end: float, start: float = 0,
                      value_start: float = 1.0, value_end: float = 0.0, sample: int = SAMPLE, chunk: int = 100_000) -> DataFrame:
    """Stops when the median of the last values reaches a bound that falls linearly over the epochs."""
    slope = (value_end - value_start) / (epoch_end - start)
    bound = F.lit(value_start) + F.lit(slope) * (F.col(epoch) - F.lit(start))
    return _median_stop(log, run, epoch, value, bound, start, sample, chunk)


def stop_start(config: Column, epochs: Column | float) -> Column:
    """First epoch a rule may fire: epochs times the largest delay of the config plus a margin."""
    delays = F.map_filter(config, lambda k, v: F.contains(k, F.lit("delay")))
    largest = F.greatest(F.lit(0.0), F.array_max(F.transform(F.map_values(delays), lambda v: v.cast("double"))))
    return (F.coalesce(largest, F.lit(0.0)) + F.lit(DELAY_MARGIN)) * epochs


def step_schedule(epoch: Column, schedule: dict[float, float]) -> Column:
    """Value of the last breakpoint reached; before the first one, its value."""
    keys = sorted(schedule, reverse=True)
    chain = F.when(epoch >= keys[0], F.lit(float(schedule[keys[0]])))
    for key in keys[1:]:
        chain = chain.when(epoch >= key, F.lit(float(schedule[key])))
    return chain.otherwise(F.lit(float(schedule[keys[-1]])))


def linear_schedule(epoch: Column, schedule: dict[float, float]) -> Column:
    """Piecewise-linear value between breakpoints, constant outside them."""
    keys = sorted(schedule, reverse=True)
    chain = F.when(epoch >= keys[0], F.lit(float(schedule[keys[0]])))
    for above, key in zip(keys, keys[1:]):
        rise = (schedule[key] - schedule[above]) / (key - above)
        chain = chain.when(epoch >= key, F.lit(float(schedule[above])) + (epoch - F.lit(above)) * F.lit(float(rise)))
    return chain.otherwise(F.lit(float(schedule[keys[-1]])))


def annealed_value(epoch: Column, low: float, high: float, full: float, offset: float = 0) -> Column:
    """Exponential decay from ``high``, reaching ``low`` at epoch ``full`` and held there."""
    rate = F.log(F.lit(high / low)) / F.lit(float(full - offset))
    return F.greatest(F.lit(float(low)), F.lit(float(high)) * F.exp(-rate * F.greatest(epoch - F.lit(offset), F.lit(0))))
