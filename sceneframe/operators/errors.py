"""Reconstruction errors, order-free set distances and the metric report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.operators.bits import bit_stats, row_mean

EPSILON = 1e-7   # fixed value: clip of the plain cross entropy
TIGHT = 1e-8     # fixed value: clip of the rank-dependent cross entropy


def clip(value: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(value, F.lit(lo)), F.lit(hi))


def cross_entropy(true: Column, pred: Column) -> Column:
    """Element cross entropy with both logarithm arguments clipped to [1e-7, 1]."""
    return -(true * F.log(clip(pred, EPSILON, 1.0)) + (1 - true) * F.log(clip(1 - pred, EPSILON, 1.0)))


def bounded_cross_entropy(true: Column, pred: Column) -> Column:
    """Element cross entropy with the prediction clipped to [1e-7, 1 - 1e-7]."""
    p = clip(pred, EPSILON, 1 - EPSILON)
    return -(true * F.log(p) + (1 - true) * F.log(1 - p))


def absolute_error(true: Column, pred: Column) -> Column:
    return F.abs(true - pred)


def squared_error(true: Column, pred: Column) -> Column:
    return (true - pred) * (true - pred)


def error_metrics(rows: DataFrame, true: str, pred: str, axis: str | None = None, by: list[str] = []) -> DataFrame:
    """BCE, MAE and MSE over all elements, or per element position with ``axis='feature'``.

    Elements are exploded inside the stage and averaged map-side.
    """
    pairs = rows.select(*by, F.posexplode(F.arrays_zip(F.col(true).alias("t"), F.col(pred).alias("p"))).alias("idx", "_e"))
    t, p = F.col("_e.t"), F.col("_e.p")
    keys = by + (["idx"] if axis == "feature" else [])
    return pairs.groupBy(*keys).agg(
        F.avg(cross_entropy(t, p)).alias("bce"), F.avg(absolute_error(t, p)).alias("mae"), F.avg(squared_error(t, p)).alias("mse")
    )


def _row_sum(true: Column, pred: Column, element: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(true, pred, element), F.lit(0.0), lambda acc, v: acc + v)


def sum_errors(true: Column, pred: Column) -> Column:
    """Per row: summed cross entropy and summed squared error."""
    return F.struct(
        _row_sum(true, pred, bounded_cross_entropy).alias("bce2"), _row_sum(true, pred, squared_error).alias("se")
    )


def mean_errors(true: Column, pred: Column) -> Column:
    """Per row: mean cross entropy, squared and absolute error."""
    return F.struct(
        row_mean(F.zip_with(true, pred, bounded_cross_entropy)).alias("bce"),
        row_mean(F.zip_with(true, pred, squared_error)).alias("mse"),
        row_mean(F.zip_with(true, pred, absolute_error)).alias("mae"),
    )


def ranked_cross_entropy(true: Column, pred: Column, categorical: bool) -> Column:
    """Per row, both sides clipped to [1e-8, 1 - 1e-8]: categorical for one-hot groups, else binary mean."""
    t = F.transform(true, lambda v: clip(v, TIGHT, 1 - TIGHT))
    p = F.transform(pred, lambda v: clip(v, TIGHT, 1 - TIGHT))
    if not categorical:
        return row_mean(F.zip_with(t, p, bounded_cross_entropy))
    total = F.aggregate(p, F.lit(0.0), lambda acc, v: acc + v)
    return _row_sum(t, F.transform(p, lambda v: clip(v / total, EPSILON, 1 - EPSILON)), lambda a, b: -a * F.log(b))


def set_distance(x: Column, y: Column, element: Callable[[Column, Column], Column] = squared_error) -> Column:
    """Distances between two object sets of a state, each an array of feature arrays.

    The distance of two objects sums ``element`` over features. Sets hold at most one object per
    slot, so every nearest distance is found inside the row and nothing is joined.
    """
    def pair(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, element), F.lit(0.0), lambda acc, v: acc + v)

    from_x = F.transform(x, lambda a: F.array_min(F.transform(y, lambda b: pair(a, b))))
    from_y = F.transform(y, lambda b: F.array_min(F.transform(x, lambda a: pair(a, b))))
    return F.struct(from_x.alias("x"), from_y.alias("y"))


def set_distances(states: DataFrame, x: str, y: str, element: Callable[[Column, Column], Column] = squared_error) -> DataFrame:
    """Mean over states of the Hausdorff and sum-of-minima distances and their directed forms."""
    near = states.select(set_distance(F.col(x), F.col(y), element).alias("_d"))

    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)

    per_state = near.select(
        F.array_max("_d.x").alias("hx"), F.array_max("_d.y").alias("hy"), total("_d.x").alias("sx"), total("_d.y").alias("sy")
    )
    return per_state.agg(
        F.avg(F.greatest("hx", "hy")).alias("hausdorff"), F.avg("hx").alias("directed_hausdorff_1"),
        F.avg("hy").alias("directed_hausdorff_2"), F.avg(F.greatest("sx", "sy")).alias("sum_min"),
        F.avg("sx").alias("directed_sum_min_1"), F.avg("sy").alias("directed_sum_min_2"),
    )


def metric_report(rows: DataFrame, metrics: dict[str, Column], by: list[str] = ["variant", "split"]) -> DataFrame:
    """Long report ``(metric, by..., value)``; each metric is an aggregate column, all in one pass."""
    wide = rows.groupBy(*by).agg(*[m.cast("double").alias(name) for name, m in metrics.items()])
    return wide.unpivot(by, list(metrics), "metric", "value")


def model_report(predictions: DataFrame, true: str, pred: str, bits: str, by: list[str] = ["variant", "split"]) -> DataFrame:
    """The standard report: error metrics and bit statistics per variant and split."""
    errors = error_metrics(predictions, true, pred, by=by)
    stats = bit_stats(predictions, bits, by=by)
    return errors.unpivot(by, ["bce", "mae", "mse"], "metric", "value").unionByName(
        stats.unpivot(by, ["activation", "ever_1", "ever_0", "effective"], "metric", "value")
    )


def metric_tree(report: DataFrame) -> DataFrame:
    """The report as one JSON object per metric: variant -> split -> value."""
    splits = report.groupBy("metric", "variant").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "value")))).alias("_s"))
    variants = splits.groupBy("metric").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", F.to_json("_s").alias("j"))))).alias("_v"))
    entries = F.transform(F.map_entries("_v"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return variants.select("metric", F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")).alias("tree"))


def order_sensitivity(states: DataFrame, objects: str, target: str, permutation: list[int],
                      element: Callable[[Column, Column], Column] = squared_error) -> DataFrame:
    """Mean error against ``target`` with the objects in order and under one shared permutation."""
    from sceneframe.operators.noise import shuffle_object_array

    flat_target = F.flatten(target)
    errors = states.select(
        row_mean(F.zip_with(F.flatten(objects), flat_target, element)).alias("ordered"),
        row_mean(F.zip_with(F.flatten(shuffle_object_array(F.col(objects), permutation)), flat_target, element)).alias("shuffled"),
    )
    means = errors.agg(F.avg("ordered").alias("ordered"), F.avg("shuffled").alias("shuffled"))
    return means.unpivot([], ["ordered", "shuffled"], "variant", "value")
