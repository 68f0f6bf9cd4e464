"""Pixel operators. Images are long tables ``(img, y, x, v)`` or arrays per object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sceneframe.functions.arrays import exploded, held
from sceneframe.functions.boxes import PATCH_SIZE, onehot_boxes

BINS = 256  # fixed value: histogram bins of the equalization


def scale_pixels(value: Column) -> Column:
    return value.cast("double") / F.lit(256)


def binarize_pixels(value: Column) -> Column:
    """0..255 to 0/1, half to even."""
    return F.rint(value / F.lit(255)).cast("int")


def enhance_contrast(value: Column) -> Column:
    return F.least(F.greatest((value - F.lit(0.5)) * 3, F.lit(-0.5)), F.lit(0.5)) + F.lit(0.5)


def _value_range(df: DataFrame, value: str) -> Column:
    """``struct<lo, hi>`` of the whole table as a scalar subquery."""
    return df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).select(
        F.struct("lo", "hi")
    ).scalar()


def normalize_pixels(df: DataFrame, value: str = "v", name: str = "v") -> DataFrame:
    """Global min-max to 0..1; a constant table becomes all zero."""
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    scaled = F.when(hi == lo, F.col(value) - lo).otherwise((F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return df.withColumn("_b", _value_range(df, value)).withColumn(name, scaled).drop("_b")


def cdf(histogram: DataFrame, bin: str = "bin", n: str = "n") -> DataFrame:
    """Share of values up to each bin. The histogram has a fixed number of rows, so one ordered window is fine."""
    up_to = Window.orderBy(bin).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return histogram.withColumn("cdf", F.sum(n).over(up_to) / F.sum(n).over(everything))


def histogram(df: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """Counts of equal-width bins over the value range, the last one closed; every bin appears."""
    ranged = df.select(value).withColumn("_b", _value_range(df, value))
    lo, hi = F.col("_b.lo"), F.col("_b.hi")
    bin = F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / F.nullif((hi - lo) / bins, F.lit(0.0)))).cast("int")
    counted = ranged.groupBy(F.when(hi == lo, F.lit(0)).otherwise(bin).alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def _curve(shares: DataFrame) -> Column:
    """The CDF as one array value in bin order."""
    ordered = F.array_sort(F.collect_list(F.struct("bin", "cdf")))
    return shares.agg(F.transform(ordered, lambda s: s["cdf"]).alias("c")).scalar()


def _interpolated(value: Column, lo: Column, hi: Column, curve: Column, bins: int) -> Column:
    """CDF at ``value`` by linear interpolation between bin centres; 0.5 when all values are equal."""
    t = (value - lo) / F.nullif((hi - lo) / bins, F.lit(0.0)) - F.lit(0.5)
    k = F.least(F.greatest(F.floor(t), F.lit(0)), F.lit(bins - 2)).cast("int")
    f = F.least(F.greatest(t - k, F.lit(0.0)), F.lit(1.0))
    return F.when(hi == lo, F.lit(0.5)).otherwise(F.get(curve, k) * (1 - f) + F.get(curve, k + 1) * f)


def equalize_histogram(df: DataFrame, value: str = "v", name: str = "v", bins: int = BINS) -> DataFrame:
    """Histogram equalization over the whole table.

    Two small subqueries, the value range and the ``bins``-long CDF array, feed one projection:
    linear interpolation between bin centres. The pixels themselves are never shuffled.
    """
    level = _interpolated(F.col(value), F.col("_b.lo"), F.col("_b.hi"), F.col("_c"), bins)
    return _with_curve(df, df, value, bins).withColumn(name, level).drop("_b", "_c")


def _with_curve(df: DataFrame, values: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """Attach the value range ``_b`` and the CDF array ``_c`` of ``values``, each one subquery."""
    return df.withColumn("_b", _value_range(values, value)).withColumn("_c", _curve(cdf(histogram(values, value, bins))))


def _preprocessed(level: Column, first: Column) -> Column:
    """Normalised and enhanced level; all zero when every value is equal.

    Equalized values rise with the CDF, whose last entry is 1 and whose first is the share of the
    first bin, so the normalisation range is known without a third scan.
    """
    unit = F.when(first == 1, F.lit(0.0)).otherwise((level - first) / F.nullif(1 - first, F.lit(0.0)))
    return enhance_contrast(unit)


def _pixel_level(value: Column) -> Column:
    level = _interpolated(value, F.col("_b.lo"), F.col("_b.hi"), F.col("_c"), BINS)
    return _preprocessed(level, F.get(F.col("_c"), F.lit(0)))


def preprocess(df: DataFrame, value: str = "v", name: str = "v") -> DataFrame:
    """Equalize, normalise and enhance a pixel table."""
    return _with_curve(df, df, value).withColumn(name, _pixel_level(F.col(value))).drop("_b", "_c")


def preprocess_patches(df: DataFrame, patch: str = "patch", name: str = "patch") -> DataFrame:
    """The same over array columns: one patch array per row, one histogram for the whole table.

    Values are exploded only to be counted (256 rows per task leave the stage); the patches are
    rewritten in place.
    """
    values = df.select(F.explode(patch).alias("v"))
    return _with_curve(df, values, "v").withColumn(name, F.transform(patch, _pixel_level)).drop("_b", "_c")


def block_mean_downsample(df: DataFrame, step_y: int, step_x: int, height: int, width: int,
                          img: str = "img", value: str = "v") -> DataFrame:
    """Mean of ``step_y x step_x`` blocks after trimming the remainder."""
    inside = (F.col("y") < height - height % step_y) & (F.col("x") < width - width % step_x)
    return (
        df.where(inside)
        .groupBy(img, F.floor(F.col("y") / step_y).cast("int").alias("y"), F.floor(F.col("x") / step_x).cast("int").alias("x"))
        .agg(F.avg(value).alias(value))
    )


def stride_downsample(df: DataFrame, step_y: int, step_x: int, value: str = "v") -> DataFrame:
    """Every k-th pixel of both axes, rounded half to even."""
    return (
        df.where((F.col("y") % step_y == 0) & (F.col("x") % step_x == 0))
        .withColumn("y", F.floor(F.col("y") / step_y).cast("int"))
        .withColumn("x", F.floor(F.col("x") / step_x).cast("int"))
        .withColumn(value, F.rint(value))
    )


def split_tiles(df: DataFrame, rows: int, columns: int, height: int, width: int) -> DataFrame:
    """Tile number and local coordinates of each pixel; pixels beyond the equal tiles are trimmed."""
    tile_h, tile_w = height // rows, width // columns
    return (
        df.where((F.col("y") < tile_h * rows) & (F.col("x") < tile_w * columns))
        .withColumn("tile", (F.floor(F.col("y") / tile_h) * columns + F.floor(F.col("x") / tile_w)).cast("int"))
        .withColumn("y", F.col("y") % tile_h)
        .withColumn("x", F.col("x") % tile_w)
    )


def assemble_state(slots: DataFrame, patch: str = "patch", bins: tuple[str, ...] = ("x1b", "y1b", "x2b", "y2b")) -> DataFrame:
    """Feature vector of a slot: patch pixels followed by the box one-hots."""
    code = onehot_boxes(*[F.col(b) for b in bins], kind="double")
    return slots.withColumn("features", F.concat(F.col(patch), code))


def _taps(n: Column, size: int) -> Column:
    """For each of ``size`` pixel centres the two of ``n`` pixels around it and the share of the second: one row of a sparse matrix."""
    top = n - 1

    def tap(i: Column) -> Column:
        at = F.greatest(F.least((i + 0.5) * n / size - 0.5, top.cast("double")), F.lit(0.0))
        low = F.floor(at).cast("int")
        return F.struct(low.alias("low"), F.least(low + 1, top).alias("high"), (at - low).alias("share"))

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), tap)


def _patch(pixels: Column, box: Column, height: Column, width: Column, channels: Column, size: int) -> Column:
    """Bytes of a box's patch: plain bilinear sampling, rows times columns."""
    x1, y1 = (F.greatest(box[c].cast("int"), F.lit(0)) for c in ("x1", "y1"))
    x2, y2 = F.least(box["x2"].cast("int"), width), F.least(box["y2"].cast("int"), height)

    def sampled(taps: Column) -> Column:
        def value(r: Column, q: Column, k: Column) -> Column:
            at = lambda row, column: F.get(pixels, ((y1 + row) * width + x1 + column) * channels + k)
            line = lambda row: at(row, q["low"]) * (1 - q["share"]) + at(row, q["high"]) * q["share"]
            return F.rint(line(r["low"]) * (1 - r["share"]) + line(r["high"]) * r["share"]).cast("int")

        layers = F.sequence(F.lit(0), channels - 1)
        rows = F.transform(taps["y"], lambda r: F.flatten(F.transform(taps["x"], lambda q: F.transform(layers, lambda k: F.char(value(r, q, k))))))
        return F.array_join(F.flatten(rows), "")

    taps = F.struct(_taps(y2 - y1, size).alias("y"), _taps(x2 - x1, size).alias("x"))
    empty = F.repeat(F.char(F.lit(0)), channels * (size * size))
    return F.encode(F.when((x2 > x1) & (y2 > y1), held(taps, sampled)).otherwise(empty), "ISO-8859-1")


def crop_resize(images: DataFrame, size: int = PATCH_SIZE, keys: str = "image string") -> DataFrame:
    """Crop every box of an image and resize it to ``size x size``; an empty or padding box gives zeros.

    ``images`` has the key, ``height, width, channels, data`` (row-major bytes) and ``boxes``, the
    ranked boxes of that image (at most one per slot) as ``array<struct<slot,x1,y1,x2,y2>>``. An image
    is decoded once for all its boxes, inside its row.
    """
    key = keys.split()[0]
    pixels = F.transform(F.split(F.decode("data", "ISO-8859-1"), ""), F.ascii)
    patch = lambda p: F.transform("boxes", lambda b: F.struct(
        b["slot"].cast("int").alias("slot"), _patch(p, b, F.col("height"), F.col("width"), F.col("channels"), size).alias("patch")))
    return exploded(images.withColumn("_patches", held(pixels, patch)), "_patches", "_at", "_p", [key]).select(key, "_p.slot", "_p.patch")
