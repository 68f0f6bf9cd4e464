"""Box geometry: areas, clamping, canvas scaling, binning and one-hot codes."""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F

# Fixed values of the canvas and feature layout.
CANVAS_WIDTH = 300
CANVAS_HEIGHT = 200
GRID_STEP = 5
X_BINS = CANVAS_WIDTH // GRID_STEP
Y_BINS = CANVAS_HEIGHT // GRID_STEP
MAX_OBJECTS = 10
PATCH_SIZE = 32


def box_area(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Signed-side product of the raw coordinates (an inverted box can be positive)."""
    return (xmax - xmin) * (ymax - ymin)


def clamp_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column, width: Column, height: Column) -> Column:
    """Truncated corners held inside the image, with a ``degenerate`` flag for empty boxes."""
    x1 = F.greatest(F.lit(0), xmin.cast("int"))
    y1 = F.greatest(F.lit(0), ymin.cast("int"))
    x2 = F.least(width.cast("int"), xmax.cast("int"))
    y2 = F.least(height.cast("int"), ymax.cast("int"))
    return F.struct(
        x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
        ((x2 <= x1) | (y2 <= y1)).alias("degenerate"),
    )


def scale_to_canvas(value: Column, extent: Column, canvas: int) -> Column:
    """Pixel coordinate of one axis mapped onto ``0 .. canvas-1`` and truncated."""
    scaled = value * F.lit(canvas) / extent
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(float(canvas - 1))).cast("int")


def canvas_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column, width: Column, height: Column) -> Column:
    return F.struct(
        scale_to_canvas(xmin, width, CANVAS_WIDTH).alias("cx1"),
        scale_to_canvas(ymin, height, CANVAS_HEIGHT).alias("cy1"),
        scale_to_canvas(xmax, width, CANVAS_WIDTH).alias("cx2"),
        scale_to_canvas(ymax, height, CANVAS_HEIGHT).alias("cy2"),
    )


def grid_bin(coord: Column) -> Column:
    """Grid cell of a canvas coordinate."""
    return F.floor(coord / F.lit(GRID_STEP)).cast("int")


def onehot(index: Column, size: int, kind: str = "byte") -> Column:
    """0/1 array of length ``size``: a window over one constant array, folded once per plan."""
    zeros = F.array_repeat(F.lit(0).cast(kind), size - 1)
    strip = F.concat(zeros, F.array(F.lit(1).cast(kind)), zeros)
    return F.slice(strip, F.lit(size) - index.cast("int"), F.lit(size))


def onehot_boxes(x1b: Column, y1b: Column, x2b: Column, y2b: Column, x_bins: int = X_BINS, y_bins: int = Y_BINS,
                 kind: str = "byte") -> Column:
    """Concatenated one-hots in the order x1, y1, x2, y2. A padding box lands in bin 0 four times."""
    return F.concat(*[onehot(b, n, kind) for b, n in zip((x1b, y1b, x2b, y2b), (x_bins, y_bins) * 2)])


def code_digits(code: Column, sizes: tuple[int, ...] = (X_BINS, Y_BINS) * 2) -> Column:
    """The numbers of a code as digits in a row. Groups of ``sizes`` that hold a single 1 are windows over constant texts;
    any other code is written number by number."""
    at = [F.array_position(F.slice(code, 1 + sum(sizes[:i]), n), F.lit(1.0)).cast("int") for i, n in enumerate(sizes)]
    single = F.size(code) == F.lit(sum(sizes))
    single = functools.reduce(lambda a, b: a & b, [p > 0 for p in at], single & (F.size(F.array_remove(code, F.lit(0.0))) == len(sizes)))
    text = F.concat(*[F.substr(F.lit("0" * (n - 1) + "1" + "0" * (n - 1)), F.lit(n + 1) - p, F.lit(n)) for p, n in zip(at, sizes)])
    return F.when(single, text).otherwise(F.array_join(code.cast("array<int>").cast("array<string>"), ""))


def argmax_first(values: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def decode_boxes(code: Column, x_bins: int = X_BINS, y_bins: int = Y_BINS) -> Column:
    """Corner coordinates from four score groups; each side is at least one grid step long."""
    starts = [1, 1 + x_bins, 1 + x_bins + y_bins, 1 + 2 * x_bins + y_bins]
    sizes = [x_bins, y_bins, x_bins, y_bins]
    x1, y1, x2, y2 = (
        argmax_first(F.slice(code, start, size)) * GRID_STEP for start, size in zip(starts, sizes)
    )
    return F.struct(
        x1.alias("x1"), y1.alias("y1"),
        F.greatest(x1 + GRID_STEP, x2).alias("x2"),
        F.greatest(y1 + GRID_STEP, y2).alias("y2"),
    )


def center_box_to_corners(cx: Column, cy: Column, w: Column, h: Column,
                          width: int = CANVAS_WIDTH, height: int = CANVAS_HEIGHT) -> Column:
    """Corners of a normalised centre box, at least one pixel per side; null for an empty box."""
    x1 = ((cx - w / 2) * width).cast("int")
    y1 = ((cy - h / 2) * height).cast("int")
    x2 = ((cx + w / 2) * width).cast("int")
    y2 = ((cy + h / 2) * height).cast("int")
    corners = F.struct(
        F.greatest(F.lit(0), x1).alias("x1"),
        F.greatest(F.lit(0), y1).alias("y1"),
        F.least(F.lit(width), F.greatest(x1 + 1, x2)).alias("x2"),
        F.least(F.lit(height), F.greatest(y1 + 1, y2)).alias("y2"),
    )
    return F.when((w >= 1e-6) & (h >= 1e-6), corners)


def rescale_box_units(box: Column, width: Column, height: Column, scale: float = 1000.0) -> Column:
    """Box in ``0..scale`` units (array x1,y1,x2,y2) to integer pixels, axis chosen by index parity."""
    return F.transform(
        box,
        lambda b, i: (b / F.lit(float(scale)) * F.when(i % 2 == 0, width).otherwise(height)).cast("int"),
    )


def normalized_to_corners(box: Column, width: Column, height: Column) -> Column:
    """``[x, y, w, h]`` in 0..1 to truncated corner pixels."""
    x, y, w, h = (box[i] for i in range(4))
    return F.struct(
        (x * width).cast("int").alias("xmin"), (y * height).cast("int").alias("ymin"),
        ((x + w) * width).cast("int").alias("xmax"), ((y + h) * height).cast("int").alias("ymax"),
    )


def grid_object(label: Column, position: Column, width: int, height: int) -> Column:
    """Object vector of a grid cell: label one-hot, then column and row one-hots."""
    return F.concat(
        onehot(label, width * height),
        onehot(position % F.lit(width), width),
        onehot(F.floor(position / F.lit(width)), height),
    )


def decode_grid_object(code: Column, width: int = 3, height: int = 3) -> Column:
    """Label, column and row indexes of a grid object's score vector."""
    cells = width * height
    return F.struct(
        argmax_first(F.slice(code, 1, cells)).alias("label"),
        argmax_first(F.slice(code, cells + 1, width)).alias("x"),
        argmax_first(F.slice(code, cells + width + 1, height)).alias("y"),
    )
