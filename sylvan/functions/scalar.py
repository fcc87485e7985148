"""Scalar expressions on points, heights, names and parameters: plain columns, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plot geometry, tree height window, diameter formula, classes of points.
CELL, HALF_PLOT, SIDE = 0.5, 15.0, 60
LOW_HEIGHT, HIGH_HEIGHT, LOW_WINDOW = 10.0, 25.0, 2.0
MID_SLOPE, MID_INTERCEPT, HIGH_SLOPE, HIGH_INTERCEPT = 0.1, 0.3, 0.15, 1.0
DBH_A, DBH_B, DBH_REFERENCE = 10.0, 0.6, 1.3
GROUND, OUTSIDE, TREE_CLASSES = 2, 3, (4, 5, 6)
TOLERANCE, CUTOFF = 0.05, 2.0


def finite(c: Column) -> Column:
    """NULL for NaN and infinities, else the value."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def col_of(x: Column, left: float = -HALF_PLOT, cell: float = CELL) -> Column:
    return F.floor((x - left) / cell).cast("int")


def row_of(y: Column, top: float = HALF_PLOT, cell: float = CELL, rows: int = SIDE) -> Column:
    return F.least(F.floor((top - y) / cell), F.lit(rows - 1)).cast("int")


def clipped(cell: Column, size: int = SIDE) -> Column:
    return F.greatest(F.lit(0), F.least(cell, F.lit(size - 1))).cast("int")


def inside_plot(x: Column, y: Column, half: float = HALF_PLOT) -> Column:
    """Half-open square: left and top edges belong to it."""
    return (x >= -half) & (x < half) & (y > -half) & (y <= half)


def inside_core(x: Column, y: Column, left: float, bottom: float, right: float, top: float) -> Column:
    """Half-open box of a tile: left and bottom edges belong to it."""
    return (x >= left) & (x < right) & (y >= bottom) & (y < top)


def semantic_tree(tree_id: Column, cls: Column) -> Column:
    return (tree_id > 0) & cls.isin(*TREE_CLASSES)


def instance_tree(tree_id: Column, cls: Column) -> Column:
    return (tree_id > 0) & ~cls.isin(GROUND, OUTSIDE)


def non_ground(cls: Column) -> Column:
    return ~cls.isin(GROUND, OUTSIDE)


def integer_id(value: Column) -> Column:
    """Nearest integer; 0 for what is not finite; NULL for what is further than 1e-6 from one."""
    near = F.rint(value)
    return F.when(finite(value).isNull(), F.lit(0).cast("bigint")).when(F.abs(value - near) <= 1e-6, near.cast("bigint"))


def above_base(z: Column, base: Column) -> Column:
    return F.greatest(z - base, F.lit(0.0))


def window_diameter(
    h: Column, low_height=LOW_HEIGHT, high_height=HIGH_HEIGHT, low_window=LOW_WINDOW, mid_slope=MID_SLOPE,
    mid_intercept=MID_INTERCEPT, high_slope=HIGH_SLOPE, high_intercept=HIGH_INTERCEPT,
) -> Column:
    """Diameter of the local-maximum window at a height, with jumps at the two limits. Numbers or columns."""
    return (
        F.when(h < low_height, F.lit(low_window))
        .when(h < high_height, h * mid_slope + mid_intercept)
        .otherwise(h * high_slope + high_intercept)
    )


def interpolated_window(h: Column, heights: list, windows: list) -> Column:
    """Linear between control points, constant beyond them. Numbers or columns."""
    out = F.lit(windows[-1])
    for k in reversed(range(1, len(heights))):
        slope = (windows[k] - windows[k - 1]) / (heights[k] - heights[k - 1])
        out = F.when(h < heights[k], windows[k - 1] + (h - heights[k - 1]) * slope).otherwise(out)
    return F.when(h <= heights[0], F.lit(windows[0])).otherwise(out)


def diameter_at_breast_height(h: Column) -> Column:
    """Positive root of d = hm * b + sqrt(...): Naslund's height curve inverted, in centimetres, two decimals."""
    hm = F.greatest(h - DBH_REFERENCE, F.lit(0.0))
    d = (hm * DBH_B + F.sqrt(hm * DBH_B * (hm * DBH_B) + 4.0 * hm * DBH_A)) / 2.0
    return F.rint(d * 100) / 100


def centre_x(col: Column, left: float = -HALF_PLOT, cell: float = CELL) -> Column:
    return left + (col + 0.5) * cell


def centre_y(row: Column, top: float = HALF_PLOT, cell: float = CELL) -> Column:
    return top - (row + 0.5) * cell


def dataset_id(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")


def without_year(name: Column) -> Column:
    """The first _19yy_ or _20yy_ becomes _."""
    return F.regexp_replace(name, r"(?s)^(.*?)_(?:19|20)[0-9]{2}_", "$1_")


def requested_name(name: Column, prefix: str, suffix: str) -> Column:
    """Without one suffix, then without one prefix."""
    return F.regexp_replace(F.regexp_replace(name, f"{suffix}$", ""), f"^{prefix}", "")


def plot_from_stem(stem: Column) -> Column:
    found = F.regexp_extract(stem, "^plot_(.+)_annotated$", 1)
    return F.when(found != "", found)


def group_key(name: Column, parts: int) -> Column:
    return F.substring_index(name, "_", parts)


def quantised(value: Column, step: float) -> Column:
    """Nearest multiple of a step, halves to even."""
    return F.bround(F.rint(value / step) * step, 8)


def decoded_choice(u: Column, values: list) -> Column:
    """Categorical value for a number from 0 to 1."""
    table = F.array(*[F.lit(v) for v in values])
    return F.get(table, F.least(F.floor(u * len(values)), F.lit(len(values) - 1)).cast("int"))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def optional_float(text: Column) -> Column:
    return finite(text.try_cast("double"))


def finite_or_zero(c: Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def short_signature(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)
