"""Neighbourhood operators on sparse cell tables: each cell is sent to the cells whose window it is in (integer offsets,
an equi-key), then grouped.  Rows grow by the window's cells only; plots need not fit in memory."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.functions import scalar as S
from sylvan.operators.rasterize import CELL


def square(size: int) -> list[tuple[int, int]]:
    reach = range(-(size // 2), size // 2 + 1)
    return [(a, b) for a in reach for b in reach]


def circle(radius: float, cell: float = 0.5) -> list[tuple[int, int]]:
    """Offsets within a radius in metres, with the rounding allowance of 1e-12 square metres."""
    most = math.ceil(radius / cell)
    return [(a, b) for a, b in square(2 * most + 1) if (a * cell) ** 2 + (b * cell) ** 2 <= radius**2 + 1e-12]


def offsets(cells: list[tuple[int, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(a).alias("da"), F.lit(b).alias("db")) for a, b in cells]))


def checked(raster: DataFrame, rows: int, cols: int) -> DataFrame:
    """The raster; a cell outside its grid is an error when the plan runs."""
    inside = F.col("row_").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    where = F.concat_ws(" ", F.lit("a cell outside the grid: plot"), "plot_id", F.lit("row"), "row_", F.lit("column"), "col")
    return raster.filter(F.when(inside, F.lit(True)).otherwise(F.raise_error(where)))


def spread(raster: DataFrame, cells: list[tuple[int, int]], rows: int = S.SIDE, cols: int = S.SIDE) -> DataFrame:
    """One row for each cell and window it lies in: the window's centre as row_, col; the offset from it as da, db.
    Cells may lie outside the grid (mirrored or repeated borders), centres may not."""
    out = raster.withColumn("d", offsets(cells))
    out = out.withColumns({"row_": F.col("row_") - F.col("d.da"), "col": F.col("col") - F.col("d.db"), "da": F.col("d.da"), "db": F.col("d.db")})
    return out.drop("d").filter(F.col("row_").between(0, rows - 1) & F.col("col").between(0, cols - 1))


def focal(raster: DataFrame, size: int, rows: int = S.SIDE, cols: int = S.SIDE, **aggregates: Column) -> DataFrame:
    """Aggregates over odd square windows, no-data left out; cells whose window has no data are absent."""
    known = spread(raster.filter(F.col("h").isNotNull()), square(size), rows, cols)
    return known.groupBy(*CELL).agg(*[c.alias(k) for k, c in aggregates.items()])


def focal_median(raster: DataFrame, size: int = 3, rows: int = S.SIDE, cols: int = S.SIDE) -> DataFrame:
    """Also gives values to no-data cells next to data; a size of 1 changes nothing."""
    return raster if size == 1 else focal(checked(raster, rows, cols), size, rows, cols, h=F.expr("percentile(h, 0.5)"))


def pit_fill(raster: DataFrame, size: int, depth: float, min_height: float = 2.0, rows: int = S.SIDE, cols: int = S.SIDE) -> DataFrame:
    """Cells (or holes) well under their surroundings get the window's median, where enough of the window is known."""
    if size == 1:
        return raster
    around = focal(checked(raster, rows, cols), size, rows, cols, med=F.expr("percentile(h, 0.5)"), n=F.count("*"))
    both = around.join(raster, CELL, "full")
    enough = (F.col("n") >= math.ceil(0.6 * size * size)) & (F.col("med") >= min_height)
    pit = F.col("h").isNull() | (F.col("med") - F.col("h") >= depth)
    return both.select(*CELL, F.when(enough & pit, F.col("med")).otherwise(F.col("h")).alias("h")).filter("h is not null")


def gaussian(raster: DataFrame, sigma: float, rows: int = S.SIDE, cols: int = S.SIDE) -> DataFrame:
    """Weighted mean of known cells, edge cells repeated outwards; only known cells change."""
    if sigma == 0:
        return raster
    reach = int(4 * sigma + 0.5)
    weight = F.exp(-(F.col("da") * F.col("da") + F.col("db") * F.col("db")) / (2.0 * sigma * sigma))
    known = checked(raster, rows, cols).filter(F.col("h").isNotNull())
    # repeated edges: a border cell stands for all cells beyond it
    beyond = lambda c, n: F.when(F.col(c) == 0, F.sequence(F.lit(-reach), F.lit(0))).when(
        F.col(c) == n - 1, F.sequence(F.lit(n - 1), F.lit(n - 1 + reach))
    ).otherwise(F.array(F.col(c)))
    padded = known.withColumn("r2", F.explode(beyond("row_", rows))).withColumn("c2", F.explode(beyond("col", cols)))
    padded = padded.select("plot_id", F.col("r2").cast("int").alias("row_"), F.col("c2").cast("int").alias("col"), "h")
    near = spread(padded, square(2 * reach + 1), rows, cols).withColumn("w", weight)
    smooth = near.groupBy(*CELL).agg((F.sum(F.col("w") * F.col("h")) / F.sum("w")).alias("h"))
    return smooth.join(known.select(*CELL), CELL, "left_semi")


def smooth(
    raster: DataFrame, median: int = 3, pit_size: int = 1, pit_depth: float = 0.0, sigma: float = 0.0,
    min_height: float = 2.0, rows: int = S.SIDE, cols: int = S.SIDE,
) -> DataFrame:
    filled = pit_fill(raster, pit_size, pit_depth, min_height, rows, cols)
    return focal_median(gaussian(filled, sigma, rows, cols), median, rows, cols)


def reflected(raster: DataFrame, size: int, rows: int = S.SIDE, cols: int = S.SIDE) -> DataFrame:
    """The raster with its border mirrored outwards (edge cell repeated), for windows of a size."""
    reach = size // 2
    mirror = lambda c, n: F.array_distinct(
        F.concat(
            F.array(F.col(c)),
            F.when(F.col(c) < reach, F.array(-1 - F.col(c))).otherwise(F.array().cast("array<int>")),
            F.when(F.col(c) >= n - reach, F.array(2 * n - 1 - F.col(c))).otherwise(F.array().cast("array<int>")),
        )
    )
    out = checked(raster, rows, cols).withColumn("r2", F.explode(mirror("row_", rows))).withColumn("c2", F.explode(mirror("col", cols)))
    return out.select("plot_id", F.col("r2").alias("row_"), F.col("c2").alias("col"), "h")


def focal_min(raster: DataFrame, size: int = 5, rows: int = S.SIDE, cols: int = S.SIDE) -> DataFrame:
    return focal(reflected(raster, size, rows, cols), size, rows, cols, h=F.min("h"))


def lower_envelope(ground: DataFrame, rows: int = S.SIDE, cols: int = S.SIDE) -> DataFrame:
    """Minimum over 5 x 5, then median over 9 x 9 cells, borders mirrored."""
    low = focal_min(ground, 5, rows, cols)
    return focal(reflected(low, 9, rows, cols), 9, rows, cols, h=F.expr("percentile(h, 0.5)"))
