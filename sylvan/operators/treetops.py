"""Tree tops by a local maximum in a circle that grows with height.

Candidates that survive the cheapest window are few, so only those are compared in their own circles, by an equi-join on
exploded offsets.  Plateaus (equal heights within reach) are decided in row-major order among the few candidates of a
plot, in one Arrow call for each plot; a NULL cell is no data.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions import scalar as S
from sylvan.operators.rasterize import CELL
from sylvan.sources.workspace import written

TOP = "plot_id long, row_ int, col int, h double"


def around(cells: DataFrame) -> DataFrame:
    """A row for each cell within radius r (metres) of a cell: the offsets as da, db."""
    within = F.col("r") * F.col("r") + 1e-12
    far = lambda square: F.floor(F.sqrt(F.greatest(square, F.lit(0.0))) / S.CELL + 1e-9).cast("int")
    out = cells.withColumn("da", F.explode(F.sequence(-far(within), far(within))))
    rest = far(within - F.col("da") * F.col("da") * (S.CELL * S.CELL))
    out = out.withColumn("db", F.explode(F.sequence(-rest, rest)))
    return out.filter((F.col("da") * F.col("da") + F.col("db") * F.col("db")) * (S.CELL * S.CELL) <= within)


def prefiltered(valid: DataFrame, min_height: float | Column = 2.0) -> DataFrame:
    """Cells (with their radius r) that are the maximum of the smallest window that the plot's valid cells ask for."""
    least = valid.groupBy("plot_id").agg(F.min("r").alias("r"))
    near = around(valid.select(*CELL, "h").join(least, "plot_id"))
    near = near.select("plot_id", (F.col("row_") - F.col("da")).alias("row_"), (F.col("col") - F.col("db")).alias("col"), "h")
    peak = near.groupBy(*CELL).agg(F.max("h").alias("top"))
    return valid.filter(F.col("h") >= min_height).join(peak, CELL).filter("h = top").drop("top")


def unbeaten(valid: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates with nothing higher in their own circle, whatever its size."""
    asked = around(candidates.select("plot_id", F.col("row_").alias("r0"), F.col("col").alias("c0"), F.col("h").alias("h0"), "r"))
    asked = asked.withColumns({"row_": F.col("r0") + F.col("da"), "col": F.col("c0") + F.col("db")})
    beaten = asked.join(valid.select(*CELL, "h"), CELL).filter(F.col("h") > F.col("h0"))
    beaten = beaten.select("plot_id", F.col("r0").alias("row_"), F.col("c0").alias("col")).distinct()
    return candidates.join(beaten, CELL, "left_anti")


def settle_ties(candidates: DataFrame) -> DataFrame:
    """Row by row: a candidate goes if an accepted one of equal height lies in its circle."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["row_", "col"])
        kept: dict[float, list[tuple[int, int]]] = {}
        keep = []
        for row, col, h, r in table[["row_", "col", "h", "r"]].itertuples(index=False):
            same = kept.setdefault(h, [])
            free = all(((row - a) ** 2 + (col - b) ** 2) * 0.25 > r * r + 1e-12 for a, b in same)
            keep.append(free)
            if free:
                same.append((row, col))
        return table.loc[keep, ["plot_id", "row_", "col", "h"]]

    found = candidates.select("plot_id", "row_", "col", F.col("h").cast("double").alias("h"), "r")
    return found.groupBy("plot_id").applyInPandas(run, TOP)


def numbered(tops: DataFrame) -> DataFrame:
    """Ids in row-major order, before any are cut off by the core; position, height and stem diameter."""
    order = Window.partitionBy("plot_id").orderBy("row_", "col")
    return tops.select(
        "plot_id", F.row_number().over(order).cast("bigint").alias("tree_id"), "row_", "col",
        S.centre_x(F.col("col")).alias("x"), S.centre_y(F.col("row_")).alias("y"), F.col("h").alias("z"),
        S.diameter_at_breast_height(F.col("h")).alias("dbh"),
    )


def with_radius(raster: DataFrame, window=S.window_diameter) -> DataFrame:
    """Cells with data, and the radius of their windows; ``window`` gives the diameter at a height."""
    return raster.filter(F.col("h").isNotNull()).withColumn("r", window(F.col("h")) / 2)


def locate(raster: DataFrame, min_height: float | Column = 2.0, window=S.window_diameter) -> DataFrame:
    """Tree tops of rasters of any size. ``window`` and ``min_height`` may read further columns of the raster."""
    valid = written(with_radius(raster, window), "cells")
    return numbered(settle_ties(unbeaten(valid, written(prefiltered(valid, min_height), "candidates"))))


def in_core(tops: DataFrame, margin: float = 5.0) -> DataFrame:
    half = S.HALF_PLOT - margin
    return tops.filter(S.inside_core(F.col("x"), F.col("y"), -half, -half, half, half))
