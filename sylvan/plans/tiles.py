"""Tiles: windows on rasters, grids, the run over many tiles with a status for each, and checks that should find nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.operators import crowns, treetops
from sylvan.operators.rasterize import CELL
from sylvan.sources.workspace import written


def window(raster: DataFrame, top: int, left: int, bottom: int, right: int, buffer: int = 50) -> DataFrame:
    """Cells of a box and a buffer around it: plain range predicates, which storage can prune by."""
    rows, cols = F.col("row_").between(top - buffer, bottom + buffer), F.col("col").between(left - buffer, right + buffer)
    return raster.filter(rows & cols).select(*CELL, "h")


def grids(points: DataFrame, cell: float = 0.5) -> DataFrame:
    """Each plot's grid, its bounds snapped outwards to whole cells."""
    b = points.groupBy("plot_id").agg(*[f(v).alias(f"{n}_{v}") for v in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    low, high = (lambda v: F.floor(F.col(f"lo_{v}") / cell)), (lambda v: F.ceil(F.col(f"hi_{v}") / cell))
    return b.select(
        "plot_id", (low("x") * cell).alias("left_"), (high("y") * cell).alias("top"),
        ((high("x") - low("x")) * (high("y") - low("y"))).cast("bigint").alias("cells"),
    )


def differing_cells(a: DataFrame, b: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    both = a.select(*CELL, F.col("h").alias("ha")).join(b.select(*CELL, F.col("h").alias("hb")), CELL, "full")
    off = F.col("ha").isNull() | F.col("hb").isNull() | (F.abs(F.col("ha") - F.col("hb")) > tolerance)
    return both.agg(F.count(F.when(off, 1)).alias("differing"))


def unpaired(tops: DataFrame, cells: DataFrame) -> DataFrame:
    """Tops without crown: should be none."""
    return tops.join(cells, ["plot_id", "tree_id"], "left_anti").select("plot_id", "tree_id")


def run_tiles(raster: DataFrame, work: DataFrame, min_height: float = 2.0) -> DataFrame:
    """Status and numbers of tops and crown cells of each plot; a plot without canopy is empty, without raster an error."""
    raster = written(raster, "raster")
    tops = written(treetops.locate(raster, min_height), "tops")
    cells = written(crowns.segment(raster, tops, min_height), "crowns")
    n_tops = tops.groupBy("plot_id").agg(F.count("*").alias("n_tops"))
    n_cells = cells.groupBy("plot_id").agg(F.count("*").alias("n_cells"), F.countDistinct("tree_id").alias("n_crowns"))
    there = raster.select("plot_id").distinct().withColumn("_there", F.lit(1))
    found = work.select("plot_id").join(there, "plot_id", "left").join(n_tops, "plot_id", "left").join(n_cells, "plot_id", "left")
    status = (
        F.when(F.col("_there").isNull(), "error").when(F.col("n_tops").isNull(), "empty")
        .when(F.col("n_tops") != F.col("n_crowns"), "error").otherwise("processed")
    )
    return found.select("plot_id", status.alias("status"), F.coalesce("n_tops", F.lit(0)).alias("n_tops"), F.coalesce("n_cells", F.lit(0)).alias("n_cells"))
