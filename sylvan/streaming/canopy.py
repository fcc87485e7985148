"""Rasters over streams of points: all accumulators are minima, maxima and counts, so late points only refine them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.functions import scalar as S
from sylvan.operators.rasterize import CELL, with_cells


def base_stream(points: DataFrame) -> DataFrame:
    """Running base of each tree (update mode)."""
    return points.filter(F.col("tree_id") > 0).groupBy("plot_id", "tree_id").agg(F.min("z").alias("base"))


def canopy_stream(points: DataFrame, bases: DataFrame, trees: DataFrame) -> DataFrame:
    """Running canopy height of each cell, for a table of known bases (update mode): a stream-static join, then a max.

    Cells with points but without plausible tree points are 0.
    """
    known = bases.join(trees, ["plot_id", "tree_id"])
    h = S.above_base(F.col("z"), F.col("base"))
    plausible = F.when(h <= F.col("height_m") + S.TOLERANCE, h).otherwise(F.lit(0.0))
    found = with_cells(points).join(known, ["plot_id", "tree_id"], "left")
    return found.groupBy(*CELL).agg(F.max(F.coalesce(plausible, F.lit(0.0))).alias("h"))


def trial_windows(trials: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Trials and mean score of each event type in tumbling windows; what comes later than the watermark is dropped."""
    return (
        trials.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "mean")
    )
