"""Points to rasters: tree bases, canopy heights, terrain, exclusive labels, crown cells.

Everything is group-by on (plot, cell) or (plot, tree): partial aggregation shrinks a hot plot to one row per cell and
task before it is shuffled, and cells of a plot spread over all partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.functions import scalar as S

CELL = ["plot_id", "row_", "col"]


def with_cells(points: DataFrame) -> DataFrame:
    """Points inside the plot square, with row_ and col."""
    x, y = F.col("x"), F.col("y")
    return points.filter(S.inside_plot(x, y)).withColumns({"row_": S.row_of(y), "col": S.col_of(x)})


def with_clipped_cells(points: DataFrame) -> DataFrame:
    """All points; those outside the grid fall to its border cells."""
    row, col = F.floor((S.HALF_PLOT - F.col("y")) / S.CELL), F.floor((F.col("x") + S.HALF_PLOT) / S.CELL)
    return points.withColumns({"row_": S.clipped(row), "col": S.clipped(col)})


def tree_bases(points: DataFrame) -> DataFrame:
    return points.filter(F.col("tree_id") > 0).groupBy("plot_id", "tree_id").agg(F.min("z").alias("base"))


def tree_heights(points: DataFrame, trees: DataFrame) -> DataFrame:
    """Heights over the tree's base of labelled points in the square; implausible points and unknown trees go."""
    known = tree_bases(points).join(trees, ["plot_id", "tree_id"])
    h = S.above_base(F.col("z"), F.col("base"))
    found = with_cells(points).join(known, ["plot_id", "tree_id"]).withColumn("h", h)
    return found.filter(F.col("h") <= F.col("height_m") + S.TOLERANCE)


def canopy_height(points: DataFrame, trees: DataFrame) -> DataFrame:
    """plot_id, row_, col, h: the highest tree point of a cell, 0 where there are points but no tree."""
    top = tree_heights(points, trees).groupBy(*CELL).agg(F.max("h").alias("h"))
    covered = with_cells(points).select(*CELL).distinct()
    return covered.join(top, CELL, "left").withColumn("h", F.coalesce("h", F.lit(0.0)))


def topmost(heights: DataFrame, cutoff: float = S.CUTOFF) -> DataFrame:
    """plot_id, row_, col, tree_id, h: the tree with the highest point of a cell, the smaller id of equal ones."""
    best = F.max(F.struct(F.col("h"), (-F.col("tree_id")).alias("t"))).alias("m")
    won = heights.filter(F.col("h") >= cutoff).groupBy(*CELL).agg(best)
    return won.select(*CELL, (-F.col("m.t")).alias("tree_id"), F.col("m.h").alias("h"))


def label_raster(points: DataFrame, won: DataFrame) -> DataFrame:
    """Labels of covered cells, 0 for background."""
    covered = with_cells(points).select(*CELL).distinct()
    labels = covered.join(won.select(*CELL, "tree_id"), CELL, "left")
    return labels.withColumn("tree_id", F.coalesce("tree_id", F.lit(0).cast("bigint")))


def first_pass(points: DataFrame) -> DataFrame:
    """Coverage, ground sum and count, tree count of each clipped cell, in one aggregation."""
    ground = F.col("cls") == S.GROUND
    return with_clipped_cells(points).groupBy(*CELL).agg(
        F.count("*").alias("n_points"),
        F.sum(F.when(ground, F.col("z"))).alias("ground_sum"),
        F.count(F.when(ground, 1)).alias("ground_count"),
        F.countDistinct(F.when(F.col("tree_id") > 0, F.col("tree_id"))).alias("n_trees"),
    )


def class2_terrain(points: DataFrame) -> DataFrame:
    """Mean ground height of cells that have ground points."""
    found = first_pass(points).filter(F.col("ground_count") > 0)
    return found.select(*CELL, (F.col("ground_sum") / F.col("ground_count")).alias("dtm"))


def nearest_fill(known: DataFrame, wanted: DataFrame, value: str) -> DataFrame:
    """Value of the nearest known cell of the plot, however far; ties by row, then column. Plots without any get none.

    Search rings grow: a wanted cell meets known cells of its own and the eight neighbouring square blocks; what finds
    none goes on with blocks eight times as large, until a block holds the widest raster.  A found cell is final when it
    is not further than a block.
    """
    done, rest, size = None, wanted.select(*CELL), 4
    reach = [f(c) for c in ("row_", "col") for f in (F.min, F.max)]
    low_row, high_row, low_col, high_col = known.select("row_", "col").union(rest.select("row_", "col")).agg(*reach).first()
    widest = 0 if low_row is None else max(high_row - low_row, high_col - low_col) + 1
    while True:
        block = lambda c, d=size: F.floor(c / d).cast("int")
        k = known.select("plot_id", F.col("row_").alias("kr"), F.col("col").alias("kc"), F.col(value).alias("v"), block(F.col("row_")).alias("br"), block(F.col("col")).alias("bc"))
        around = F.array(*[F.struct(F.lit(a).alias("da"), F.lit(b).alias("db")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        w = rest.withColumn("d", F.explode(around)).withColumns(
            {"br": block(F.col("row_")) + F.col("d.da"), "bc": block(F.col("col")) + F.col("d.db")}
        )
        far = lambda a, b: (F.col(a) - F.col(b)).cast("bigint") * (F.col(a) - F.col(b))
        best = w.join(k, ["plot_id", "br", "bc"]).groupBy(*CELL).agg(
            F.min(F.struct((far("kr", "row_") + far("kc", "col")).alias("d2"), "kr", "kc", "v")).alias("m")
        )
        last = size >= widest
        final = best.filter((F.col("m.d2") <= size * size) | F.lit(last))
        found = final.select(*CELL, F.col("m.v").alias(value), F.col("m.d2").alias("d2"))
        done = found if done is None else done.unionByName(found)
        if last:
            return done
        rest, size = rest.join(final.select(*CELL), CELL, "left_anti"), size * 8


def crown_cells(heights: DataFrame) -> DataFrame:
    """One row per tree and cell it has points in, with their number and the highest."""
    return heights.groupBy("plot_id", "tree_id", "row_", "col").agg(F.count("*").alias("n"), F.max("h").alias("h"))


def crown_attributes(cells: DataFrame, trees: DataFrame) -> DataFrame:
    """Overlapping crowns: cells, points, area and greatest height of each, with the tree's record."""
    found = cells.groupBy("plot_id", "tree_id").agg(
        F.count("*").alias("raw_cells"), F.sum("n").alias("point_count_used"), F.max("h").alias("max_h")
    )
    return found.join(trees, ["plot_id", "tree_id"]).withColumn("gt_area_m2", F.col("raw_cells") * (S.CELL * S.CELL))


def topmost_attributes(won: DataFrame) -> DataFrame:
    return won.groupBy("plot_id", "tree_id").agg(
        F.count("*").alias("visible_cells"), F.max("h").alias("topmost_max_height_m"), (F.count("*") * (S.CELL * S.CELL)).alias("gt_area_m2")
    )


def terrain_choice(points: DataFrame) -> DataFrame:
    """How each plot's terrain is made: by ground class, flat, or from the lower envelope."""
    found = points.groupBy("plot_id").agg(F.count(F.when(F.col("cls") == S.GROUND, 1)).alias("ground"), F.min("z").alias("low"))
    kind = F.when(F.col("ground") > 0, "class2").when(F.col("low") <= 2, "zero").otherwise("lower-envelope")
    return found.select("plot_id", "ground", "low", kind.alias("dtm"))
