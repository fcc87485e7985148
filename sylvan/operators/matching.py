"""Predicted against reference crowns: overlaps by an equi-join of cells, one-to-one matches, measures, listings.

Crowns are sets of cells (plot_id, tree_id, row_, col), so intersections are counts.  No pair of crowns without a common
cell is ever formed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions.scalar import safe_ratio
from sylvan.operators.rasterize import CELL

AREA = 0.25
PAIR = "plot_id long, gt_id long, pred_id long"


def sizes(cells: DataFrame, name: str) -> DataFrame:
    return cells.groupBy("plot_id", F.col("tree_id").alias(f"{name}_id")).agg(F.count("*").alias(f"{name}_cells"))


def overlaps(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """plot_id, gt_id, pred_id, common, gt_cells, pred_cells, iou of crowns that share cells."""
    both = gt.select(*CELL, F.col("tree_id").alias("gt_id")).join(pred.select(*CELL, F.col("tree_id").alias("pred_id")), CELL)
    common = both.groupBy("plot_id", "gt_id", "pred_id").agg(F.count("*").alias("common"))
    out = common.join(sizes(gt, "gt"), ["plot_id", "gt_id"]).join(sizes(pred, "pred"), ["plot_id", "pred_id"])
    union = F.col("gt_cells") + F.col("pred_cells") - F.col("common")
    return out.withColumn("iou", F.col("common") / union)


def ignored_overlap(ignored: DataFrame, pred: DataFrame) -> DataFrame:
    """plot_id, pred_id, overlap: the greatest share of a prediction that one ignored reference crown covers."""
    share = F.col("common") / F.col("pred_cells")
    return overlaps(ignored, pred).groupBy("plot_id", "pred_id").agg(F.max(share).alias("overlap"))


def unique_matches(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """For exclusive labels and thresholds from one half on, pairs over the threshold are one to one but for halved
    crowns; of those the pair with the smaller prediction, then reference, stays."""
    over = pairs.filter(F.col("iou") >= threshold)
    by = lambda side, other: F.row_number().over(Window.partitionBy("plot_id", side).orderBy(F.desc("iou"), other))
    over = over.withColumn("r", by("gt_id", "pred_id")).filter("r = 1")
    return over.withColumn("r", by("pred_id", "gt_id")).filter("r = 1").drop("r")


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Rows to columns with the greatest sum of scores: shortest augmenting paths with potentials."""
    rows, cols = score.shape
    if rows > cols:
        return [(a, b) for b, a in assign(score.T)]
    cost = score.max(initial=0.0) - score
    u, v = np.zeros(rows + 1), np.zeros(cols + 1)
    owner = np.zeros(cols + 1, int)
    for row in range(1, rows + 1):
        owner[0], at = row, 0
        least, back, used = np.full(cols + 1, np.inf), np.zeros(cols + 1, int), np.zeros(cols + 1, bool)
        while owner[at]:
            used[at] = True
            reduced = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], back[1:][better] = reduced[better], at
            free = np.where(used[1:], np.inf, least[1:])
            nearest = int(free.argmin()) + 1
            step = free[nearest - 1]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            at = nearest
        while at:
            owner[at], at = owner[back[at]], back[at]
    return sorted((owner[c] - 1, c - 1) for c in range(1, cols + 1) if owner[c])


def best_matches(pairs: DataFrame, threshold: float) -> DataFrame:
    """One-to-one pairs over the threshold that maximise the sum of 1 + iou, plot by plot."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        gts, preds = sorted(table["gt_id"].unique()), sorted(table["pred_id"].unique())
        score = np.zeros((len(gts), len(preds)))
        score[np.searchsorted(gts, table["gt_id"]), np.searchsorted(preds, table["pred_id"])] = 1.0 + table["iou"]
        found = [(gts[a], preds[b]) for a, b in assign(score) if score[a, b] > 0]
        return pd.DataFrame({"plot_id": table["plot_id"].iloc[0], "gt_id": [a for a, _ in found], "pred_id": [b for _, b in found]})

    over = pairs.filter(F.col("iou") >= threshold).select("plot_id", "gt_id", "pred_id", "iou")
    return over.groupBy("plot_id").applyInPandas(run, PAIR).join(pairs, ["plot_id", "gt_id", "pred_id"])


def centroid(cells: DataFrame, name: str) -> DataFrame:
    return cells.groupBy("plot_id", F.col("tree_id").alias(f"{name}_id")).agg(
        F.avg("row_").alias(f"{name}_r"), F.avg("col").alias(f"{name}_c")
    )


def match_rows(matches: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Areas, dice, area errors and centroid distance (metres) of each match."""
    m = matches.join(centroid(gt, "gt"), ["plot_id", "gt_id"]).join(centroid(pred, "pred"), ["plot_id", "pred_id"])
    d = lambda a: (F.col(f"gt_{a}") - F.col(f"pred_{a}")) * (F.col(f"gt_{a}") - F.col(f"pred_{a}"))
    return m.select(
        "plot_id", "gt_id", "pred_id", "iou", (F.col("common") * AREA).alias("intersection_m2"),
        (2 * F.col("common") / (F.col("gt_cells") + F.col("pred_cells"))).alias("dice"),
        (F.col("gt_cells") * AREA).alias("gt_area_m2"), (F.col("pred_cells") * AREA).alias("prediction_area_m2"),
        ((F.col("pred_cells") - F.col("gt_cells")) * AREA).alias("area_error_m2"),
        (F.abs(F.col("pred_cells") - F.col("gt_cells")) * AREA).alias("absolute_area_error_m2"),
        (F.sqrt(d("r") + d("c")) * 0.5).alias("centroid_distance_m"),
    )


def outline(cells: DataFrame) -> DataFrame:
    """Points of a crown's outline every quarter metre, in half cells: corners and middles of edges that bound it."""
    sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    edge = cells.withColumn("s", F.explode(sides))
    other = cells.select("plot_id", "tree_id", F.col("row_").alias("nr"), F.col("col").alias("nc"))
    open_edge = edge.withColumns({"nr": F.col("row_") + F.col("s.a"), "nc": F.col("col") + F.col("s.b")}).join(
        other, ["plot_id", "tree_id", "nr", "nc"], "left_anti"
    )
    # centre of the edge in half cells, and its two ends
    r, c = 2 * F.col("row_") + 1 + F.col("s.a"), 2 * F.col("col") + 1 + F.col("s.b")
    along = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("t")
    spread = open_edge.select("plot_id", "tree_id", "s", r.alias("r"), c.alias("c"), along)
    return spread.select(
        "plot_id", "tree_id", (F.col("r") + F.col("t") * F.abs(F.col("s.b"))).alias("r"), (F.col("c") + F.col("t") * F.abs(F.col("s.a"))).alias("c")
    ).distinct()


DISTANCES = "plot_id long, gt_id long, pred_id long, mean_m double, p95_m double, hausdorff_m double"


def nearest_distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distance of each point to the nearest of the others, in blocks of bounded size."""
    out = [((points[k : k + 512, None, :] - others[None, :, :]) ** 2).sum(2).min(1) for k in range(0, len(points), 512)]
    return np.sqrt(np.concatenate(out))


def boundary_distances(matches: DataFrame, gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Mean, 95th percentile and greatest (Hausdorff) distance between outlines of matches, both ways, in metres."""
    key = ["plot_id", "gt_id", "pred_id"]
    ids = matches.select(*key)
    a = ids.join(outline(gt).withColumnRenamed("tree_id", "gt_id"), ["plot_id", "gt_id"])
    b = ids.join(outline(pred).withColumnRenamed("tree_id", "pred_id"), ["plot_id", "pred_id"])
    b = b.select(*[F.col(k).alias(k) for k in key], "r", "c")  # columns of its own, not those of the other side

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        p, q = left[["r", "c"]].to_numpy(float), right[["r", "c"]].to_numpy(float)
        d = np.concatenate([nearest_distances(p, q), nearest_distances(q, p)]) * 0.25
        found = {k: left[k].iloc[0] for k in key}
        return pd.DataFrame([found | {"mean_m": d.mean(), "p95_m": np.percentile(d, 95), "hausdorff_m": d.max()}])

    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(run, DISTANCES)


def outcomes(gt: DataFrame, pred: DataFrame, ignored: DataFrame, matches: DataFrame, ignore_from: float = 0.5) -> DataFrame:
    """Every crown with its status: matched, false_negative, false_positive or ignored_prediction."""
    g = sizes(gt, "gt").join(matches.select("plot_id", "gt_id", "pred_id"), ["plot_id", "gt_id"], "left").select(
        "plot_id", F.col("gt_id").alias("tree_id"), F.lit("reference").alias("side"), F.col("gt_cells").alias("cells"),
        F.when(F.col("pred_id").isNull(), "false_negative").otherwise("matched").alias("status"),
    )
    p = sizes(pred, "pred").join(matches.select("plot_id", "gt_id", "pred_id"), ["plot_id", "pred_id"], "left")
    p = p.join(ignored_overlap(ignored, pred), ["plot_id", "pred_id"], "left").select(
        "plot_id", F.col("pred_id").alias("tree_id"), F.lit("prediction").alias("side"), F.col("pred_cells").alias("cells"),
        F.when(F.col("gt_id").isNotNull(), "matched").when(F.col("overlap") >= ignore_from, "ignored_prediction").otherwise("false_positive").alias("status"),
    )
    return g.unionByName(p)


def count_metrics(found: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts and areas of each plot, from which every measure follows."""
    is_ = lambda side, *status: (F.col("side") == side) & F.col("status").isin(*status)
    n = lambda c: F.count(F.when(c, 1))
    area = lambda c: F.coalesce(F.sum(F.when(c, F.col("cells"))), F.lit(0)) * AREA
    counts = found.groupBy("plot_id").agg(
        n(is_("reference", "matched")).alias("tp"), n(is_("prediction", "false_positive")).alias("fp"),
        n(is_("reference", "false_negative")).alias("fn"), n(is_("prediction", "ignored_prediction")).alias("ignored"),
        area(F.col("side") == "reference").alias("gt_area"), area(is_("prediction", "matched", "false_positive")).alias("pred_area"),
    )
    m = matches.groupBy("plot_id").agg(
        F.sum("iou").alias("iou_sum"), F.sum(2 * F.col("common") / (F.col("gt_cells") + F.col("pred_cells"))).alias("dice_sum"), (F.sum("common") * AREA).alias("common_area")
    )
    return counts.join(m, "plot_id", "left").fillna(0.0, ["iou_sum", "dice_sum", "common_area"])


def measures(counts: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall, F1, segmentation, recognition and panoptic quality, area measures; NULL where undefined."""
    c = F.col
    f1 = safe_ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn"))
    iou = safe_ratio(c("iou_sum"), c("tp"))
    both = c("pred_area") + c("gt_area")
    return counts.select(
        *keys, "tp", "fp", "fn", "ignored", safe_ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        safe_ratio(c("tp"), c("tp") + c("fn")).alias("recall"), f1.alias("f1"), iou.alias("mean_iou"),
        (f1 * iou).alias("pq"), safe_ratio(c("dice_sum"), c("tp")).alias("mean_dice"),
        safe_ratio(c("common_area"), c("pred_area")).alias("area_precision"), safe_ratio(c("common_area"), c("gt_area")).alias("area_recall"),
        safe_ratio(2 * c("common_area"), both).alias("area_dice"), safe_ratio(c("common_area"), both - c("common_area")).alias("area_iou"),
    )


SUMS = ("tp", "fp", "fn", "ignored", "gt_area", "pred_area", "iou_sum", "dice_sum", "common_area")


def rolled_up(counts: DataFrame, *keys: str) -> DataFrame:
    """Counts of several plots together: means are weighted by their matches."""
    return counts.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in SUMS])


def source_quality(counts: DataFrame, plots: DataFrame) -> DataFrame:
    """collection, pq."""
    unknown = F.raise_error(F.concat(F.lit("no source for plot "), F.col("plot_id").cast("string")))
    mapped = counts.join(plots.select("plot_id", "collection"), "plot_id", "left")
    mapped = mapped.withColumn("collection", F.when(F.col("collection").isNull(), unknown).otherwise(F.col("collection")))
    pq = safe_ratio(F.col("iou_sum"), F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn"))
    return rolled_up(mapped, "collection").select("collection", F.coalesce(pq, F.lit(0.0)).alias("pq"))


def source_balanced(counts: DataFrame, plots: DataFrame) -> DataFrame:
    """Panoptic quality of each source (0 without crowns); then the plain mean and population deviation over sources.
    A plot without a source is an error."""
    by = source_quality(counts, plots)
    return by.agg(F.count("*").alias("sources"), F.avg("pq").alias("mean_pq"), F.stddev_pop("pq").alias("std_pq"))
