"""Evaluation of parameter sets: every run (a parameter set on a plot) of a study in one job.

A run is a row of ``runs``: run_id, plot_id and the parameters' columns.  Rasters and reference crowns are joined to the
runs of their plots, and all operators then work on runs in the place of plots, so candidates and plots spread alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions import parameters
from sylvan.operators import crowns, focal, matching, search, treetops
from sylvan.sources.workspace import written

THRESHOLDS = (0.25, 0.5, 0.75)
#: Measures that are kept for each threshold, and what they are called here.
FIELDS = {
    "precision": "precision", "recall": "recall", "f1": "f1", "segmentation_quality": "mean_iou", "panoptic_quality": "pq",
    "mean_iou": "mean_iou", "mean_dice": "mean_dice", "area_iou": "area_iou",
}


def runs_of(candidates: DataFrame, plots: DataFrame, most: int = 100_000) -> DataFrame:
    """Every candidate on every plot. Candidates are a study's, counted before they are broadcast."""
    if candidates.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} candidates")
    order = Window.orderBy("candidate_id")  # one row a candidate
    numbered = candidates.withColumn("number", F.row_number().over(order).cast("bigint"))
    pairs = plots.withColumn("all_", F.lit(1)).join(F.broadcast(numbered.withColumn("all_", F.lit(1))), "all_").drop("all_")
    return pairs.withColumn("run_id", F.col("number") * F.lit(1 << 40) + F.col("plot_id")).drop("number")


def on_runs(table: DataFrame, runs: DataFrame, *more: str) -> DataFrame:
    """A plots' table once for each run, run_id in the place of plot_id."""
    return table.join(runs.select("plot_id", "run_id", *more), "plot_id").drop("plot_id").withColumnRenamed("run_id", "plot_id")


def segmented(raster: DataFrame, runs: DataFrame, flexible: bool = False) -> DataFrame:
    """Crown cells of each run (as plot_id). A failed run, whose parameters break a rule, has none."""
    names = (*parameters.COMMON, *parameters.PREPROCESSING, *(parameters.FLEXIBLE if flexible else parameters.LEGACY))
    own = on_runs(raster, runs, *names)
    # neighbourhood sizes are part of the plan: one branch for each combination that occurs
    sizes = ("chm_pit_fill_size", "chm_pit_depth", "chm_gaussian_sigma", "median_filter_size", "min_height")
    found = []
    for combination in runs.select(*sizes).distinct().collect():
        same = reduce(lambda a, b: a & b, [F.col(k) == F.lit(combination[k]) for k in sizes])
        pit, depth, sigma, median, least = (combination[k] for k in sizes)
        cells = own.filter(same).select("plot_id", "row_", "col", "h")
        found.append(focal.smooth(cells, median, pit, depth, sigma, least))
    if not found:
        return raster.sparkSession.createDataFrame([], crowns.CROWNS)
    smooth = reduce(DataFrame.unionByName, found)
    ready = written(smooth.join(runs.select(F.col("run_id").alias("plot_id"), *names), "plot_id"), "runs")
    tops = treetops.locate(ready, F.col("min_height"), lambda h: parameters.window(h, flexible))
    return written(crowns.segment(ready, tops, F.col("min_height"), F.col("watershed_connectivity")), "crowns")


def counted(reference: DataFrame, ignored: DataFrame, predicted: DataFrame, threshold: float) -> DataFrame:
    """Counts of each plot at a threshold: unique matches from 0.5 on, the best one-to-one assignment below."""
    pairs = matching.overlaps(reference, predicted)
    matches = matching.unique_matches(pairs, threshold) if threshold >= 0.5 else matching.best_matches(pairs, threshold)
    return matching.count_metrics(matching.outcomes(reference, predicted, ignored, matches), matches)


def flattened(counts: dict[float, DataFrame], *keys: str) -> DataFrame:
    """One row for each key (one in all, without): measures by threshold in columns such as f1@0.50."""
    out = None
    for t, table in counts.items():
        table = table if keys else table.withColumn("all_", F.lit(1))
        by = keys or ("all_",)
        m = matching.measures(matching.rolled_up(table, *by), *by)
        m = m.select(*by, *[F.col(own).alias(f"{name}@{t:.2f}") for name, own in FIELDS.items()])
        out = m if out is None else out.join(m, list(by), "full")
    return out if keys else out.drop("all_")


def evaluate(
    raster: DataFrame, reference: DataFrame, ignored: DataFrame, runs: DataFrame, *keys: str, flexible: bool = False,
    kind: str = "weighted-pq", plots: DataFrame | None = None,
) -> DataFrame:
    """Flattened measures, status and score of each key of the runs (candidate_id, say); failed ones score -1.

    ``plots`` (plot_id, collection) is needed for the source-balanced measure.
    """
    runs = parameters.with_defaults(runs)
    fit = reduce(lambda a, b: a & b, parameters.valid(flexible).values())
    runs = runs.withColumn("fit", F.coalesce(fit, F.lit(False)))
    good = runs.filter("fit")
    predicted = segmented(raster, good, flexible)
    own = good.select(F.col("run_id").alias("plot_id"), F.col("plot_id").alias("place"), *keys)
    gt, other = on_runs(reference, good), on_runs(ignored, good)
    counts = {t: written(counted(gt, other, predicted, t).join(own, "plot_id"), "counts") for t in THRESHOLDS}
    found = flattened(counts, *keys)
    if plots is not None:
        by = counts[0.5].drop("plot_id").withColumnRenamed("place", "plot_id").join(plots.select("plot_id", "collection"), "plot_id")
        by = matching.rolled_up(by, *keys, "collection")
        pq = F.coalesce(F.try_divide(F.col("iou_sum"), F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn")), F.lit(0.0))
        by = by.withColumn("pq", pq).groupBy(*keys).agg(
            F.avg("pq").alias("source_balanced_pq"), F.stddev_pop("pq").alias("source_balanced_pq_std")
        )
        found = found.join(by, list(keys), "left")
    scored = search.objective(found, kind)
    every = runs.groupBy(*keys).agg(F.min("fit").alias("fit")).join(scored, list(keys), "left")
    return every.select(
        *keys, F.when(F.col("fit"), "complete").otherwise("failed").alias("status"),
        *[F.col(f"`{c}`") for c in found.columns if c not in keys],
        F.when(F.col("fit"), F.coalesce("score", F.lit(0.0))).otherwise(-1.0).alias("score"),
    )


def reused(trials: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete trials of these candidates, candidates that are still to be run)."""
    done = trials.filter("status = 'complete'")
    return done.join(candidates.select("candidate_id"), "candidate_id", "left_semi"), search.unfinished(candidates, trials)


def routed(classes: DataFrame, frozen: DataFrame) -> DataFrame:
    """Runs of each plot (plot_id, class_index) with its class's frozen parameters (class_index, ..); none is an error."""
    lost = F.raise_error(F.concat(F.lit("no parameters for class "), F.col("class_index").cast("string")))
    there = frozen.withColumn("there", F.lit(True))
    both = classes.select("plot_id", "class_index").join(there, "class_index", "left")
    return both.filter(F.when(F.col("there"), F.lit(True)).otherwise(lost)).drop("there").withColumn("run_id", F.col("plot_id"))


def cross_validated(raster: DataFrame, reference: DataFrame, ignored: DataFrame, candidates: DataFrame, folds: DataFrame, **options):
    """(score of each candidate and fold; mean, deviation and rank of each candidate; runs of the winner on all plots)."""
    runs = runs_of(candidates, folds.select("plot_id", "fold"))
    scores = evaluate(raster, reference, ignored, runs, "candidate_id", "fold", **options).select("candidate_id", "fold", "status", "score")
    by = scores.groupBy("candidate_id").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), F.round("std", 9), "candidate_id")))
    best = candidates.join(ranked.filter("rank = 1").select("candidate_id"), "candidate_id", "left_semi")
    return scores, ranked, runs_of(best, folds.select("plot_id"))
