"""Searches over parameters: leaderboards, leave-one-source-out selection, splits and folds, set operations on trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions.scalar import finite_or_zero


def leaderboard(trials: DataFrame) -> DataFrame:
    """Rank of each trial in its phase: best score first, failed ones last, ties by candidate."""
    failed = (F.col("status") == "failed").cast("int")
    order = Window.partitionBy("phase").orderBy(failed, F.desc("score"), "candidate_id", "source")
    return trials.withColumn("rank", F.row_number().over(order).cast("bigint"))


def source_leaderboard(trials: DataFrame) -> DataFrame:
    by = trials.groupBy("candidate_id").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"), F.count("*").alias("sources")
    )
    return by.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "candidate_id")).cast("bigint"))


def steadiest(trials: DataFrame) -> DataFrame:
    """Best mean first, then least deviation."""
    by = trials.groupBy("candidate_id").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    place = Window.orderBy(F.desc("mean"), F.round("std", 9), "candidate_id")
    return by.withColumn("rank", F.row_number().over(place).cast("bigint"))


def top_of_each(trials: DataFrame, k: int) -> DataFrame:
    """The k best of each source; of each candidate among them, the sources."""
    order = Window.partitionBy("source").orderBy(F.desc("score"), "candidate_id")
    best = trials.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    return best.groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max("score").alias("score"))


def winner(trials: DataFrame) -> DataFrame:
    return trials.orderBy(F.desc("score"), "candidate_id", "source").limit(1)


def leave_one_source_out(trials: DataFrame) -> DataFrame:
    """For each held-out source: the candidate with the best mean over the others, and its score on the source."""
    whole = Window.partitionBy("candidate_id")
    rest = F.try_divide(F.sum("score").over(whole) - F.col("score"), F.count("*").over(whole) - 1)
    found = trials.filter("score is not null").withColumn("rest", rest).filter("rest is not null")
    order = Window.partitionBy("source").orderBy(F.desc(F.round("rest", 9)), "candidate_id")
    best = found.withColumn("r", F.row_number().over(order)).filter("r = 1")
    return best.select(F.col("source").alias("held_out"), "candidate_id", F.col("rest").alias("selection_score"), F.col("score").alias("held_out_score"))


def shuffled(key: Column, seed: int) -> Column:
    """A sort key that shuffles by a seed, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_split(plots: DataFrame, seed: int = 20260915) -> DataFrame:
    """tune, validation or test for each plot: about 60, 20 and 20 % of each group, never an empty tune."""
    group = Window.partitionBy("collection")
    n = F.count("*").over(group)
    place = F.row_number().over(group.orderBy(shuffled(F.col("plot_id"), seed)))
    tune, val = F.greatest(F.lit(1.0), F.rint(0.6 * n)), F.greatest(F.lit(1.0), F.rint(0.2 * n))
    tune = F.when((tune + val >= n) & (n >= 3), F.greatest(F.lit(1.0), n - val - 1)).otherwise(tune)
    val = F.least(val, n - tune)
    split = F.when(place <= tune, "tune").when(place <= tune + val, "validation").otherwise("test")
    found = plots.select("plot_id", "collection", split.alias("split"), place.alias("place"))
    return rebalanced(found).select("plot_id", "collection", "split")


def rebalanced(found: DataFrame) -> DataFrame:
    """No split stays empty: the largest one (the first of equal ones) gives its last plot. Three counts reach the driver."""
    names = ("tune", "validation", "test")
    size = dict.fromkeys(names, 0) | {r.split: r.n for r in found.groupBy("split").agg(F.count("*").alias("n")).collect()}
    for empty in names[1:]:
        if size[empty] or not any(size.values()):
            continue
        donor = max(names, key=size.get)
        if size[donor] <= 1:
            raise ValueError("too few plots for three splits")
        last = found.filter(F.col("split") == donor).orderBy(F.desc("collection"), F.desc("place"), F.desc("plot_id")).first()
        found = found.withColumn("split", F.when(F.col("plot_id") == last.plot_id, empty).otherwise(F.col("split")))
        size[donor], size[empty] = size[donor] - 1, 1
    return found


def fold_starts(groups: list[tuple[str, int]], k: int) -> dict[str, int]:
    """The fold that each group's dealing starts with: the smallest so far, the first of equal ones."""
    sizes, starts = [0] * k, {}
    for name, n in sorted(groups):
        starts[name] = start = sizes.index(min(sizes))
        for i in range(n):
            sizes[(start + i) % k] += 1
    return starts


def stratified_folds(plots: DataFrame, k: int = 5, seed: int = 20260919) -> DataFrame:
    """Fold of each plot: groups are shuffled and dealt out in turn. The driver sees one row a group."""
    sizes = [(r.collection, r.n) for r in plots.groupBy("collection").agg(F.count("*").alias("n")).collect()]
    starts = fold_starts(sizes, k)
    start = F.create_map(*[F.lit(x) for kv in sorted(starts.items()) for x in kv])[F.col("collection")]
    place = F.row_number().over(Window.partitionBy("collection").orderBy(shuffled(F.col("plot_id"), seed))) - 1
    return plots.select("plot_id", "collection", F.pmod(start + place, F.lit(k)).cast("int").alias("fold"))


def round_robin(plots: DataFrame, most: int, seed: int = 20260915) -> DataFrame:
    """A subset of plots: one of each group in turn, groups in order, members shuffled."""
    place = F.row_number().over(Window.partitionBy("collection").orderBy(shuffled(F.col("plot_id"), seed)))
    return plots.withColumn("turn", place.cast("bigint")).orderBy("turn", "collection").limit(most)


def unfinished(candidates: DataFrame, trials: DataFrame) -> DataFrame:
    done = trials.filter("status = 'complete'").select("candidate_id")
    return candidates.join(done, "candidate_id", "left_anti")


def first_of_equal(candidates: DataFrame, order: str, *parameters: str) -> DataFrame:
    """Candidates without later ones that have the same parameters."""
    return candidates.withColumn("r", F.row_number().over(Window.partitionBy(*parameters).orderBy(order))).filter("r = 1").drop("r")


#: Weights of panoptic quality by threshold.
OBJECTIVE_WEIGHTS = {0.25: 0.2, 0.5: 0.6, 0.75: 0.2}


def objective(metrics: DataFrame, kind: str = "weighted-pq") -> DataFrame:
    """The score of each row of flattened metrics; what is undefined or not finite counts 0."""
    name = {"pq": "panoptic_quality", "f1": "f1", "mean-iou": "mean_iou", "area-iou": "area_iou"}
    value = lambda n: finite_or_zero(F.col(f"`{n}`"))
    if kind == "weighted-pq":
        score = sum((w * value(f"panoptic_quality@{t:.2f}") for t, w in OBJECTIVE_WEIGHTS.items()), F.lit(0.0))
    elif kind == "source-balanced-pq":
        score = value("source_balanced_pq")
    else:
        score = value(f"{name[kind]}@0.50")
    return metrics.withColumn("score", score)
