"""Studies: designs, surrogate proposals, work lists of candidates over folds, validation."""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.functions import parameters
from sylvan.operators import search


def first_in_cell(heights: DataFrame) -> DataFrame:
    order = Window.partitionBy("plot_id", "row_", "col").orderBy(F.desc("h"), "tree_id")
    return heights.withColumn("r", F.row_number().over(order)).filter("r = 1").select("plot_id", "row_", "col", "tree_id")


def score_vectors(trials: DataFrame, sources: list[str]) -> DataFrame:
    return trials.groupBy("candidate_id").pivot("source", sources).agg(F.max("score"))


def latin_hypercube(spark: SparkSession, n: int, dimensions: int, seed: int) -> DataFrame:
    """n designs: in each dimension one in each of n equal strata. The driver holds n rows, the size of a study."""
    rng = np.random.default_rng(seed)
    u = (np.argsort(rng.random((n, dimensions)), axis=0) + rng.random((n, dimensions))) / n
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(u)], "candidate_id long, u array<double>")


def initial_candidates(spark: SparkSession, n: int, seed: int, profile: str = "broad", tune_min_height: bool = False) -> DataFrame:
    """The baseline first (candidate 0), then decoded designs; of equal parameter sets the first stays."""
    names = list(parameters.BASELINE)
    designs = parameters.named(parameters.decode(latin_hypercube(spark, n, 9, seed), profile), tune_min_height)
    designs = designs.select((F.col("candidate_id") + 1).alias("candidate_id"), *names)
    base = spark.range(1).select(F.lit(0).cast("bigint").alias("candidate_id"), *[F.lit(v).alias(k) for k, v in parameters.BASELINE.items()])
    return search.first_of_equal(base.unionByName(designs), "candidate_id", *names)


def scored_designs(spark: SparkSession, n: int, dimensions: int, seed: int) -> DataFrame:
    """Designs with scores of three sources, a smooth function of the design: a study to propose from."""
    peak = lambda a: F.exp(-F.aggregate("u", F.lit(0.0), lambda s, x: s + (x - a) * (x - a)))
    d = latin_hypercube(spark, n, dimensions, seed)
    return d.withColumn("source", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).withColumn(
        "score", F.when(F.col("source") == "a", peak(0.3)).when(F.col("source") == "b", peak(0.5)).otherwise(peak(0.4))
    )


def unpacked(d: DataFrame, dimensions: int) -> DataFrame:
    d = d.withColumns({f"x{k}": F.get("u", F.lit(k)) for k in range(dimensions)})
    return VectorAssembler(inputCols=[f"x{k}" for k in range(dimensions)], outputCol="features").transform(d)


def forest(done: DataFrame, dimensions: int, trees: int = 300, seed: int = 1):
    model = RandomForestRegressor(labelCol="score", numTrees=trees, minInstancesPerNode=2, featureSubsetStrategy="0.8", seed=seed)
    return model.fit(unpacked(done, dimensions))


def votes_of(model, x: np.ndarray) -> np.ndarray:
    """(tree, row): the prediction of each tree, read from the model's text in one call to the JVM."""
    line = re.compile(r"\s*(?:(If|Else) \(feature (\d+) (?:<=|>) (\S+)\)|Predict: (\S+)|Tree \d+ .*)$")
    out: list[np.ndarray] = []
    # rows that reach a line, innermost condition last; an Else has the rows that its If left
    inside: list[np.ndarray] = []
    left: list[np.ndarray] = []
    for text in model.toDebugString.splitlines()[1:]:
        m = line.match(text)
        if m is None:
            continue
        if m[4] is not None:
            out[-1][inside.pop()] = float(m[4])
        elif m[1] == "If":
            rows = inside.pop()
            low = x[rows, int(m[2])] <= float(m[3])
            left.append(rows[~low])
            inside.append(rows[low])
        elif m[1] == "Else":
            inside.append(left.pop())
        else:
            out.append(np.full(len(x), np.nan))
            inside.append(np.arange(len(x)))
    return np.array(out)


def predicted(model, pool: DataFrame, dimensions: int) -> list[tuple[int, float, float]]:
    """(candidate, mean, deviation over trees) of a pool, which has the size of a proposal round."""
    rows = pool.select("candidate_id", "u").collect()
    votes = votes_of(model, np.array([r.u[:dimensions] for r in rows]))
    return [(r.candidate_id, float(m), float(s)) for r, m, s in zip(rows, votes.mean(0), votes.std(0))]


def propose(spark: SparkSession, done: DataFrame, dimensions: int, pool_size: int, seed: int, kappa: float = 1.0) -> DataFrame:
    """The design of a random pool with the best upper confidence bound; the first one while fewer than five are done."""
    pool = latin_hypercube(spark, pool_size, dimensions, seed + 104729)
    mean = done.groupBy("candidate_id", "u").agg(F.avg("score").alias("score"))
    if mean.count() < 5:
        return pool.filter("candidate_id = 0")
    scored = predicted(forest(mean, dimensions, seed=seed), pool, dimensions)
    return pool.filter(F.col("candidate_id") == max(scored, key=lambda s: (s[1] + kappa * s[2], -s[0]))[0])


def propose_leave_one_out(spark: SparkSession, done: DataFrame, dimensions: int, pool_size: int, seed: int, kappa: float = 1.0) -> DataFrame:
    """A forest for each held-out source on the mean of the others; mean, less a quarter of their spread, plus doubt."""
    pool = latin_hypercube(spark, pool_size, dimensions, seed + 104729)
    sources = [r.source for r in done.select("source").distinct().orderBy("source").collect()]
    rounds = []
    for source in sources:
        rest = done.filter(F.col("source") != source).groupBy("candidate_id", "u").agg(F.avg("score").alias("score"))
        rounds.append(sorted(predicted(forest(rest, dimensions, seed=seed), pool, dimensions)))
    table = np.array([[(m, s) for _, m, s in r] for r in rounds])
    value = table[:, :, 0].mean(0) - 0.25 * table[:, :, 0].std(0) + kappa * table[:, :, 1].mean(0)
    return pool.filter(F.col("candidate_id") == rounds[0][int(value.argmax())][0])


def work_list(trials: DataFrame, plots: DataFrame, k: int) -> DataFrame:
    """The best candidates, each to be run on every plot: one job with a candidate column, counted by collection."""
    best = trials.groupBy("candidate_id").agg(F.max("score").alias("s")).orderBy(F.desc("s"), "candidate_id").limit(k)
    best = F.array(*[F.lit(r.candidate_id) for r in best.collect()])  # k rows
    return plots.withColumn("candidate_id", F.explode(best)).groupBy("candidate_id", "collection").agg(F.count("*").alias("plots"))


def validation(candidates: DataFrame, flexible: bool = False) -> DataFrame:
    """How many parameter sets there are and how many meet each rule."""
    rules = parameters.valid(flexible)
    return candidates.agg(F.count("*").alias("n"), *[F.count(F.when(rule, 1)).alias(name) for name, rule in rules.items()])
