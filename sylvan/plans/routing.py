"""Structural routing: plots are clustered by canopy structure, and each class runs with its own parameters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("canopy_cover", "height_p50", "height_p95", "height_sd")


def structural_features(raster: DataFrame, canopy: float = 2.0) -> DataFrame:
    """Cover, median, 95th percentile and deviation of canopy heights; zeros without canopy."""
    over = F.col("h") >= canopy
    zero = lambda x, n: F.coalesce(x, F.lit(0.0)).alias(n)
    return raster.groupBy("plot_id").agg(
        F.avg(over.cast("double")).alias("canopy_cover"), zero(F.expr(f"percentile(h, 0.5) FILTER (WHERE h >= {canopy})"), "height_p50"),
        zero(F.expr(f"percentile(h, 0.95) FILTER (WHERE h >= {canopy})"), "height_p95"),
        zero(F.stddev_pop(F.when(over, F.col("h"))), "height_sd"),
    )


def scaler(features: DataFrame) -> dict[str, tuple[float, float]]:
    """Median and interquartile range (1 where that is 0) of each feature, exact: one row of numbers, to be kept for other tables."""
    q = features.agg(*[F.expr(f"percentile({f}, array(0.25, 0.5, 0.75))").alias(f) for f in FEATURES]).first()
    return {f: (q[f][1], (q[f][2] - q[f][0]) or 1.0) if q[f] else (0.0, 1.0) for f in FEATURES}


def scaled(features: DataFrame, frozen: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Each feature less its median, over its interquartile range; by the table's own scaler or one that was kept."""
    own = scaler(features) if frozen is None else frozen
    return features.select("plot_id", *FEATURES, *[((F.col(f) - own[f][0]) / own[f][1]).alias(f"s_{f}") for f in FEATURES])


def route(features: DataFrame, k: int = 3, seed: int = 20260924) -> DataFrame:
    """plot_id, class_index: clusters in order of mean canopy cover."""
    table = VectorAssembler(inputCols=[f"s_{f}" for f in FEATURES], outputCol="features").transform(scaled(features))
    found = KMeans(k=k, seed=seed, maxIter=50, featuresCol="features").fit(table).transform(table)
    cover = found.groupBy("prediction").agg(F.avg("canopy_cover").alias("m")).orderBy("m", "prediction").collect()
    order = F.create_map(*[F.lit(x) for i, r in enumerate(cover) for x in (r.prediction, i)])
    return found.select("plot_id", order[F.col("prediction")].alias("class_index"), *FEATURES)


def nearest_centre(features: DataFrame, centres: DataFrame, most: int = 1000) -> DataFrame:
    """Class of the nearest centre, the smaller of equal ones; centres are few (a row a class), more than ``most`` an error."""
    rows = centres.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} centres")
    far = lambda r: sum(((F.col(f) - r[f"c_{f}"]) * (F.col(f) - r[f"c_{f}"]) for f in FEATURES), F.lit(0.0))
    each = F.array(*[F.struct(far(r).alias("d2"), F.lit(r.class_index).alias("class_index")) for r in rows])
    return features.select("plot_id", F.array_min(each)["class_index"].alias("class_index"))
