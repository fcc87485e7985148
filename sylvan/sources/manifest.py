"""What inputs there are, how they pair up, and what is left to do, as relational checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions.scalar import finite, without_year


def requested(wanted: DataFrame, there: DataFrame, key: str, word: str = "found") -> DataFrame:
    """Each wanted key with whether it is there."""
    seen = there.select(key).distinct().withColumn("_there", F.lit(True))
    status = F.when(F.col("_there"), word).otherwise("missing")
    return wanted.join(seen, key, "left").select(key, status.alias("status"))


def duplicates(table: DataFrame, group: str, key: str) -> DataFrame:
    """Groups in which a key occurs more than once, with the number of surplus rows."""
    by = table.groupBy(group).agg((F.count("*") - F.countDistinct(key)).alias("duplicates"))
    return by.filter("duplicates > 0")


def plausible_heights(table: DataFrame) -> DataFrame:
    h = finite(F.col("height_m"))
    return table.filter((F.col("tree_id") > 0) & h.isNotNull() & (h >= 0))


def with_metadata(present: DataFrame, metadata: DataFrame) -> DataFrame:
    """Present trees with their field record; trees without one stay, without diameter."""
    return present.join(metadata.filter("dbh > 0"), ["plot_id", "tree_id"], "left")


def existing(listed: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return listed.join(there.select(key).distinct(), key, "left_semi")


def select_sources(sources: DataFrame, names: list[str], split: str | None) -> DataFrame:
    found = sources.filter(F.col("name").isin(names)) if names else sources
    return found.filter(F.col("split") == split) if split else found


def reference_system(sources: DataFrame, fallback: dict[str, str], other: str) -> DataFrame:
    """The header's system, or that of the collection."""
    by = F.coalesce(*[F.when(F.col("collection") == k, v) for k, v in fallback.items()], F.lit(other))
    return sources.withColumn("crs", F.coalesce("header", by))


def mismatches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(*keys, F.lit(1).alias("_a")), right.select(*keys, F.lit(1).alias("_b"))
    both = a.join(b, keys, "full").filter("_a is null or _b is null")
    return both.select(*keys, F.when(F.col("_b").isNull(), "missing").otherwise("extra").alias("problem"))


def validated(table: DataFrame, keys: list[str], size: str) -> DataFrame:
    null = F.greatest(*[F.col(k).isNull().cast("int") for k in [*keys, keys[-1]]])
    return table.agg(
        F.count("*").alias("crowns"), (F.count("*") - F.countDistinct(*keys)).alias("duplicate_ids"),
        F.count(F.when(null == 1, 1)).alias("null_ids"), F.count(F.when(F.col(size) <= 0, 1)).alias("empty_"),
    )


def match_names(sources: DataFrame, records: DataFrame) -> DataFrame:
    """Records by exact name, else by the name without its year where only one record has that."""
    loose = records.groupBy(without_year(F.col("name")).alias("loose")).agg(F.count("*").alias("n"), F.min("name").alias("name2"), F.min("k").alias("k2"))
    exact = records.select(F.col("name").alias("name1"), "k")
    found = sources.withColumn("loose", without_year(F.col("name"))).join(exact, F.col("name") == F.col("name1"), "left")
    found = found.join(loose.filter("n = 1"), "loose", "left")
    return found.select("id", "name", F.coalesce("name1", "name2").alias("matched"), F.coalesce("k", "k2").alias("k"))


def manifest(sources: DataFrame) -> DataFrame:
    name = F.lower("name")
    file = lambda kind: F.concat(F.lit(f"{kind}/"), name, F.lit(".parquet")).alias(f"{kind}_file")
    return sources.select("plot_id", name.alias("dataset_id"), "collection", "split", file("chm"), file("gt"))


def protocol(work: DataFrame, tops: DataFrame, crowns: DataFrame, key: str) -> DataFrame:
    """Both outputs there: skipped; one of them: error; none: run."""
    there = lambda d, n: d.select(key, F.lit(1).alias(n))
    found = work.join(there(tops, "_t"), key, "left").join(there(crowns, "_c"), key, "left")
    n = F.coalesce("_t", F.lit(0)) + F.coalesce("_c", F.lit(0))
    return found.select(key, F.when(n == 2, "skipped").when(n == 1, "error").otherwise("run").alias("status"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of each file under a path, in any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def unmapped(listed: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Keys that have no mapping, and mappings without a listed key, with what is wrong: should be none."""
    a = listed.select(key).distinct().withColumn("_a", F.lit(1))
    b = mapping.select(key).distinct().withColumn("_b", F.lit(1))
    wrong = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra")
    return a.join(b, key, "full").select(key, wrong.alias("problem")).filter("problem is not null")
