"""Tables of the domain, derived from the star-schema tables that a session can read.

Coordinates are dyadic rationals, so that sums and comparisons are exact in any order.  No-data is NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plot_id, tree_id (0: unlabelled), x, y, z, cls (2 ground, 3 outside, 4-6 tree)."""
    line, supplier = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    spread = lambda a, b, c: (
        ((F.col("l_partkey") * a + F.col("l_orderkey") * b + F.col("l_linenumber") * c) % 512).cast("double") / 16 - 16
    )
    return line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").cast("bigint").alias("plot_id"),
        F.when(F.col("l_linenumber") == 7, F.lit(0).cast("bigint")).otherwise(F.col("l_suppkey") + 1).alias("tree_id"),
        spread(37, 11, 5).alias("x"),
        spread(53, 29, 7).alias("y"),
        (F.col("l_quantity") * 0.5 + (F.col("l_partkey") % 8).cast("double") / 64).alias("z"),
        F.col("l_linenumber").cast("int").alias("cls"),
    )


def tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plot_id, tree_id, height_m, completely_inside, species_code; every ninth tree has no record."""
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").filter(key % 9 != 5).select(
        F.col("s_nationkey").cast("bigint").alias("plot_id"),
        (key + 1).alias("tree_id"),
        (15 + (key * 7) % 15).cast("double").alias("height_m"),
        F.when(key % 4 != 0, 1).otherwise(0).alias("completely_inside"),
        (key % 5).cast("int").alias("species_code"),
    )


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plot_id, name, collection: a plot for each nation, collected by region."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("bigint").alias("plot_id"), F.col("n_name").alias("name"), F.col("r_name").alias("collection")
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidate_id, source, score (0 to 1), phase, status: one row per candidate and source."""
    e = read(spark, sf_dir, "events")
    one = e.groupBy((F.col("user_id") % 40).alias("candidate_id"), F.col("event_type").alias("source")).agg(
        F.sum(F.floor(F.abs("value") * 16).cast("bigint")).alias("s"), F.count("*").alias("n")
    )
    return one.select(
        "candidate_id", "source", ((F.col("s") % 1009).cast("double") / 1024).alias("score"), "n",
        F.when(F.col("candidate_id") % 3 == 0, "validation").otherwise("tune").alias("phase"),
        F.when((F.col("s") + F.col("candidate_id")) % 11 == 0, "failed").otherwise("complete").alias("status"),
    )


#: The same tables as SQL, for comparison in another engine.
SQL = {
    "points": """points AS (
  SELECT CAST(s_nationkey AS BIGINT) AS plot_id, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_suppkey + 1 END AS tree_id,
    CAST((l_partkey*37 + l_orderkey*11 + l_linenumber*5) % 512 AS DOUBLE)/16 - 16 AS x,
    CAST((l_partkey*53 + l_orderkey*29 + l_linenumber*7) % 512 AS DOUBLE)/16 - 16 AS y,
    l_quantity*CAST(0.5 AS DOUBLE) + CAST(l_partkey % 8 AS DOUBLE)/64 AS z, CAST(l_linenumber AS INT) AS cls
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)""",
    "trees": """trees AS (
  SELECT CAST(s_nationkey AS BIGINT) AS plot_id, s_suppkey + 1 AS tree_id, CAST(15 + (s_suppkey*7) % 15 AS DOUBLE) AS height_m,
    CASE WHEN s_suppkey % 4 <> 0 THEN 1 ELSE 0 END AS completely_inside, CAST(s_suppkey % 5 AS INT) AS species_code
  FROM supplier WHERE s_suppkey % 9 <> 5)""",
    "plots": """plots AS (
  SELECT CAST(n_nationkey AS BIGINT) AS plot_id, n_name AS name, r_name AS collection
  FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "trials": """trials0 AS (
  SELECT user_id % 40 AS candidate_id, event_type AS source, sum(CAST(floor(abs(value)*16) AS BIGINT)) AS s, count(*) AS n
  FROM events GROUP BY ALL), trials AS (
  SELECT candidate_id, source, CAST(s % 1009 AS DOUBLE)/1024 AS score, n,
    CASE WHEN candidate_id % 3 = 0 THEN 'validation' ELSE 'tune' END AS phase,
    CASE WHEN (s + candidate_id) % 11 = 0 THEN 'failed' ELSE 'complete' END AS status FROM trials0)""",
    "inside": """inside AS (
  SELECT *, CAST(floor((x+15)/0.5::DOUBLE) AS INT) AS col, CAST(least(floor((15-y)/0.5::DOUBLE), 59) AS INT) AS row_
  FROM points WHERE x >= -15 AND x < 15 AND y > -15 AND y <= 15)""",
    "base": "base AS (SELECT plot_id, tree_id, min(z) AS base FROM points WHERE tree_id > 0 GROUP BY ALL)",
    "heights": """heights AS (
  SELECT i.plot_id, i.tree_id, row_, col, greatest(z - base, 0) AS h, height_m, completely_inside, species_code
  FROM inside i JOIN base USING (plot_id, tree_id) JOIN trees t USING (plot_id, tree_id)
  WHERE greatest(z - base, 0) <= height_m + 0.05::DOUBLE)""",
    "chm": """chm AS (
  SELECT c.plot_id, c.row_, c.col, coalesce(t.h, 0) AS h
  FROM (SELECT DISTINCT plot_id, row_, col FROM inside) c
  LEFT JOIN (SELECT plot_id, row_, col, max(h) AS h FROM heights GROUP BY ALL) t USING (plot_id, row_, col))""",
    "winners": """winners AS (
  SELECT plot_id, row_, col, m.h AS h, -m.t AS tree_id FROM (
    SELECT plot_id, row_, col, max({'h': h, 't': -tree_id}) AS m FROM heights WHERE h >= 2 GROUP BY ALL))""",
    "gt": """gt AS (
  SELECT c.plot_id, c.row_, c.col, coalesce(w.tree_id, 0) AS tree_id
  FROM (SELECT DISTINCT plot_id, row_, col FROM inside) c LEFT JOIN winners w USING (plot_id, row_, col))""",
    "pred": """pred AS (
  SELECT plot_id, row_, col, -m.t AS tree_id FROM (
    SELECT plot_id, row_, col, max({'h': greatest(z - base, 0), 't': -tree_id}) AS m
    FROM inside JOIN base USING (plot_id, tree_id) WHERE cls <= 5 AND greatest(z - base, 0) >= 2 GROUP BY ALL))""",
}
NEEDS = {
    "inside": ["points"], "base": ["points"], "heights": ["inside", "base", "trees"], "chm": ["heights"],
    "winners": ["heights"], "gt": ["winners"], "pred": ["inside", "base"],
}


def with_sql(*names: str) -> str:
    """WITH clause of the named tables and of what they need."""
    done: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(SQL[n] for n in done)
