"""Writing results: staged, read back and checked, then put in place."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raster_statistics(raster: DataFrame) -> DataFrame:
    return raster.filter("h is not null").groupBy("plot_id").agg(
        F.min("h").alias("min_"), F.max("h").alias("max_"), F.avg("h").alias("mean"), F.stddev_pop("h").alias("std"), F.count("*").alias("valid")
    )


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def write_checked(df: DataFrame, path: str, keys: list[str], overwrite: bool = False) -> int:
    """Writes next to the target, checks the row count and that keys are unique, then renames; returns the rows."""
    spark = df.sparkSession
    system, target, make = file_system(spark, path)
    if system.exists(target) and not overwrite:
        raise FileExistsError(path)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    back = spark.read.parquet(staged)
    n, distinct = back.agg(F.count("*"), F.countDistinct(*keys)).first()
    if n != distinct:
        system.delete(make(staged), True)
        raise ValueError(f"{n - distinct} rows repeat a key of {keys}")
    if overwrite:
        system.delete(target, True)
    system.rename(make(staged), target)
    return n


def existing_rows(spark: SparkSession, path: str) -> int:
    """Rows of a table; 0 where it can't be read."""
    system, target, _ = file_system(spark, path)
    return spark.read.parquet(path).count() if system.exists(target) else 0


def json_safe(value):
    """NaN and infinities become null, at any depth."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [json_safe(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_json(spark: SparkSession, value, path: str) -> None:
    """Canonical JSON (sorted keys) as one text file."""
    text = json.dumps(json_safe(value), sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def content(df: DataFrame) -> tuple[int, int]:
    """Number of rows and a sum of their hashes, the same however rows are ordered."""
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(hashed), F.lit(0))).first()
    return n, int(total)


def write_together(tables: dict[str, tuple[DataFrame, list[str]]], overwrite: bool = False, same_keys: bool = False) -> dict[str, int]:
    """Replaces several tables (path: rows and key) together or not at all; returns the rows of each.

    All are staged first, read back and compared with what was to be written; keys must be unique, and with ``same_keys`` the
    tables must hold the same ones.  Old tables are put aside and come back if any rename fails.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    token, staged, counts = uuid.uuid4().hex, {}, {}
    system, _, make = file_system(spark, next(iter(tables)))
    taken = [p for p in tables if system.exists(make(p))]
    if taken and not overwrite:
        raise FileExistsError(", ".join(taken))
    try:
        for path, (df, keys) in tables.items():
            staged[path] = f"{path}.staged-{token}"
            df.write.parquet(staged[path])
            back = spark.read.parquet(staged[path])
            if content(back) != content(df.select(*back.columns)):
                raise ValueError(f"{path} reads back otherwise than it was written")
            counts[path], distinct = back.agg(F.count("*"), F.countDistinct(*keys)).first()
            if counts[path] != distinct:
                raise ValueError(f"{path}: {counts[path] - distinct} rows repeat a key of {keys}")
        if same_keys:
            held = [content(spark.read.parquet(staged[p]).select(*keys)) for p, (_, keys) in tables.items()]
            if any(h != held[0] for h in held):
                raise ValueError("the tables hold different keys")
    except BaseException:
        for path in staged.values():
            system.delete(make(path), True)
        raise
    aside: list[str] = []
    placed: list[str] = []
    try:
        for path in taken:
            if not system.rename(make(path), make(f"{path}.old-{token}")):
                raise OSError(f"{path} can't be put aside")
            aside.append(path)
        for path, new in staged.items():
            if not system.rename(make(new), make(path)):
                raise OSError(f"{path} can't be put in place")
            placed.append(path)
    except BaseException:
        for path in placed:
            system.delete(make(path), True)
        for path in aside:
            system.rename(make(f"{path}.old-{token}"), make(path))
        raise
    for path in aside:
        system.delete(make(f"{path}.old-{token}"), True)
    return counts


def write_report(df: DataFrame, path: str, *order: str) -> None:
    """A small report as one CSV file with a header, in a fixed order of rows; numbers that are not finite are empty."""
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    columns = [F.when(F.abs(F.col(f"`{c}`")) < float("inf"), F.col(f"`{c}`")).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns]
    df.select(*columns).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
