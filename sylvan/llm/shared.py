"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.sources.workspace import forget, shared_dir, written

__all__ = ["WORD", "WS", "forget", "let", "read", "scan_partitions", "shared_dir", "sieve", "words", "written"]

#: ASCII white space that separates words, as the inside of a character class.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row: an expression inside a lambda runs for every element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of a text, in order; null and blank texts give an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"[{WS}]+")
    return F.filter(parts, lambda w: w != "")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scan_partitions(spark: SparkSession, data: DataFrame | None = None, bytes_each: int = 64 << 20) -> int:
    """Partitions for a shuffle of whole texts: one for each ``bytes_each`` of the plan's own size estimate, never fewer than
    the session's setting or twice its cores. Sizes that the plan does not know are no ground for more."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    least = max(own, 2 * spark.sparkContext.defaultParallelism)
    size = int(str(data._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if data is not None else 0
    return max(least, -(-size // bytes_each)) if size < 1 << 50 else least


#: Bits a key in the filter of ``sieve``, two of which it sets; its largest size in words of 64 bits (16 MB).
BITS, MOST_WORDS = 16, 1 << 21


def sieve(keys: DataFrame, most_words: int = MOST_WORDS):
    """A function of (rows, hash column) that gives (rows whose hash may be among the keys, rows whose hash is surely not).

    ``keys`` has one column of 64-bit hashes, null in none. They set bits of a filter that is broadcast, so that a join with few
    keys shuffles few rows, however many there are; about 1 in 70 other rows comes along, more beyond ``most_words``.
    The join must follow.
    """
    n = keys.count()
    if not n:
        return lambda rows, hash_: (rows.filter(F.lit(False)), rows)
    size = min(most_words, 1 << max(4, (n * BITS // 64).bit_length()))

    def fill(batches):
        bits = np.zeros(size, np.int64)
        for batch in batches:
            bits[batch.column("word").to_numpy()] = batch.column("value").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([bits], pa.list_(pa.int64()))], names=["bits"])

    def places(h: Column) -> list[tuple[Column, Column]]:
        """(word, bit) of both halves of a hash."""
        word = lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(size - 1)).cast("int")
        return [(word(x), x.bitwiseAND(F.lit(63)).cast("int")) for x in (h, F.shiftright(h, 32))]

    ones = [F.struct(w.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), b).alias("value")) for w, b in places(F.col(keys.columns[0]))]
    values = keys.select(F.explode(F.array(*ones)).alias("one")).groupBy(F.col("one.word").alias("word")).agg(F.bit_or("one.value").alias("value"))
    filter_ = written(values.coalesce(1).mapInArrow(fill, "bits array<long>"), "sieve-bits")

    def sift(rows: DataFrame, hash_: Column) -> tuple[DataFrame, DataFrame]:
        tagged = rows.withColumn("__hash", hash_)
        first, second = (F.call_function("bit_get", F.get(F.col("bits"), w), b) == 1 for w, b in places(F.col("__hash")))
        some, none = (tagged.join(F.broadcast(filter_), first & second, how).drop("__hash") for how in ("left_semi", "left_anti"))
        return some, none

    return sift
