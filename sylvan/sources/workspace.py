"""Tables that a plan reads more than once, written to the folder that the session names in ``spark.checkpoint.dir``.

A lost executor then costs a re-read, never a recomputation from a dead local disk.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; one of our own only in a local session that names none (tests), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        found = spark.conf.get("sylvan.shared.dir", None)
        if found is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="sylvan-shared-")
            spark.conf.set("sylvan.shared.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sylvan-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
