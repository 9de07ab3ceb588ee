"""Tables written for reuse below the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str = "table") -> str:
    """A new folder below spark.checkpoint.dir; only local mode, where one machine is all there is, may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="evidencelake-")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(rows: DataFrame, kind: str) -> DataFrame:
    """The rows, worked out once: written and read back, so that what reads them several times doesn't repeat their plan."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, kind)
    rows.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def spread(rows: DataFrame) -> DataFrame:
    """A table just read, dealt over all cores where its files give fewer parts than that; larger tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
