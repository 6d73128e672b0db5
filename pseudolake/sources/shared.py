"""Folders and tables that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that isn't set, and on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that its executors share")
        base = tempfile.mkdtemp(prefix="pseudolake-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes a table that is used more than once to the shared folder and reads it from there: its size is known from then on."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals a table of fewer splits than cores out by its keys, before costly work on each row; larger tables stay as they are.

    It is dealt by a hash of the keys, as a join on keys by which a table is dealt into a fixed number of partitions takes
    that number for its other side, whose small partitions are then merged apart (Can't zip RDDs).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, F.xxhash64(*keys)) if df._jdf.rdd().getNumPartitions() < cores else df
