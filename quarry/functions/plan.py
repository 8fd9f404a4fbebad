"""Helpers on plans: cutting lineage, checked broadcasts, positions in an order."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the cluster shares. Where that is unset, one of its own on a local master; elsewhere an error."""
    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", "") and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it from there, so that what made it is not run again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """Marks df for broadcast if it has `most` rows at most; else Spark picks a shuffled join. df should be cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


SPLIT = ("__file", "__start")


def with_split(files: DataFrame) -> DataFrame:
    """A table just read from files, with the file and the place in it that each row's split starts at."""
    return files.withColumns({"__file": F.col("_metadata.file_path"), "__start": F.col("_metadata.file_block_start")})


def with_position(df: DataFrame, order: list[str] | None = None, name: str = "pos") -> DataFrame:
    """Numbers all rows from 0 in the order of `order`, or in file order after with_split(), without moving them to one task.

    Rows are numbered inside each range or split, where they stand; a table of the sizes of these (a row for each) gives the offsets.
    """
    columns, by = [c for c in df.columns if c not in SPLIT], [c for c in SPLIT if c in df.columns]
    if order:
        n = max(1, df.rdd.getNumPartitions())
        df, by = df.repartitionByRange(n, *order).sortWithinPartitions(*order), []
    if not by:
        df, by = df.withColumn("__part", F.spark_partition_id()), ["__part"]
    placed = cut(df.withColumn("__at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(W.orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = broadcast_if(cut(sizes.select(*by, (before - F.col("__first")).alias("__shift"))), 1_000_000)
    return placed.join(offsets, by).select(*columns, (F.col("__shift") + F.col("__at")).cast("bigint").alias(name))
