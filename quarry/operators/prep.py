"""Dataset preparation: splits in file order, label remapping, one-hot, standardising, seeded batches, weighted choice."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.plan import SPLIT, cut, with_position, with_split
from quarry.functions.vectors import one_hot


def split_in_order(df: DataFrame, validation: float, test: float, order: list[str] | None = None) -> DataFrame:
    """The columns of df, pos (from 0) and part: train rows first, then validation, then test; shares are percent, sizes floors."""
    rows = with_position(df, order)
    n = rows.count()
    n_test, n_validation = math.floor(n * test / 100), math.floor(n * validation / 100)
    n_train = n - n_test - n_validation
    part = F.when(F.col("pos") < n_train, "train").when(F.col("pos") < n_train + n_validation, "validation").otherwise("test")
    return rows.withColumn("part", part)


def split_validation_first(df: DataFrame, validation: float, order: list[str] | None = None) -> DataFrame:
    """The same for image sets: the first rows are validation, the rest train."""
    rows = with_position(df, order)
    return rows.withColumn("part", F.when(F.col("pos") < math.floor(rows.count() * validation / 100), "validation").otherwise("train"))


def class_range(df: DataFrame, label: str = "label") -> DataFrame:
    """least, most, classes: labels are 0 .. c - 1, or -1 and 1."""
    low, high = F.min(label), F.max(label)
    return df.agg(low.alias("least"), high.alias("most"), F.when(low == -1, 2).otherwise(high + 1).cast("int").alias("classes"))


def remap_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """-1 becomes 0."""
    return df.withColumn(label, F.when(F.col(label) == -1, 0).otherwise(F.col(label)))


def with_one_hot(df: DataFrame, classes: int | None = None, label: str = "label", name: str = "onehot") -> DataFrame:
    if classes is None:
        classes = class_range(df, label).first()["classes"] or 1
    return df.withColumn(name, one_hot(label, classes))


def column_stats(train: DataFrame, columns: list[str]) -> DataFrame:
    """column, mean, sd (population) over all rows."""
    aggs = [x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    one = train.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("sd")) for c in columns])))


def standardize(df: DataFrame, columns: list[str], part: str | None = "part") -> DataFrame:
    """(x - mean) / sd with the figures of the train rows, for all rows; where sd is 0, x stays as it is."""
    train = df.filter(F.col(part) == "train") if part else df
    stats = train.agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    out = df.join(F.broadcast(stats))
    for c in columns:
        m, s = F.col(f"__m_{c}"), F.col(f"__s_{c}")
        out = out.withColumn(c, F.when(s > 0, (F.col(c) - m) / F.when(s > 0, s)).otherwise(F.col(c)))
    return out.select(*df.columns)


def read_csv(spark: SparkSession, path: str, validation: float = 0, test: float = 0, scale: bool = True) -> DataFrame:
    """id, part, label, x (array<double>), onehot of a headerless CSV whose column 0 is the label."""
    raw = spark.read.option("inferSchema", "false").csv(path)
    rows = with_split(raw).select(*SPLIT, F.col("_c0").cast("double").cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in raw.columns[1:]])
    rows = split_in_order(rows, validation, test)
    if scale:
        rows = standardize(rows, raw.columns[1:])
    classes = class_range(rows).first()["classes"] or 1
    return with_one_hot(remap_labels(rows), classes).select(F.col("pos").alias("id"), "part", "label", F.array(*raw.columns[1:]).alias("x"), "onehot")


def batches(df: DataFrame, size: int, epoch: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    """The columns of df and batch: a new seeded order in each epoch, cut into batches of `size`; the last may be short."""
    shuffled = with_position(df.withColumn("__r", F.xxhash64(F.lit(seed), F.lit(epoch), id_col)), ["__r", id_col])
    return shuffled.withColumn("batch", F.floor(F.col("pos") / size).cast("bigint")).drop("__r", "pos")


def weighted_choice(weights: DataFrame, u: float, id_col: str = "id", weight: str = "weight") -> DataFrame:
    """The row whose share of the running sum of weights (by id) holds u, a number of 0 to 1.

    Sums of each task's range of ids come first; only the range that holds u is summed up row by row.
    """
    rows = cut(weights.repartitionByRange(id_col).withColumn("__part", F.spark_partition_id()))
    sums = rows.groupBy("__part").agg(F.sum(weight).alias("s")).orderBy("__part").collect()
    aim, before = u * sum(r["s"] or 0 for r in sums), 0.0
    for r in sums:  # one for each task
        if before + (r["s"] or 0) > aim:
            own = rows.filter(F.col("__part") == r["__part"])
            upto = F.sum(weight).over(W.partitionBy("__part").orderBy(id_col).rowsBetween(W.unboundedPreceding, W.currentRow))
            return own.withColumn("__upto", upto).filter(F.col("__upto") > aim - before).orderBy(id_col).limit(1).select(*weights.columns)
        before += r["s"] or 0
    return weights.limit(0)
