"""Exact k-nearest-neighbour classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import densify
from quarry.operators.topk import nearest


def fold_vote(classes: Column) -> Column:
    """The order-sensitive fold: classes come farthest first; the running count of a class is held against the class kept so far."""
    n = F.transform(classes, lambda c, i: F.struct(F.size(F.filter(F.slice(classes, F.lit(1), i + 1), lambda x: x == c)).alias("n"), c.alias("c")))
    return F.aggregate(n, F.lit(0), lambda m, x: F.when(x["n"] > m, x["c"]).otherwise(m))


def majority_vote(classes: Column) -> Column:
    """The most frequent class; ties go to the class of the nearest neighbour among them. Classes come farthest first; null if there are none."""
    near = F.reverse(classes)
    scored = F.transform(near, lambda c, i: F.struct((-F.size(F.filter(near, lambda x: x == c))).alias("n"), i.alias("i"), c.alias("c")))
    return F.array_min(scored)["c"]


def neighbours(test: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """qid, id, dist, rank; both tables: id, vector (dense)."""
    return nearest(test, train, k)


def vote(found: DataFrame, train: DataFrame, test: DataFrame, how: str = "majority") -> DataFrame:
    """qid, label (the test row's), predicted. Tables: id, label."""
    if how not in ("majority", "fold"):
        raise ValueError(f"vote is majority or fold, not {how!r}")
    labelled = found.join(train.select("id", F.col("label").cast("int").alias("c")), "id")
    # k values for each query, so a group is small however large the tables are
    far_first = labelled.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "c")), asc=False), lambda x: x["c"]).alias("classes"))
    rows = test.select(F.col("id").alias("qid"), F.col("label").cast("int").alias("label")).join(far_first, "qid", "left")
    classes = F.coalesce("classes", F.array().cast("array<int>"))
    return rows.select("qid", "label", (fold_vote if how == "fold" else majority_vote)(classes).cast("int").alias("predicted"))


def classify(test: DataFrame, train: DataFrame, k: int, how: str = "majority") -> DataFrame:
    """qid, label, predicted. Tables: id, label, vector."""
    return vote(neighbours(test, train, k), train, test, how)


def from_sparse(rows: DataFrame, dims: int, first: int = 1) -> DataFrame:
    """id, label, vector from id, label, features."""
    return rows.select("id", "label", densify("features", dims, first).alias("vector"))
