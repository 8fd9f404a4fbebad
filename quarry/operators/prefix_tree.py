"""Item frequencies, frequent items and the prefix tree of transactions.

Transactions: tid, items (array<bigint>; repeats count). Support of an item is its occurrences over the number of
transactions that hold anything; an item is frequent if that is strictly above the threshold. Ranks go from 2 by
descending support (ties: smaller item); the root has rank 1. A transaction's path is its frequent items by descending rank; a tree node is
a prefix of a path, and counts the transactions whose path starts with it. So the whole tree is one aggregate over prefixes,
whatever way the transactions are dealt out, and merging two trees adds their counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROOT, CLOSE = -2, -1


def item_frequency(baskets: DataFrame) -> DataFrame:
    """item, freq."""
    return baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("freq"))


def max_item(baskets: DataFrame) -> DataFrame:
    """max_item: the largest id in any transaction."""
    return baskets.agg(F.max(F.array_max("items")).alias("max_item"))


def n_transactions(baskets: DataFrame) -> DataFrame:
    return baskets.filter(F.size("items") > 0).agg(F.count("*").alias("n_rows"))


def frequent_items(baskets: DataFrame, support: float) -> DataFrame:
    """item, freq, support of the items above the threshold."""
    out = item_frequency(baskets).join(F.broadcast(n_transactions(baskets)))
    return out.withColumn("support", F.col("freq") / F.col("n_rows")).filter(F.col("support") > support).select("item", "freq", "support")


def item_rank(baskets: DataFrame, support: float) -> DataFrame:
    """item, freq, rank. Supports above the threshold bound the number of items by mean items of a transaction / support, so ranking is one task."""
    order = W.orderBy(F.col("freq").desc(), "item")
    return frequent_items(baskets, support).select("item", "freq", (F.row_number().over(order) + 1).cast("bigint").alias("rank"))


def paths(baskets: DataFrame, ranks: DataFrame) -> DataFrame:
    """tid, path (array of ranks, descending), items (in the same order); transactions without a frequent item are left out."""
    kept = baskets.select("tid", F.explode("items").alias("item")).join(ranks.select("item", "rank"), "item")
    pairs = F.sort_array(F.collect_list(F.struct("rank", "item")), asc=False)
    one = kept.groupBy("tid").agg(pairs.alias("pairs"))
    return one.select("tid", F.transform("pairs", lambda p: p["rank"]).alias("path"), F.transform("pairs", lambda p: p["item"]).alias("items"))


def tree_nodes(found: DataFrame) -> DataFrame:
    """path, item, depth, cnt: a row for each node below the root. found: paths()."""
    # equal paths fold first, so a path that many transactions share is cut into prefixes once
    same = found.groupBy("path", "items").agg(F.count("*").alias("n"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("path")), lambda d: F.struct(F.slice("path", F.lit(1), d).alias("path"), F.get("items", d - 1).alias("item")))
    return same.select("n", F.inline(cuts)).groupBy("path", "item").agg(F.sum("n").cast("bigint").alias("cnt")).select("path", "item", F.size("path").alias("depth"), "cnt")


def root_count(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("cnt"))


def merge_trees(*trees: DataFrame) -> DataFrame:
    """The union of trees over the same ranks; counts of equal nodes add up."""
    out = trees[0]
    for t in trees[1:]:
        out = out.unionByName(t)
    return out.groupBy("path", "item", "depth").agg(F.sum("cnt").cast("bigint").alias("cnt")).select("path", "item", "depth", "cnt")


def prune(nodes: DataFrame, items: list[int]) -> DataFrame:
    """The nodes on the way to, or below, one of the given items: those whose path holds it, and their ancestors."""
    wanted = nodes.filter(F.col("item").isin(items)).select("path")
    up = wanted.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda d: F.slice("path", F.lit(1), d))).alias("path")).distinct()
    marked = wanted.select(F.col("path").alias("top"))
    cut = nodes.select("*", F.transform(F.sequence(F.lit(1), F.size("path")), lambda d: F.slice("path", F.lit(1), d)).alias("prefixes"))
    below = cut.select("path", F.explode("prefixes").alias("top")).join(marked, "top", "left_semi").select("path").distinct()
    return nodes.join(up.union(below).distinct(), "path", "left_semi")


def preorder(nodes: DataFrame) -> DataFrame:
    """path, item, depth, cnt, closers: how many close marks stand before a node when the tree is written in preorder.

    In the order of paths a node follows the end of its previous sibling's subtree, whose last node has the largest path in it;
    so each family of siblings is ordered on its own, and no order over all nodes is needed.
    """
    ends = nodes.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda d: F.slice("path", F.lit(1), d))).alias("top"), "path")
    last = ends.groupBy("top").agg(F.max("path").alias("last"))
    out = nodes.join(last, nodes["path"] == last["top"]).withColumn("parent", F.slice("path", F.lit(1), F.col("depth") - 1))
    before = F.lag(F.size("last")).over(W.partitionBy("parent").orderBy("path"))
    return out.select("path", "item", "depth", "cnt", F.coalesce(before - F.col("depth") + 1, F.lit(0)).cast("bigint").alias("closers"))


def serialize(nodes: DataFrame, root: int) -> tuple[list[int], list[int]]:
    """Labels (root -2, close -1) and counts in preorder, streamed to the caller in the order of paths."""
    labels, counts, depth = [ROOT], [root], 0
    for r in preorder(nodes).orderBy("path").toLocalIterator():
        labels += [CLOSE] * r["closers"] + [r["item"]]
        counts += [1] * r["closers"] + [r["cnt"]]
        depth = r["depth"]
    return labels + [CLOSE] * depth, counts + [1] * depth


def build(baskets: DataFrame, support: float) -> DataFrame:
    return tree_nodes(paths(baskets, item_rank(baskets, support)))
