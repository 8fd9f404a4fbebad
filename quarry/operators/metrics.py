"""Evaluation: accuracy, top-k accuracy, mean loss, running best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def accuracy(predicted: DataFrame, label: str = "label", guess: str = "predicted") -> DataFrame:
    """n, missed, accuracy (percent): 100 - missed / n * 100; null for no rows."""
    missed = F.coalesce(F.sum((~F.col(label).eqNullSafe(F.col(guess))).cast("bigint")), F.lit(0).cast("bigint"))
    n = F.count(F.lit(1))
    return predicted.agg(n.alias("n"), missed.alias("missed"), F.when(n > 0, F.round(100.0 - missed / n * 100.0, 6)).alias("accuracy"))


def in_top_k(scores, label, k: int) -> Column:
    """Whether the label (from 0) is among the k highest scores; a tie with the label's score counts for it."""
    s, y = (F.col(x) if isinstance(x, str) else x for x in (scores, label))
    own = F.get(s, y)
    return F.coalesce(F.size(F.filter(s, lambda x: x > own)) < k, F.lit(False))


def top_k_accuracy(df: DataFrame, k: int, scores: str = "scores", label: str = "label") -> DataFrame:
    """n, hits, accuracy (percent)."""
    hit = F.sum(in_top_k(scores, label, k).cast("bigint"))
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), F.coalesce(hit, F.lit(0).cast("bigint")).alias("hits"), F.when(n > 0, F.round(100.0 * hit / n, 6)).alias("accuracy"))


def running_best(history: DataFrame, order: str = "epoch", value: str = "accuracy") -> DataFrame:
    """history (a row for each epoch) with the best value so far and whether this row set it."""
    so_far = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    best = F.max(value).over(so_far)
    return history.withColumns({"best": best, "is_best": F.col(value) > F.coalesce(F.max(value).over(before), F.lit(float("-inf")))})


def drop_easy(losses: DataFrame, cutoff: float | None = None, percentile: float | None = None, loss: str = "loss") -> DataFrame:
    """Sample elimination: rows whose loss is above a cutoff, or above an exact percentile (0 to 1) of all losses."""
    if (cutoff is None) == (percentile is None):
        raise ValueError("give a cutoff or a percentile")
    if cutoff is None:
        cutoff = losses.agg(F.percentile(loss, F.lit(percentile))).first()[0]
        if cutoff is None:
            return losses
    return losses.filter(F.col(loss) > cutoff)
