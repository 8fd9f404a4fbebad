"""Lloyd's k-means: seeds are the first k rows by id (or random), at most 20 rounds, dead centroids stay NaN.

The points stay where they are; only centroids (k rows, checked) and each task's k partial sums travel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 20
#: Doubles in all centroids together: 80 MB.
BOUND = 10_000_000


def _matrix(vectors) -> np.ndarray:
    return np.array(list(vectors), dtype=np.float64)


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """sqrt(|xx + cc - 2xc|), the lowest number on ties; NaN centroids are never chosen, and 0 where all are."""
    d = np.sqrt(np.abs((x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * x @ centroids.T))
    return np.where(np.isnan(d), np.inf, d).argmin(1)


def seeds(points: DataFrame, k: int, init: str = "first", seed: int = 0) -> np.ndarray:
    """The first k rows by id, or ("random") by a seeded hash of the id."""
    order = ["id"] if init == "first" else [F.xxhash64(F.lit(seed), "id"), "id"]
    rows = points.select("id", "vector").orderBy(*order).limit(k).collect()
    out = _matrix(r["vector"] for r in rows)
    if out.size > BOUND:
        raise ValueError(f"{k} centroids of {out.shape[1]} dimensions are more than {BOUND} numbers")
    return out


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The columns of points and cluster (int)."""
    @F.pandas_udf("int")
    def pick(v: pd.Series) -> pd.Series:
        return pd.Series(nearest_centroid(_matrix(v), centroids).astype(np.int32)) if len(v) else pd.Series([], dtype=np.int32)

    return points.withColumn("cluster", pick(F.col("vector").cast("array<double>")))


def step(points: DataFrame, centroids: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """New centroids, and how many assignments differ from those under `before` (None: all)."""
    k, dims = centroids.shape

    def partial(batches):
        sums, counts, changed = np.zeros((k, dims)), np.zeros(k, np.int64), 0
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["vector"])
                own = nearest_centroid(x, centroids)
                np.add.at(sums, own, x)
                counts += np.bincount(own, minlength=k)
                changed += len(x) if before is None else int((own != nearest_centroid(x, before)).sum())
        yield pd.DataFrame({"c": np.arange(k), "n": counts, "changed": [changed] + [0] * (k - 1), "sums": list(sums)})

    parts = points.select(F.col("vector").cast("array<double>").alias("vector")).mapInPandas(partial, "c int, n bigint, changed bigint, sums array<double>")
    each = parts.select("c", "n", "changed", F.posexplode("sums").alias("dim", "s")).groupBy("c", "dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("changed").alias("changed"))
    out, moved = np.full((k, dims), np.nan), 0
    for r in each.collect():  # k * dims rows, within BOUND
        if r["n"]:
            out[r["c"], r["dim"]] = r["s"] / r["n"]
        moved += r["changed"] if r["dim"] == 0 else 0
    return out, moved


def fit(points: DataFrame, k: int, rounds: int = ROUNDS, init: str | np.ndarray = "first", seed: int = 0) -> tuple[np.ndarray, list[int]]:
    """Centroids after the last update, and the changed assignments of each round. points: id, vector."""
    centroids = init if isinstance(init, np.ndarray) else seeds(points, k, init, seed)
    if not centroids.size:
        return centroids, []
    history, before = [], None
    while len(history) < rounds:
        after, changed = step(points, centroids, before)
        history.append(changed)
        before, centroids = centroids, after
        if not changed:
            break
    return centroids, history


def memberships(points: DataFrame, k: int, **how) -> DataFrame:
    """id, cluster under the final centroids."""
    return assign(points.select("id", "vector"), fit(points, k, **how)[0]).select("id", "cluster")


def centroid_table(spark, centroids: np.ndarray) -> DataFrame:
    """cluster, dim (from 1), val; zeros are left out."""
    rows = [(i, j + 1, float(x)) for i, c in enumerate(centroids) for j, x in enumerate(c) if x != 0]
    return spark.createDataFrame(rows, "cluster int, dim int, val double")


def inertia(points: DataFrame, centroids: np.ndarray) -> float:
    """Sum of squared distances to the nearest centroid."""
    def partial(batches):
        total = 0.0
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["vector"])
                total += float(((x - centroids[nearest_centroid(x, centroids)]) ** 2).sum())
        yield pd.DataFrame({"s": [total]})

    rows = points.select(F.col("vector").cast("array<double>").alias("vector")).mapInPandas(partial, "s double")
    return rows.agg(F.sum("s")).first()[0] or 0.0
