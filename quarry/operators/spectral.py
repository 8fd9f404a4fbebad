"""Self-tuned spectral clustering: neighbour graph, similarity, normalisation, eigenvectors, clusters.

Matrices are edge tables (i, j, w), vectors of length n are tables (id, x). Only numbers of the size of the Krylov space
are on the driver; a small problem (EDGES_BOUND) is solved there as a whole.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.plan import cut
from quarry.operators import kmeans
from quarry.operators.topk import nearest

#: Edges up to which a matrix is collected and solved in one place: 48 MB.
EDGES_BOUND = 2_000_000
EPS23 = np.finfo(float).eps ** (2 / 3)
KINDS = ("LM", "SM", "LA", "SA", "BE")


def tnn_graph(points: DataFrame, t: int = 10) -> DataFrame:
    """i, j, w: for each row the t nearest others by distance, then id. points: id, vector."""
    return nearest(points, points, t, skip_self=True).select(F.col("qid").alias("i"), F.col("id").alias("j"), F.col("dist").alias("w"))


def symmetric_closure(edges: DataFrame) -> DataFrame:
    """Every edge in both directions; where both exist the larger weight stays."""
    both = edges.select("i", "j", "w").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return both.groupBy("i", "j").agg(F.max("w").alias("w"))


def row_stats(edges: DataFrame) -> DataFrame:
    """i, n, mean, total of each row."""
    return edges.groupBy("i").agg(F.count("*").alias("n"), F.avg("w").alias("mean"), F.sum("w").alias("total"))


def _with_both(edges: DataFrame, stats: DataFrame, name: str) -> DataFrame:
    left = stats.select("i", F.col(name).alias("a"))
    right = stats.select(F.col("i").alias("j"), F.col(name).alias("b"))
    return edges.join(left, "i").join(right, "j")


def similarity(symmetric: DataFrame) -> DataFrame:
    """exp(-d^2 / (2 g_i g_j)), g the mean distance of a row; a zero mean leaves similarity 1 at distance 0, as the limit."""
    rows = _with_both(symmetric, row_stats(symmetric), "mean")
    scale = 2 * F.col("a") * F.col("b")
    w = F.when(F.col("w") == 0, 1.0).when(scale == 0, 0.0).otherwise(F.exp(-F.col("w") * F.col("w") / F.when(scale != 0, scale)))
    return rows.select("i", "j", w.alias("w"))


def normalize(similar: DataFrame) -> DataFrame:
    """s / sqrt(D_i D_j), D the sum of a row."""
    rows = _with_both(similar, row_stats(similar), "total")
    d = F.sqrt(F.col("a") * F.col("b"))
    return rows.select("i", "j", F.when(d == 0, 0.0).otherwise(F.col("w") / F.when(d != 0, d)).alias("w"))


def matvec(edges: DataFrame, x: DataFrame, value: str = "x") -> DataFrame:
    """id, y: y = Ax; rows of A without an entry are left out."""
    return edges.join(x.select(F.col("id").alias("j"), F.col(value).alias("x")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("x")).alias("y")).withColumnRenamed("i", "id")


def wanted(values: np.ndarray, num: int, kind: str) -> np.ndarray:
    """Places of the num wanted of ascending values, the most wanted first."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    n = len(values)
    if kind == "LM":
        order = np.argsort(-np.abs(values), kind="stable")
    elif kind == "SM":
        order = np.argsort(np.abs(values), kind="stable")
    elif kind == "SA":
        order = np.arange(n)
    elif kind == "LA":
        order = np.arange(n)[::-1]
    else:  # both ends, one more from the high end if num is odd
        order = np.array([x for k in range(n) for x in ((n - 1 - k // 2,) if k % 2 == 0 else (k // 2,))][:n])
    return order[:num]


def _signed(v: np.ndarray) -> np.ndarray:
    """Each column with its component of largest magnitude positive."""
    top = np.abs(v).argmax(0)
    return v * np.where(v[top, np.arange(v.shape[1])] < 0, -1.0, 1.0)


def _start(n_or_ids) -> np.ndarray:
    ids = np.arange(n_or_ids) if isinstance(n_or_ids, int) else n_or_ids
    return np.sin(ids.astype(float) * 12.9898 + 78.233) + 1.5


def lanczos_local(multiply, ids: np.ndarray, num: int, space: int, kind: str = "LA", max_iter: int = 300, tol: float = 1e-10):
    """Thick-restart Lanczos with full re-orthogonalisation over a matvec on arrays: values, vectors (n by num), residual bounds."""
    n = len(ids)
    space, num = min(space, n), min(num, n)
    basis, proj = np.zeros((n, space + 1)), np.zeros((space, space))
    start = _start(ids)
    basis[:, 0] = start / np.linalg.norm(start)
    kept, rng = 0, np.random.default_rng(5)
    for _ in range(max_iter):
        beta = 0.0
        for k in range(kept, space):
            w = multiply(basis[:, k])
            h = basis[:, : k + 1].T @ w
            w = w - basis[:, : k + 1] @ h
            again = basis[:, : k + 1].T @ w
            w -= basis[:, : k + 1] @ again
            h += again
            proj[: k + 1, k] = h
            proj[k, : k + 1] = h
            beta = float(np.linalg.norm(w))
            if beta < 1e-13 and k + 1 < space:  # an invariant space: go on from a fresh direction
                w = rng.normal(size=n)
                for _ in range(2):
                    w -= basis[:, : k + 1] @ (basis[:, : k + 1].T @ w)
                basis[:, k + 1] = w / np.linalg.norm(w)
                beta = 0.0
            elif beta >= 1e-13:
                basis[:, k + 1] = w / beta
        values, vecs = np.linalg.eigh((proj + proj.T) / 2)
        at = wanted(values, num, kind)
        bounds = np.abs(beta * vecs[-1, at])
        if space == n or (bounds <= tol * np.maximum(EPS23, np.abs(values[at]))).all():
            break
        keep = wanted(values, min(space - 1, num + max(1, (space - num) // 2)), kind)
        last, border = basis[:, space].copy(), beta * vecs[-1, keep]
        basis[:, : len(keep)] = basis[:, :space] @ vecs[:, keep]
        basis[:, len(keep)] = last
        kept = len(keep)
        proj[:] = 0
        proj[np.arange(kept), np.arange(kept)] = values[keep]
        if kept < space:
            proj[:kept, kept] = proj[kept, :kept] = border
    return values[at], _signed(basis[:, :space] @ vecs[:, at]), bounds


def _combined(weights: np.ndarray):
    """The sum of the basis (array v of a row) by weights, as a Column."""
    return F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in weights]), lambda p, q: p * q), F.lit(0.0), lambda acc, x: acc + x)


def _without_basis(step: DataFrame, size: int) -> tuple[DataFrame, np.ndarray, float]:
    """w less its part in the basis, taken off twice; the coefficients of both together; the norm of what is left."""
    sums = [F.sum(F.col("w") * F.get("v", F.lit(a))) for a in range(size)]
    less = lambda hs: F.col("w") - _combined(np.asarray(hs))
    h = np.array(step.agg(*sums).first(), float)
    step = step.withColumn("w", less(h))
    row = step.agg(*sums, F.sum(F.col("w") * F.col("w"))).first()
    again = np.array(row[:-1], float)
    return step.withColumn("w", less(again)), h + again, math.sqrt(max(0.0, row[-1] - float((again**2).sum())))


def _lanczos_spark(edges: DataFrame, ids: DataFrame, num: int, space: int, kind: str, max_iter: int, tol: float):
    """lanczos_local with the basis as a table (id, array): two passes and one write for each vector of it; a restart is one more."""
    start = F.sin(F.col("id").cast("double") * 12.9898 + 78.233) + 1.5
    n, total = ids.agg(F.count("*"), F.sum(start * start)).first()
    space, num = min(space, n), min(num, n)
    state = cut(ids.select("id", F.array(start / math.sqrt(total)).alias("v")))
    proj, kept = np.zeros((space, space)), 0
    for turn in range(max_iter):
        beta = 0.0
        for k in range(kept, space):
            y = matvec(edges, state.select("id", F.get("v", F.lit(k)).alias("x")))
            step = cut(state.join(y, "id", "left").select("id", "v", F.coalesce("y", F.lit(0.0)).alias("w")))
            step, h, beta = _without_basis(step, k + 1)
            proj[: k + 1, k] = proj[k, : k + 1] = h
            norm = beta
            if beta < 1e-12:
                if k + 1 == space:
                    break
                # an invariant space: go on from a fresh direction
                fresh = cut(state.withColumn("w", F.sin(F.col("id").cast("double") * (turn + k + 1.7)) + F.cos(F.col("id").cast("double") * (k + 2.3))))
                step, _, norm = _without_basis(fresh, k + 1)
                beta = 0.0
            state = cut(step.select("id", F.concat("v", F.array(F.col("w") / norm)).alias("v")))
        values, vecs = np.linalg.eigh((proj + proj.T) / 2)
        at = wanted(values, num, kind)
        bounds = np.abs(beta * vecs[-1, at])
        if space == n or (bounds <= tol * np.maximum(EPS23, np.abs(values[at]))).all():
            break
        keep = wanted(values, min(space - 1, num + max(1, (space - num) // 2)), kind)
        kept, border = len(keep), beta * vecs[-1, keep]
        if turn + 1 < max_iter:
            padded = np.vstack([vecs, np.zeros((1, space))])  # the last vector of the basis, the residual, is no part of them
            state = cut(state.select("id", F.array(*[_combined(padded[:, a]) for a in keep], F.get("v", F.lit(space))).alias("v")))
        proj[:] = 0
        proj[np.arange(kept), np.arange(kept)] = values[keep]
        if kept < space:
            proj[:kept, kept] = proj[kept, :kept] = border
    cols = F.array(*[_combined(np.append(vecs[:, a], 0.0)) for a in at])
    out = cut(state.withColumn("v", F.when(F.size("v") > space, F.col("v")).otherwise(F.concat("v", F.array(F.lit(0.0))))).select("id", cols.alias("v")))
    tops = out.agg(*[F.max_by(F.get("v", F.lit(c)), F.struct(F.abs(F.get("v", F.lit(c))), -F.col("id"))) for c in range(len(at))]).first()
    signs = F.array(*[F.lit(-1.0 if x < 0 else 1.0) for x in tops])
    return values[at], out.select("id", F.zip_with("v", signs, lambda x, s: x * s).alias("v")), bounds


def eigenpairs(edges: DataFrame, num: int, space: int | None = None, kind: str = "LA", max_iter: int = 300, tol: float = 1e-10, bound: int = EDGES_BOUND):
    """values (numpy), vectors (table id, v: array of num numbers), bounds on the residuals.

    edges: a symmetric matrix; its rows are the ids that occur. Above `bound` edges the basis is a table; the method, and what max_iter and
    tol mean, stay the same. Where the bounds do not come below tol (relative to the values) in max_iter restarts, this is an error.
    """
    space = max(space or 0, 2 * num + 1, 20)
    edges = cut(edges.select("i", "j", "w"))
    ids = edges.select(F.col("i").alias("id")).union(edges.select("j")).distinct()
    if edges.count() > bound:
        return _settled(*_lanczos_spark(edges, cut(ids), num, space, kind, max_iter, tol), space, tol)
    pdf = edges.toPandas()
    all_ids = np.unique(np.concatenate([pdf["i"].to_numpy(), pdf["j"].to_numpy()])) if len(pdf) else np.zeros(0, np.int64)
    spark = edges.sparkSession
    if not len(all_ids):
        return np.zeros(0), spark.createDataFrame([], "id bigint, v array<double>"), np.zeros(0)
    a, b, w = np.searchsorted(all_ids, pdf["i"]), np.searchsorted(all_ids, pdf["j"]), pdf["w"].to_numpy()
    values, vectors, bounds = lanczos_local(lambda x: np.bincount(a, w * x[b], len(all_ids)), all_ids, num, space, kind, max_iter, tol)
    rows = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(all_ids, vectors)], "id bigint, v array<double>")
    return _settled(values, rows, bounds, min(space, len(all_ids)) if space < len(all_ids) else 0, tol)


def _settled(values, vectors, bounds, space: int, tol: float):
    """space: 0 where the whole space was searched, so that there is nothing left."""
    if space and (bounds > tol * np.maximum(EPS23, np.abs(values))).any():
        raise RuntimeError(f"eigenvalues have not settled: bounds {bounds}")
    return values, vectors, bounds


def spectral_clusters(points: DataFrame, clusters: int, t: int = 10, num: int | None = None, kind: str = "LA", unit_rows: bool = False, init: str = "first", rounds: int = 20) -> DataFrame:
    """id, cluster: graph, similarity, normalisation, leading eigenvectors, k-means on their rows."""
    a = normalize(similarity(symmetric_closure(tnn_graph(points, t))))
    _, vectors, _ = eigenpairs(a, num or clusters, kind=kind)
    rows = vectors.select("id", F.col("v").alias("vector"))
    if unit_rows:
        n = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x))
        rows = rows.select("id", F.transform("vector", lambda x: F.when(n == 0, 0.0).otherwise(x / F.when(n != 0, n))).alias("vector"))
    return kmeans.memberships(rows, clusters, init=init, rounds=rounds)
