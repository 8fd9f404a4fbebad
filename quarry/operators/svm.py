"""Binary support vector machines with an RBF kernel, by sequential minimal optimisation.

Rows: id, label (+1 or -1), vector. Up to `bound` rows the solver runs as one task over all rows; beyond, rounds
take the most violating rows as a working set, solve that, and update the gradient of all rows where they stand. There
the vectors lie in blocks that are written once; what a round writes is labels, multipliers and gradients, without vectors.
Sets by multiplier: 0 inside the box; 1 (+1) and 4 (-1) at zero; 3 (+1) and 2 (-1) at C.
"""

from __future__ import annotations

import pickle
import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.plan import cut
from quarry.operators.topk import BLOCK, SENT, blocks, chunks, matrix

ZERO, EPS, TOL, TIE = 1e-12, 1e-20, 1e-3, 1e-10
#: Rows up to which one task solves the whole problem, and rows of a working set beyond that.
BOUND, WORKING = 20_000, 1_000
#: Rows of a kernel matrix at a time: 8 MB against a block of vectors.
SLICE = 512
#: Blocks of vectors in a partition: 32 MB at 64 dimensions.
HELD = 32
#: State of a block of vectors in the rounds; `first`, in one row of each task, has the task's candidates for the next working set.
STATE = "tb int, ids binary, y binary, alpha binary, f binary, active binary, first binary"


@dataclass
class Model:
    ids: np.ndarray
    vectors: np.ndarray
    y: np.ndarray
    alpha: np.ndarray
    threshold: float
    sigmasqr: float
    iterations: int = 0
    b_up: float = 0.0
    b_low: float = 0.0
    #: Whether the gap of all active rows is within tolerance; False where max_iter or a pair that cannot move ended it.
    converged: bool = True
    #: id, y, vector, alpha, f, active of all rows, instead of the arrays, where these could be too large for one place.
    state: DataFrame | None = None

    def support(self) -> tuple[np.ndarray, np.ndarray]:
        keep = self.alpha > ZERO
        return self.vectors[keep], (self.alpha * self.y)[keep]


def set_of(y, alpha, c: float):
    """The set number of a row, as a Column."""
    low, high = alpha <= ZERO, alpha >= c - ZERO
    return F.when(~low & ~high, 0).when((y > 0) & low, 1).when((y < 0) & high, 2).when((y > 0) & high, 3).otherwise(4)


def sets(y: np.ndarray, alpha: np.ndarray, c: float) -> np.ndarray:
    low, high = alpha <= ZERO, alpha >= c - ZERO
    return np.where(~low & ~high, 0, np.where(y > 0, np.where(low, 1, 3), np.where(high, 2, 4)))


def init_state(rows: DataFrame) -> DataFrame:
    """id, y, alpha, f, setinfo before training; a label other than +1 or -1 is an error."""
    y = F.when(F.col("label").isin(1, -1), F.col("label")).otherwise(F.raise_error(F.lit("a label must be +1 or -1"))).cast("double")
    return rows.select("id", y.alias("y")).select("id", "y", F.lit(0.0).alias("alpha"), (-F.col("y")).alias("f"), F.when(F.col("y") > 0, 1).otherwise(4).alias("setinfo"))


def select_pair(state: DataFrame) -> DataFrame:
    """One row: b_up and i_up (smallest f over sets 0, 1, 2), b_low and i_low (largest over 0, 3, 4), lowest id on ties."""
    up, low = F.col("setinfo").isin(0, 1, 2), F.col("setinfo").isin(0, 3, 4)
    best = state.agg(F.min(F.when(up, F.struct("f", "id"))).alias("u"), F.max(F.when(low, F.struct("f", (-F.col("id")).alias("id")))).alias("l"))
    return best.select(F.col("u.f").alias("b_up"), F.col("u.id").alias("i_up"), F.col("l.f").alias("b_low"), (-F.col("l.id")).alias("i_low"))


def threshold(state: DataFrame, c: float) -> DataFrame:
    """threshold (mean f inside the box, else the middle of b_up and b_low) and nsv."""
    inside = (F.col("alpha") > ZERO) & (F.col("alpha") < c - ZERO)
    own = state.agg(F.avg(F.when(inside, F.col("f"))).alias("m"), F.sum((F.col("alpha") > ZERO).cast("bigint")).alias("nsv"))
    return own.join(F.broadcast(select_pair(state))).select(F.coalesce("m", (F.col("b_up") + F.col("b_low")) / 2).alias("threshold"), F.coalesce("nsv", F.lit(0).cast("bigint")).alias("nsv"))


def shrink_filter(state: DataFrame, b_up: float, b_low: float) -> DataFrame:
    """The rows that stay active: not those of sets 3, 4 with f below b_up, nor of sets 1, 2 with f above b_low."""
    gone = F.col("setinfo").isin(3, 4) & (F.col("f") < b_up) | F.col("setinfo").isin(1, 2) & (F.col("f") > b_low)
    return state.filter(~gone)


def shrink_stats(state: DataFrame) -> DataFrame:
    """Largest, smallest and total number of active rows over Spark's partitions."""
    each = state.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    return each.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.sum("n").alias("total"))


def kernel(x: np.ndarray, z: np.ndarray, sigmasqr: float) -> np.ndarray:
    """exp((2xz - xx - zz) / (2 sigmasqr)), rows of x by rows of z."""
    out = 2 * x @ z.T
    out -= (x * x).sum(1)[:, None]
    out -= (z * z).sum(1)[None, :]
    out /= 2 * sigmasqr
    return np.exp(out, out=out)


def weighted(x: np.ndarray, z: np.ndarray, weight: np.ndarray, sigmasqr: float) -> np.ndarray:
    """kernel(x, z) @ weight, by slices of x, so that no matrix is larger than a slice."""
    parts = [kernel(x[at : at + SLICE], z, sigmasqr) @ weight for at in range(0, len(x), SLICE)]
    return np.concatenate(parts) if parts else np.zeros(0)


def pair_step(y1, y2, a1, a2, f1, f2, k11, k12, k22, c: float):
    """New multipliers of a pair, and the two changes for the gradient; None where training stops.

    A shift t keeps the sum of alpha * y: a1 goes to a1 + y1 t, a2 to a2 - y2 t. The dual is a parabola in t with its top at (f2 - f1) / (k11 +
    k22 - 2 k12); both boxes leave t one interval. Where the parabola is flat, the end that the slope points to is taken.
    """
    low = max(-a1 if y1 > 0 else a1 - c, a2 - c if y2 > 0 else -a2)
    high = min(c - a1 if y1 > 0 else a1, a2 if y2 > 0 else c - a2)
    if high - low < ZERO:
        return None
    curve, slope = k11 + k22 - 2 * k12, f2 - f1
    t = min(max(slope / curve, low), high) if curve > ZERO else high if slope > 0 else low if slope < 0 else 0.0
    new1, new2 = (0.0 if a < ZERO else c if a > c - ZERO else a for a in (a1 + y1 * t, a2 - y2 * t))
    if abs(new2 - a2) < EPS:
        return None
    return new1, new2, new1 - a1, new2 - a2


def _extreme(f: np.ndarray, own: np.ndarray, ok: np.ndarray, sign: int) -> tuple[float, int]:
    """Value and place of the smallest (sign 1) or largest (-1) f where ok; the first within TIE of it."""
    at = np.flatnonzero(ok)
    if not len(at):
        return sign * 1e12, -1
    v = sign * f[at]
    best = int(at[np.flatnonzero(v <= v.min() + TIE)[0]])
    return float(f[best]), best


def smo(x: np.ndarray, y: np.ndarray, c: float, sigmasqr: float, max_iter: int = 100_000, alpha: np.ndarray | None = None, f: np.ndarray | None = None, shrink: bool = False, reconstruct: bool = True):
    """alpha, f, iterations, b_up, b_low. Rows in order of id; alpha and f: where to go on from.

    With shrink, rows that cannot move are left out of updates and selection from 5 % of n iterations on; on
    convergence the gradient of those left out is computed anew, all are active again, and training goes on until all
    rows agree. Without reconstruct (the approximate variant) it ends with the active rows.
    """
    n = len(y)
    alpha, f = (np.zeros(n) if alpha is None else alpha.copy()), (-y.astype(float) if f is None else f.copy())
    active = np.arange(n)
    norms, rows = (x * x).sum(1), {}

    def k_row(i: int) -> np.ndarray:
        got = rows.get(i)
        if got is None:
            if len(rows) >= 512:
                rows.clear()
            got = rows[i] = np.exp((2 * x @ x[i] - norms - norms[i]) / (2 * sigmasqr))
        return got

    def extremes():
        own = sets(y[active], alpha[active], c)
        u, iu = _extreme(f[active], own, np.isin(own, (0, 1, 2)), 1)
        lo, il = _extreme(f[active], own, np.isin(own, (0, 3, 4)), -1)
        return u, (int(active[iu]) if iu >= 0 else -1), lo, (int(active[il]) if il >= 0 else -1)

    b_up, i_up, b_low, i_low = extremes()
    every = max(1, int(0.05 * n))
    done, left = 0, every
    while True:
        stopped = False
        while b_up < b_low - 2 * TOL and done < max_iter and i_up != i_low and min(i_up, i_low) >= 0:
            i, j = i_up, i_low
            ki, kj = k_row(i), k_row(j)
            got = pair_step(y[i], y[j], alpha[i], alpha[j], f[i], f[j], ki[i], ki[j], kj[j], c)
            if got is None:
                stopped = True
                break
            alpha[i], alpha[j], d1, d2 = got
            f[active] += y[i] * d1 * ki[active] + y[j] * d2 * kj[active]
            done += 1
            left -= 1
            if shrink and left <= 0:
                own, fa = sets(y[active], alpha[active], c), f[active]
                gone = np.isin(own, (3, 4)) & (fa < b_up) | np.isin(own, (1, 2)) & (fa > b_low)
                active, left = active[~gone], max(1, min(every, int((~gone).sum())))
            b_up, i_up, b_low, i_low = extremes()
        if len(active) == n or not reconstruct:
            break
        out = np.setdiff1d(np.arange(n), active)
        sv = alpha > ZERO
        for at in range(0, len(out), 1024):
            part = out[at : at + 1024]
            f[part] = kernel(x[part], x[sv], sigmasqr) @ (alpha * y)[sv] - y[part]
        active = np.arange(n)
        b_up, i_up, b_low, i_low = extremes()
        shrink = False  # once all rows are back, the rest is plain
        if stopped or done >= max_iter:
            break
    return alpha, f, done, b_up, b_low


def _threshold(alpha, f, c, b_up, b_low) -> float:
    inside = (alpha > ZERO) & (alpha < c - ZERO)
    return float(f[inside].mean()) if inside.any() else (b_up + b_low) / 2


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["vector"].tolist(), dtype=np.float64).reshape(len(pdf), -1)


def fit(rows: DataFrame, c: float, sigmasqr: float, max_iter: int = 100_000, shrink: bool = False, reconstruct: bool = True, bound: int = BOUND, working: int = WORKING) -> Model:
    """Trains on all rows; `bound` decides between one task and rounds of working sets."""
    data = rows.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("double").alias("y"), F.col("vector").cast("array<double>").alias("vector"))
    n_rows, bad = data.agg(F.count("*"), F.count_if(~F.coalesce(F.col("y").isin(1.0, -1.0), F.lit(False)))).first()
    if bad:
        raise ValueError("a label must be +1 or -1")
    if n_rows <= bound:
        small = data.toPandas().sort_values("id")
        x, y = _matrix(small), small["y"].to_numpy()
        alpha, f, n, up, low = smo(x, y, c, sigmasqr, max_iter, shrink=shrink, reconstruct=reconstruct)
        return Model(small["id"].to_numpy(), x, y, alpha, _threshold(alpha, f, c, up, low), sigmasqr, n, up, low, up >= low - 2 * TOL)
    return _fit_rounds(data, n_rows, c, sigmasqr, max_iter, working, shrink, reconstruct)


def _fit_rounds(data: DataFrame, n_rows: int, c: float, sigmasqr: float, max_iter: int, working: int, shrink: bool, reconstruct: bool) -> Model:
    """The same three variants as smo(), with all rows in a table. A round is one pass: a working set is solved, and every active row's f moves.

    With shrink, each round leaves out rows that cannot move; once the active ones agree, the gradients of those left out
    are computed anew and all go on, or (without reconstruct) it ends.
    """
    packed = _packed(data, n_rows)
    most = working // 2
    state = cut(_each_block(packed, None, None, c, most))
    done, stuck, stuck_at = 0, False, None
    while True:
        up, low = _candidates(state, most)
        b_up, b_low = (float(rows[3][0]) if len(rows[3]) else None for rows in (up, low))
        agreed = b_up is None or b_low is None or b_up >= b_low - 2 * TOL
        if agreed or stuck or done >= max_iter:
            if shrink and reconstruct and agreed and not _rows(state).filter("not active").isEmpty():
                state, shrink = _reconstructed(packed, state, c, sigmasqr, most), False  # once all rows are back, the rest is plain
                continue
            break
        ids, at = np.unique(np.concatenate([up[0], low[0]]), return_index=True)  # at most `working` rows
        y, before, f, x = (np.concatenate(pair)[at] for pair in list(zip(up, low))[1:])
        alpha, _, n, *_ = smo(x, y, c, sigmasqr, max_iter - done, before, f)
        done += n
        moved = alpha != before
        at = (b_up, b_low, n)
        stuck, stuck_at = not moved.any() or at == stuck_at, at
        if moved.any():
            how = _move(ids[moved], x[moved], (y * (alpha - before))[moved], alpha[moved], c, sigmasqr, (b_up, b_low) if shrink else None)
            state = cut(_each_block(packed, state, how, c, most))
    none = np.zeros(0)
    if not agreed:
        warnings.warn(f"training ended after {done} pair steps with a gap of {b_low - b_up:.3g}", stacklevel=3)
    with_set = _rows(state).withColumn("setinfo", set_of(F.col("y"), F.col("alpha"), c))
    return Model(none, none, none, none, threshold(with_set, c).first()["threshold"], sigmasqr, done, b_up, b_low, agreed, _rows(state, packed))


def _packed(data: DataFrame, n_rows: int) -> DataFrame:
    """tb, tids, tv: blocks of rows, in each row the label and then the vector; dealt by block, so that a state meets them where they lie."""
    n = max(1, -(-n_rows // BLOCK))
    parts = min(n, max(data.sparkSession.sparkContext.defaultParallelism, -(-n // HELD)))
    labelled = data.select("id", F.concat(F.array("y"), "vector").alias("vector"))
    return cut(blocks(labelled, "t", n).repartition(parts, "tb").sortWithinPartitions("tb"))


def _values(row, n: int) -> np.ndarray:
    return np.frombuffer(row).reshape(n, -1)


def _from_state(row) -> tuple[np.ndarray, ...]:
    """ids, y, alpha, f, active; the last three can be written to."""
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.y), np.frombuffer(row.alpha).copy(), np.frombuffer(row.f).copy(), np.frombuffer(row.active, bool).copy()


def _each_block(packed: DataFrame, state: DataFrame | None, change, c: float, most: int) -> DataFrame:
    """The state after change(x, ids, y, alpha, f, active), which gives alpha, f and active, in every block; without a state the one before training."""

    def run(batches):
        held, first = None, (None, None)
        for pdf in batches:
            for row in pdf.itertuples():
                if held is not None:
                    yield held
                ids = np.frombuffer(row.tids, np.int64)
                x = _values(row.tv, len(ids))[:, 1:]
                if change is None:
                    y = np.ascontiguousarray(_values(row.tv, len(ids))[:, 0])
                    own = np.zeros(len(y)), -y, np.ones(len(y), bool)
                else:
                    _, y, *own = _from_state(row)
                    own = change(x, ids, y, *own)
                held = pd.DataFrame({"tb": [row.tb], **{k: [v.tobytes()] for k, v in zip(("ids", "y", "alpha", "f", "active"), (ids, y, *own))}, "first": [None]})
                first = [_foremost([old, new], most, side) for old, new, side in zip(first, _extremes(x, ids, y, *own, c), (1, -1))]
        if held is not None:
            yield held.assign(first=[pickle.dumps(first)])

    return (packed if state is None else packed.join(state, "tb")).mapInPandas(run, STATE)


def _extremes(x, ids, y, alpha, f, active, c: float):
    """id, y, alpha, f, vectors of the active rows of sets 0, 1, 2, and of those of sets 0, 3, 4."""
    own = sets(y, alpha, c)
    for among in ((0, 1, 2), (0, 3, 4)):
        at = np.flatnonzero(active & np.isin(own, among))
        yield ids[at], y[at], alpha[at], f[at], x[at]


def _foremost(parts: list, most: int, side: int) -> tuple[np.ndarray, ...]:
    """Of such rows those with the smallest (side 1) or largest (-1) f, then the lowest id, in this order."""
    rows = [np.concatenate(own) for own in zip(*[p for p in parts if p is not None])]
    at = np.lexsort((rows[0], side * rows[3]))[:most]
    return tuple(own[at] for own in rows)


def _candidates(state: DataFrame, most: int) -> list[tuple[np.ndarray, ...]]:
    """id, y, alpha, f, vectors of the active rows with the smallest f over sets 0, 1, 2, and with the largest over sets 0, 3, 4."""
    best = [None, None]
    for row in state.select("first").filter(F.col("first").isNotNull()).collect():
        best = [_foremost([old, new], most, side) for old, new, side in zip(best, pickle.loads(row["first"]), (1, -1))]
    return best


def _rows(state: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    """id, y, alpha, f, active of each row; with `packed` its vector too."""
    with_vector = packed is not None

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                ids, y, alpha, f, active = _from_state(row)
                out = pd.DataFrame({"id": ids, "y": y, "alpha": alpha, "f": f, "active": active})
                yield out if not with_vector else out.assign(vector=list(_values(row.tv, len(ids))[:, 1:]))

    schema = "id bigint, y double, alpha double, f double, active boolean"
    return packed.join(state, "tb").mapInPandas(run, schema + ", vector array<double>") if with_vector else state.mapInPandas(run, schema)


def _move(ids, x, change, alpha, c: float, sigmasqr: float, shrink: tuple[float, float] | None):
    """For _each_block: f of every active row moves by the kernel with the rows that changed; those get their new multipliers.

    shrink: b_up and b_low, by which rows that cannot move are left out.
    """
    order = np.argsort(ids)
    at_ids, at_alpha = ids[order], alpha[order]

    def moved(own, own_ids, y, a, f, active):
        if active.any():
            f[active] += weighted(own[active], x, change, sigmasqr)
        place = np.minimum(np.searchsorted(at_ids, own_ids), len(at_ids) - 1)
        a = np.where(at_ids[place] == own_ids, at_alpha[place], a)
        if shrink:
            own_set = sets(y, a, c)
            active &= ~(np.isin(own_set, (3, 4)) & (f < shrink[0]) | np.isin(own_set, (1, 2)) & (f > shrink[1]))
        return a, f, active

    return moved


def _updated(state: DataFrame, ids, x, change, alpha, sigmasqr: float) -> DataFrame:
    """A round's update of a table of rows: f of every active row moves by the kernel with the rows that changed; those get their new multipliers."""
    new = dict(zip(ids.tolist(), alpha.tolist()))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                on, f = pdf["active"].to_numpy(bool), pdf["f"].to_numpy(np.float64, copy=True)
                if on.any():
                    f[on] += weighted(_matrix(pdf[on]), x, change, sigmasqr)
                yield pdf.assign(f=f, alpha=[new.get(i, a) for i, a in zip(pdf["id"], pdf["alpha"])])

    return state.mapInPandas(run, state.schema)


def _reconstructed(packed: DataFrame, state: DataFrame, c: float, sigmasqr: float, most: int) -> DataFrame:
    """All rows active; those that were not get their gradient anew from the support vectors."""
    support = _rows(state, packed).filter(F.col("alpha") > ZERO).select("id", F.concat("vector", F.array(F.col("alpha") * F.col("y"))).alias("vector"))
    n = max(1, -(-_rows(state).filter(F.col("alpha") > ZERO).count() // BLOCK))

    def emptied(own, ids, y, alpha, f, active):
        return alpha, np.where(active, f, 0.0), active

    def adding(chunk):
        def added(own, ids, y, alpha, f, active):
            out = ~active
            for _, sv in chunk.value if out.any() else []:
                f[out] += weighted(own[out], sv[:, :-1], sv[:, -1], sigmasqr)
            return alpha, f, active

        return added

    def back(own, ids, y, alpha, f, active):
        return alpha, np.where(active, f, f - y), np.ones(len(y), bool)

    out = cut(_each_block(packed, state, emptied, c, most))
    for chunk in chunks(blocks(support, "t", n), "t", n, SENT):
        out = cut(_each_block(packed, out, adding(chunk), c, most))
    return cut(_each_block(packed, out, back, c, most))


def gradient(rows: DataFrame, model: Model) -> DataFrame:
    """id, f = sum of alpha y K - label for each row: the gradient of rows that were left out. rows: id, label, vector."""
    return decision(rows, model, 0.0).select("id", (F.col("f") - F.col("label")).alias("f"))


def decision(rows: DataFrame, model: Model, threshold: float | None = None) -> DataFrame:
    """id, label, f = sum of alpha y K - threshold. A model of few support vectors is sent out, a large one meets the rows in blocks."""
    t, sigmasqr = model.threshold if threshold is None else threshold, model.sigmasqr
    if model.state is not None:
        sv = model.state.filter(F.col("alpha") > ZERO).select("id", (F.col("alpha") * F.col("y")).alias("weight"), "vector")
        return decision_in_blocks(rows, sv, t, sigmasqr)
    sv, weight = model.support()

    @F.pandas_udf("double")
    def value(v: pd.Series) -> pd.Series:
        if not len(v) or not len(sv):
            return pd.Series(np.full(len(v), -t))
        return pd.Series(weighted(np.array(v.tolist(), dtype=np.float64), sv, weight, sigmasqr) - t)

    return rows.select("id", F.col("label").cast("double").alias("label"), value(F.col("vector").cast("array<double>")).alias("f"))


def decision_in_blocks(rows: DataFrame, support: DataFrame, threshold: float, sigmasqr: float, block: int = BLOCK, sent: int = SENT, keep: list[str] | None = None) -> DataFrame:
    """The same from a table of support vectors (id, weight, vector), and the columns in `keep`.

    Support vectors go out in bounded chunks; the rows stay where they are, and a sum in each grows chunk by chunk. Nothing is shuffled but the support vectors, once.
    """
    n = max(1, -(-support.count() // block))
    heavier = support.select("id", F.concat(F.col("vector").cast("array<double>"), F.array(F.col("weight").cast("double"))).alias("vector"))
    kept = [c for c in keep or [] if c != "vector"]
    out = rows.select("id", F.col("label").cast("double").alias("label"), *kept, F.col("vector").cast("array<double>").alias("vector"), F.lit(0.0).alias("f"))

    def adding(chunk, schema):
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    own, f = matrix(pdf["vector"]), pdf["f"].to_numpy(np.float64, copy=True)
                    for _, sv in chunk.value:
                        f += weighted(own, sv[:, :-1], sv[:, -1], sigmasqr)
                    yield pdf.assign(f=f)

        return lambda df: df.mapInPandas(run, schema)

    for k, chunk in enumerate(chunks(blocks(heavier, "t", n), "t", n, sent)):
        out = adding(chunk, out.schema)(out)
        if k % 2:  # each chunk in a plan has a Python process of its own for every task
            out = cut(out)
    return out.select("id", "label", *(keep or []), (F.col("f") - threshold).alias("f"))


def evaluate(scored: DataFrame) -> DataFrame:
    """n, missed, accuracy. A row is missed if f < 1e-12 for a label +1, or f > 1e-12 for a label -1."""
    f, y = F.col("f"), F.col("label")
    missed = F.coalesce(F.sum((((f < ZERO) & (y > ZERO)) | ((f > ZERO) & (y < ZERO))).cast("bigint")), F.lit(0).cast("bigint"))
    n = F.count(F.lit(1))
    return scored.agg(n.alias("n"), missed.alias("missed"), F.when(n > 0, F.round(100.0 * (n - missed) / n, 6)).alias("accuracy"))


def fit_shrinking(rows: DataFrame, c: float, sigmasqr: float, **how) -> Model:
    """With adaptive shrinking and reconstruction: the same optimum within tolerance."""
    return fit(rows, c, sigmasqr, shrink=True, **how)


def fit_approximate(rows: DataFrame, c: float, sigmasqr: float, **how) -> Model:
    """With shrinking and no reconstruction at the end."""
    return fit(rows, c, sigmasqr, shrink=True, reconstruct=False, **how)


def model_table(spark, model: Model) -> DataFrame:
    """id, y, alpha of each row the model holds."""
    if model.state is not None:
        return model.state.select("id", "y", "alpha")
    return spark.createDataFrame([(int(i), float(y), float(a)) for i, y, a in zip(model.ids, model.y, model.alpha)], "id bigint, y double, alpha double")
