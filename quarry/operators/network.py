"""Data-parallel training of small networks: dense layers, and convolution with pooling in front.

A step sends the parameters out, each task gives the sum of its rows' gradients, and the sums are added by a tree; the mean is
the update. Rows: id, x (array<double>), label (from 0).
"""

from __future__ import annotations

import pickle
import time
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def loss_of(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """-log of the label's probability, clipped to 1e-10 .. 1."""
    return -np.log(np.clip(p[np.arange(len(y)), y], 1e-10, 1.0))


def truncated_normal(rng, shape, sd: float) -> np.ndarray:
    """Normal numbers, drawn again where they are over two deviations."""
    out = rng.normal(0, sd, shape)
    while (bad := np.abs(out) > 2 * sd).any():
        out[bad] = rng.normal(0, sd, int(bad.sum()))
    return out


def _windows(x: np.ndarray, k: int) -> np.ndarray:
    """n, h, w, k, k, c: the k by k surroundings of each pixel, zeros outside."""
    pad = k // 2
    x = np.pad(x, ((0, 0), (pad, k - 1 - pad), (pad, k - 1 - pad), (0, 0)))
    return np.lib.stride_tricks.sliding_window_view(x, (k, k), axis=(1, 2)).transpose(0, 1, 2, 4, 5, 3)


def conv_same(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x: n, h, w, c; w: k, k, c, features. Stride 1."""
    return np.tensordot(_windows(x, w.shape[0]), w, 3) + b


def conv_same_back(x: np.ndarray, w: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = w.shape[0]
    dw = np.tensordot(_windows(x, k), up, ((0, 1, 2), (0, 1, 2)))
    dx = np.zeros_like(np.pad(x, ((0, 0), (k // 2, k - 1 - k // 2), (k // 2, k - 1 - k // 2), (0, 0))))
    h, wd = x.shape[1:3]
    for i in range(k):
        for j in range(k):
            dx[:, i : i + h, j : j + wd] += up @ w[i, j].T
    return dw, up.sum((0, 1, 2)), dx[:, k // 2 : k // 2 + h, k // 2 : k // 2 + wd]


def pool_same(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """2 by 2 maximum, stride 2; an odd edge is a window of what is there. Also the places of the maxima."""
    n, h, w, c = x.shape
    full = np.pad(x, ((0, 0), (0, h % 2), (0, w % 2), (0, 0)), constant_values=-np.inf)
    cells = full.reshape(n, (h + 1) // 2, 2, (w + 1) // 2, 2, c).transpose(0, 1, 3, 5, 2, 4).reshape(n, (h + 1) // 2, (w + 1) // 2, c, 4)
    at = cells.argmax(-1)
    return np.take_along_axis(cells, at[..., None], -1)[..., 0], at


def pool_same_back(shape, at: np.ndarray, up: np.ndarray) -> np.ndarray:
    n, h, w, c = shape
    cells = np.zeros((*at.shape, 4))
    np.put_along_axis(cells, at[..., None], up[..., None], -1)
    full = cells.reshape(n, at.shape[1], at.shape[2], c, 2, 2).transpose(0, 1, 4, 2, 5, 3).reshape(n, at.shape[1] * 2, at.shape[2] * 2, c)
    return full[:, :h, :w]


@dataclass
class Network:
    """conv: features of each 5 by 5 convolution (with ReLU and pooling); hidden: widths of sigmoid (or ReLU) layers; then softmax.

    With uniform, weights and biases are drawn up to sqrt(6 / (inputs + outputs)) of their layer; a convolution's are its channels.
    """

    inputs: int
    classes: int
    hidden: list[int] = field(default_factory=list)
    image: tuple[int, int, int] | None = None
    conv: list[int] = field(default_factory=list)
    size: int = 5
    seed: int = 0
    relu: bool = False
    uniform: bool = False

    def __post_init__(self):
        rng, self.params, shape = np.random.default_rng(self.seed), [], self.image

        def drawn(shape: tuple[int, ...]) -> list[np.ndarray]:
            most = (6 / (shape[-2] + shape[-1])) ** 0.5
            return [rng.uniform(-most, most, shape), rng.uniform(-most, most, shape[-1])]

        for features in self.conv:
            h, w, c = shape
            own = (self.size, self.size, c, features)
            self.params += drawn(own) if self.uniform else [truncated_normal(rng, own, 0.1), np.full(features, 0.1)]
            shape = ((h + 1) // 2, (w + 1) // 2, features)
        width = int(np.prod(shape)) if self.conv else self.inputs
        for n in [*self.hidden, self.classes]:
            self.params += drawn((width, n)) if self.uniform else [rng.normal(0, 1 / width, (width, n)), np.zeros(n)]
            width = n

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Probabilities; `keep` gets what the backward pass needs."""
        at = 0
        if self.conv:
            x = x.reshape(len(x), *self.image)
            for _ in self.conv:
                z = np.maximum(conv_same(x, self.params[at], self.params[at + 1]), 0)
                out, places = pool_same(z)
                if keep is not None:
                    keep.append((x, z, places))
                x, at = out, at + 2
            x = x.reshape(len(x), -1)
        for k in range(len(self.hidden) + 1):
            z = x @ self.params[at] + self.params[at + 1]
            if keep is not None:
                keep.append(x)
            x, at = (softmax(z) if k == len(self.hidden) else np.maximum(z, 0) if self.relu else sigmoid(z)), at + 2
        return x

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float, int]:
        """Sums over the rows of each parameter's gradient and of the loss, and how many rows are right."""
        keep: list = []
        p = self.forward(x, keep)
        up = p.copy()
        up[np.arange(len(y)), y] -= 1
        out: list = [None] * len(self.params)
        at = len(self.params) - 2
        for k in range(len(self.hidden), -1, -1):
            own = keep[len(self.conv) + k]
            out[at], out[at + 1] = own.T @ up, up.sum(0)
            up = up @ self.params[at].T
            if k:
                up = up * (own > 0) if self.relu else up * own * (1 - own)
            at -= 2
        for k in range(len(self.conv) - 1, -1, -1):
            own, z, places = keep[k]
            up = pool_same_back(z.shape, places, up.reshape(places.shape)) * (z > 0)
            out[at], out[at + 1], up = conv_same_back(own, self.params[at], up)
            at -= 2
        return out, float(loss_of(p, y).sum()), int((p.argmax(1) == y).sum())


def gradient_sums(rows: DataFrame, net: Network) -> tuple[list[np.ndarray], float, int, int]:
    """Gradient sums, loss sum, right answers and rows over all rows. One packed sum for each task is added up by position."""
    shapes, params = [p.shape for p in net.params], net

    def partial(batches):
        total, loss, right, n = None, 0.0, 0, 0
        for pdf in batches:
            if len(pdf):
                g, own, ok = params.gradients(np.array(pdf["x"].tolist(), float), pdf["label"].to_numpy(np.int64))
                flat = np.concatenate([x.ravel() for x in g])
                total, loss, right, n = (flat if total is None else total + flat), loss + own, right + ok, n + len(pdf)
        if n:
            yield pd.DataFrame({"s": [total.tobytes()], "loss": [loss], "r": [right], "n": [n]})

    parts = rows.select(F.col("x").cast("array<double>").alias("x"), "label").mapInPandas(partial, "s binary, loss double, r bigint, n bigint")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s) for s in pdf["s"])
        return pd.DataFrame({"s": [total.tobytes()], "loss": [pdf["loss"].sum()], "r": [pdf["r"].sum()], "n": [pdf["n"].sum()]})

    # a tree: about the square root of the number of tasks first, then the rest
    groups = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
    tree = parts.groupBy((F.monotonically_increasing_id() / F.lit(1 << 33)).cast("bigint") % groups).applyInPandas(add, "s binary, loss double, r bigint, n bigint")
    got = tree.collect()
    if not got:
        return [np.zeros(s) for s in shapes], 0.0, 0, 0
    flat = sum(np.frombuffer(r["s"]) for r in got)
    out, at = [], 0
    for s in shapes:
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out, sum(r["loss"] for r in got), sum(r["r"] for r in got), sum(r["n"] for r in got)


def step_decay(rate: float, step: int, every: int, by: float = 0.1) -> float:
    """Divided by ten after each `every` steps."""
    return rate * by ** (step // every)


def inverse_time_decay(rate: float, step: int, steps: int, decay: float) -> float:
    return rate / (1 + decay * step / steps)


def exponential_decay(rate: float, step: int, decay: float = 0.999964) -> float:
    return rate * decay**step


@dataclass
class Trainer:
    """Gradient descent on averaged gradients, with optional momentum, L2 on weights (and biases), and a faster rate for biases."""

    net: Network
    rate: float = 0.5
    momentum: float = 0.0
    l2: float = 0.0
    bias_rate: float = 1.0
    l2_bias: float = 0.0
    schedule: object = None

    def __post_init__(self):
        self.speed, self.step = [np.zeros_like(p) for p in self.net.params], 0

    def update(self, sums: list[np.ndarray], n: int) -> None:
        rate = self.rate if self.schedule is None else self.schedule(self.rate, self.step)
        for k, g in enumerate(sums):
            bias = k % 2
            g = g / max(1, n) + (self.l2_bias if bias else self.l2) * self.net.params[k]
            self.speed[k] = self.momentum * self.speed[k] - rate * (self.bias_rate if bias else 1.0) * g
            self.net.params[k] = self.net.params[k] + self.speed[k]
        self.step += 1

    def fit(self, batched: DataFrame, epochs: int, n_batches: int, seconds: float | None = None) -> list[dict]:
        """batched: rows with a column batch; batches from n_batches on (the short last one) are left out. A time budget overrides epochs."""
        history, began, epoch = [], time.monotonic(), 0
        while (time.monotonic() - began < seconds) if seconds is not None else epoch < epochs:
            loss = right = n = 0
            for b in range(n_batches):
                g, own, ok, m = gradient_sums(batched.filter(F.col("batch") == b), self.net)
                if m:
                    self.update(g, m)
                loss, right, n = loss + own, right + ok, n + m
            history.append({"epoch": epoch, "loss": loss / max(1, n), "accuracy": 100.0 * right / max(1, n)})
            epoch += 1
        return history


def lenet3(image: tuple[int, int, int] = (28, 28, 1), classes: int = 10, seed: int = 0) -> Trainer:
    """Two convolutions of 20 and 50 features and a ReLU layer of 500, with the rates, momentum and decay that it is trained with."""
    net = Network(int(np.prod(image)), classes, [500], image, [20, 50], seed=seed, relu=True, uniform=True)
    return Trainer(net, rate=0.01, momentum=0.9, l2=1e-4, l2_bias=1e-4, schedule=lambda rate, step: inverse_time_decay(rate, step, 1, 1e-4))


def n_full_batches(rows: int, size: int) -> int:
    return max(1, rows // size)


def predict(rows: DataFrame, net: Network) -> DataFrame:
    """The columns of rows and scores (array<double>), loss (null without a label)."""
    raw = pickle.dumps(net)

    @F.pandas_udf("array<double>")
    def scores(x: pd.Series) -> pd.Series:
        own = pickle.loads(raw)
        return pd.Series(list(own.forward(np.array(x.tolist(), float)))) if len(x) else pd.Series([], dtype=object)

    out = rows.withColumn("scores", scores(F.col("x").cast("array<double>")))
    if "label" not in rows.columns:
        return out
    p = F.get("scores", F.col("label"))
    return out.withColumn("loss", -F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-10))))
