"""Image sets: IDX files (gzip or plain) and pickled CIFAR batches, and projections over their pixels."""

from __future__ import annotations

import gzip
import io
import pickle
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.vectors import scaled
from quarry.operators.prep import split_validation_first

TYPES = {8: ">u1", 9: ">i1", 11: ">i2", 12: ">i4", 13: ">f4", 14: ">f8"}


def parse_idx(content: bytes) -> np.ndarray:
    """An array of an IDX file; gzip is seen by its first bytes."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    zero, kind, n = struct.unpack(">HBB", raw[:4])
    if zero or kind not in TYPES:
        raise ValueError("not an IDX file")
    shape = struct.unpack(f">{n}I", raw[4 : 4 + 4 * n])
    return np.frombuffer(raw, TYPES[kind], int(np.prod(shape)), 4 + 4 * n).reshape(shape)


class _Plain(pickle.Unpickler):
    """Only what arrays and containers need; anything else in a file is refused."""

    ALLOWED = {("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy", "ndarray"), ("numpy", "dtype"), ("_codecs", "encode"), ("numpy._core.numeric", "_frombuffer"), ("numpy.core.numeric", "_frombuffer")}

    def find_class(self, module, name):
        if (module, name) not in self.ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} is not allowed")
        return super().find_class(module, name)


def parse_cifar(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Pixels (n by 3072 bytes) and labels of a batch: `labels` of ten classes, or `fine_labels` of a hundred."""
    found = _Plain(io.BytesIO(content), encoding="bytes").load()
    found = {k.decode() if isinstance(k, bytes) else k: v for k, v in found.items()}
    return np.asarray(found["data"], np.uint8), np.asarray(found["labels" if "labels" in found else "fine_labels"], np.int32)


SCHEMA = "id bigint, pixels array<float>, label int"


def _rows(first: int, pixels: np.ndarray, labels: np.ndarray, scale: bool, step: int = 1024):
    for at in range(0, len(labels), step):
        part = pixels[at : at + step].reshape(len(labels[at : at + step]), -1).astype(np.float32)
        if scale:
            part = part * np.float32(1 / 255)
        yield pd.DataFrame({"id": np.arange(first + at, first + at + len(part)), "pixels": list(part), "label": labels[at : at + step].astype(np.int32)})


def read_idx(spark: SparkSession, images: str, labels: str, scale: bool = True) -> DataFrame:
    """id (from 0), pixels, label of a pair of IDX files."""
    one = spark.read.format("binaryFile").load(images).select(F.col("content").alias("a")).join(spark.read.format("binaryFile").load(labels).select(F.col("content").alias("b")))

    def run(batches):
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"]):
                yield from _rows(0, parse_idx(a), parse_idx(b), scale)

    return one.mapInPandas(run, SCHEMA)


def read_cifar(spark: SparkSession, paths: list[str] | str, scale: bool = True) -> DataFrame:
    """id, pixels, label of batch files; each is one task, and ids follow the file names by 2^32."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    names = sorted(r["path"] for r in files.select("path").collect())
    number = F.array_position(F.array(*map(F.lit, names)), F.col("path")) - 1

    def run(batches):
        for pdf in batches:
            for k, content in zip(pdf["k"], pdf["content"]):
                yield from _rows(int(k) << 32, *parse_cifar(content), scale)

    return files.select(number.alias("k"), "content").mapInPandas(run, SCHEMA)


def scale_pixels(df: DataFrame, column: str = "pixels", by: float = 1 / 255) -> DataFrame:
    return df.withColumn(column, scaled(column, by))


def with_validation(df: DataFrame, percent: float) -> DataFrame:
    """The first rows by id are validation."""
    return split_validation_first(df, percent, ["id"])


def transform_images(df: DataFrame, shape: tuple[int, int, int], crop: tuple[int, int] | None = None, random_seed: int | None = None, mean: np.ndarray | None = None, to_hwc: bool = True) -> DataFrame:
    """Channel-first pixels: minus a mean image, cropped at the centre (or, with a seed, at a place drawn from seed and id), as height, width, channel."""
    c, h, w = shape
    ch, cw = crop or (h, w)

    def run(batches):
        for pdf in batches:
            out = []
            for i, p in zip(pdf["id"], pdf["pixels"]):
                x = np.asarray(p, np.float32).reshape(c, h, w)
                if mean is not None:
                    x = x - mean.reshape(c, h, w).astype(np.float32)
                top, left = (h - ch) // 2, (w - cw) // 2
                if random_seed is not None:
                    rng = np.random.default_rng([random_seed, int(i)])
                    top, left = int(rng.integers(0, h - ch + 1)), int(rng.integers(0, w - cw + 1))
                x = x[:, top : top + ch, left : left + cw]
                out.append((x.transpose(1, 2, 0) if to_hwc else x).ravel())
            yield pdf.assign(pixels=out)

    return df.select("id", "pixels", "label").mapInPandas(run, SCHEMA)


def mean_image(df: DataFrame) -> np.ndarray:
    """The mean of all images, from one partial sum for each task."""
    def partial(batches):
        total, n = None, 0
        for pdf in batches:
            for p in pdf["pixels"]:
                total = np.asarray(p, np.float64) if total is None else total + np.asarray(p, np.float64)
                n += 1
        if n:
            yield pd.DataFrame({"n": [n], "s": [total]})

    parts = df.select("pixels").mapInPandas(partial, "n bigint, s array<double>")
    each = parts.select("n", F.posexplode("s").alias("k", "s")).groupBy("k").agg((F.sum("s") / F.sum("n")).alias("m")).orderBy("k").collect()
    return np.array([r["m"] for r in each])
