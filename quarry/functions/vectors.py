"""Scalar and array expressions over dense (array<double>) and sparse (array<struct<idx int, val double>>) vectors.

All are Column functions, evaluated in the JVM. Sparse indices are ascending and unique, as in the text formats.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(values) -> Column:
    """The sum of an array of doubles, from the left; 0 if it is empty."""
    return F.aggregate(_c(values), F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm_sq(a) -> Column:
    return total(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double")))


def sq_dist(a, b) -> Column:
    """Sum of squared differences; the shorter vector is taken as if filled up with zeros."""
    def part(x, y):
        d = F.coalesce(x.cast("double"), F.lit(0.0)) - F.coalesce(y.cast("double"), F.lit(0.0))
        return d * d

    return total(F.zip_with(_c(a), _c(b), part))


def euclid(a, b) -> Column:
    """sqrt(aa + bb - 2ab): 0 for empty vectors, NaN where cancellation makes the sum negative."""
    s = norm_sq(a) + norm_sq(b) - 2 * dot(a, b)
    return F.when(F.size(_c(a)) == 0, 0.0).when(s < 0, NAN).otherwise(F.sqrt(s))


def euclid_abs(a, b) -> Column:
    """sqrt(|aa + bb - 2ab|)."""
    return F.sqrt(F.abs(norm_sq(a) + norm_sq(b) - 2 * dot(a, b)))


def as_map(a) -> Column:
    return F.map_from_entries(_c(a))


def sparse_dot(a, b) -> Column:
    other = as_map(b)
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x["val"] * F.coalesce(F.try_element_at(other, x["idx"]), F.lit(0.0)))


def sparse_norm_sq(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x["val"] * x["val"])


def sparse_sq_dist(a, b) -> Column:
    """Merge on the index: squared differences where both have it, squares where one has."""
    left, right = as_map(a), as_map(b)

    def mine(acc, x):
        d = x["val"] - F.coalesce(F.try_element_at(right, x["idx"]), F.lit(0.0))
        return acc + d * d

    theirs = F.filter(_c(b), lambda x: F.try_element_at(left, x["idx"]).isNull())
    return F.aggregate(_c(a), F.lit(0.0), mine) + sparse_norm_sq(theirs)


def sparse_euclid(a, b) -> Column:
    return F.sqrt(F.abs(sparse_sq_dist(a, b)))


def rbf(ab, aa, bb, sigmasqr: float) -> Column:
    """exp((2ab - aa - bb) / (2 sigmasqr)) from a dot product and two squared norms."""
    return F.exp((2 * _c(ab) - _c(aa) - _c(bb)) / F.lit(2.0 * sigmasqr))


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def divide(values, n) -> Column:
    """Each value over n; NaN where n is 0."""
    n = _c(n)
    return F.transform(_c(values), lambda x: F.when(n == 0, NAN).otherwise(x / F.when(n != 0, n)))


def densify(a, dims, first: int = 1) -> Column:
    """Sparse to dense of `dims` values; indices count from `first`; what is missing is 0."""
    known, dims = as_map(a), F.lit(dims) if isinstance(dims, int) else _c(dims)
    numbers = F.when(dims > 0, F.sequence(F.lit(first), dims + (first - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda i: F.coalesce(F.try_element_at(known, i.cast("int")), F.lit(0.0)))


def sparsify(a, first: int = 1) -> Column:
    """Dense to sparse: zeros are left out."""
    pairs = F.transform(_c(a), lambda x, i: F.struct((i + first).alias("idx"), x.cast("double").alias("val")))
    return F.filter(pairs, lambda p: (p["val"] != 0) | F.isnan(p["val"]))


def one_hot(label, classes: int) -> Column:
    """1.0 in the label's place (labels from 0), else 0.0; all 0.0 for a label outside."""
    label = _c(label)
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(label == i, 1.0).otherwise(0.0))


def scaled(values, by: float = 1 / 255) -> Column:
    """Bytes or numbers to floats times `by`."""
    return F.transform(_c(values), lambda x: (x.cast("double") * by).cast("float"))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def dense_layer(x, weights, bias) -> Column:
    """sigmoid(xW + b) as one expression; weights: rows of inputs, columns of outputs."""
    outs = []
    for j in range(len(bias)):
        outs.append(sigmoid(dot(_c(x), F.array(*[F.lit(float(row[j])) for row in weights])) + float(bias[j])))
    return F.array(*outs)


def softmax(z) -> Column:
    z = _c(z)
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))


def cross_entropy(onehot, p) -> Column:
    """-sum of y log(p), p clipped to 1e-10 .. 1."""
    return -total(F.zip_with(_c(onehot), _c(p), lambda y, q: y * F.log(F.greatest(F.least(q, F.lit(1.0)), F.lit(1e-10)))))
