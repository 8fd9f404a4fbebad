"""Support vector machines: hand-computed cases, optimality, and agreement of all ways to train."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import svm

SMALL = [(0, 1, [1.0, 1.0]), (1, 1, [2.0, 1.0]), (2, -1, [-1.0, -1.0]), (3, -1, [-2.0, -1.0])]
SCHEMA = "id bigint, label int, vector array<double>"


def two_moons(n, seed=0):
    rng = np.random.default_rng(seed)
    t = rng.uniform(0, np.pi, n)
    y = np.where(rng.random(n) < 0.5, 1, -1)
    x = np.stack([np.cos(t) * y + (y < 0), np.sin(t) * y - 0.3 * (y < 0)], 1) + rng.normal(0, 0.25, (n, 2))
    return x, y


def table(spark, x, y):
    return spark.createDataFrame([(i, int(b), [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))], SCHEMA)


def test_small(spark):
    model = svm.fit(spark.createDataFrame(SMALL, SCHEMA), 1.0, 2.0)
    assert model.iterations == 21
    assert np.allclose(model.alpha, [0.81581, 0.398091, 0.81581, 0.398091], atol=1e-5)
    assert abs(model.threshold) < 1e-6 and (model.alpha > svm.ZERO).sum() == 4
    points = spark.createDataFrame([(0, 1, [1.5, 1.0]), (1, -1, [-1.5, -1.0]), (2, 1, [0.2, 0.1])], SCHEMA)
    assert np.allclose([r["f"] for r in svm.decision(points, model).orderBy("id").collect()], [1.070596, -1.070596, 0.204058], atol=1e-5)


@pytest.mark.parametrize("c,sigmasqr", [(1, 1), (10, 1), (1, 10)])
def test_optimality(c, sigmasqr):
    x, y = two_moons(150)
    alpha, f, n, up, low = svm.smo(x, y.astype(float), c, sigmasqr)
    assert n > 0 and up >= low - 2 * svm.TOL
    assert (alpha >= 0).all() and (alpha <= c).all() and abs((alpha * y).sum()) < 1e-9
    assert np.allclose(f, svm.kernel(x, x, sigmasqr) @ (alpha * y) - y, atol=1e-9)
    other, *_ = svm.smo(x, y.astype(float), c, sigmasqr, shrink=True)

    def objective(a):
        return a.sum() - 0.5 * (a * y) @ svm.kernel(x, x, sigmasqr) @ (a * y)

    assert abs(objective(alpha) - objective(other)) < 0.01 * abs(objective(alpha))


def test_working_sets_agree(spark):
    x, y = two_moons(160, 1)
    df = table(spark, x, y)
    one = svm.fit(df, 1.0, 1.0)
    rounds = svm.fit(df, 1.0, 1.0, bound=50, working=40)
    a = {r["id"]: r["f"] for r in svm.decision(df, one).collect()}
    b = {r["id"]: r["f"] for r in svm.decision(df, rounds).collect()}
    assert rounds.b_up >= rounds.b_low - 2 * svm.TOL
    assert max(abs(a[i] - b[i]) for i in a) < 0.02


@pytest.mark.parametrize("fit", [svm.fit_shrinking, svm.fit_approximate])
def test_variants_in_rounds(spark, fit):
    x, y = two_moons(160, 1)
    df = table(spark, x, y)
    one, rounds = fit(df, 1.0, 1.0), fit(df, 1.0, 1.0, bound=50, working=40)
    k = svm.kernel(x, x, 1.0)

    def objective(alpha):
        return alpha.sum() - 0.5 * (alpha * y) @ k @ (alpha * y)

    state = rounds.state.orderBy("id").toPandas()
    assert rounds.converged and one.converged
    assert not state["active"].all() or fit is svm.fit_shrinking
    assert abs(objective(one.alpha) - objective(state["alpha"].to_numpy())) < 2e-3 * objective(one.alpha)
    if fit is svm.fit_shrinking:  # the approximate one ends where its own active rows agree
        f = k @ (state["alpha"] * y).to_numpy() - y
        assert np.allclose(f, state["f"], atol=1e-8)
        a, b = ({r["id"]: r["f"] for r in svm.decision(df, m).collect()} for m in (one, rounds))
        assert max(abs(a[i] - b[i]) for i in a) < 5e-3


def test_no_convergence_is_told(spark):
    x, y = two_moons(160, 1)
    with pytest.warns(UserWarning, match="gap"):
        assert not svm.fit(table(spark, x, y), 1.0, 1.0, bound=50, working=40, max_iter=20).converged
    assert not svm.fit(table(spark, x, y), 1.0, 1.0, max_iter=20).converged


def test_decision_in_chunks(spark):
    x, y = two_moons(60, 3)
    df = table(spark, x, y)
    sv = df.filter("id % 2 = 0").select("id", (F.col("label") * 0.5).alias("weight"), "vector")
    want = svm.kernel(x, x[::2], 1.0) @ (0.5 * y[::2]) - 0.25
    for sent in (1, 100):
        got = svm.decision_in_blocks(df, sv, 0.25, 1.0, block=7, sent=sent).orderBy("id").collect()
        assert np.allclose([r["f"] for r in got], want)
    assert {r["f"] for r in svm.decision_in_blocks(df, sv.limit(0), 0.25, 1.0).collect()} == {-0.25}


def test_variants(spark):
    x, y = two_moons(120, 2)
    df = table(spark, x, y)
    scores = [svm.evaluate(svm.decision(df, fit(df, 1.0, 0.5))).first()["accuracy"] for fit in (svm.fit, svm.fit_shrinking, svm.fit_approximate)]
    assert min(scores) > 85 and abs(scores[0] - scores[1]) < 2


def test_gradient_and_state(spark):
    df = spark.createDataFrame(SMALL, SCHEMA)
    model = svm.fit(df, 1.0, 2.0)
    f = [r["f"] for r in svm.gradient(df, model).orderBy("id").collect()]
    assert np.allclose(f, svm.kernel(model.vectors, model.vectors, 2.0) @ (model.alpha * model.y) - model.y)
    state = svm.init_state(df)
    pair = svm.select_pair(state).first()
    assert (pair["b_up"], pair["i_up"], pair["b_low"], pair["i_low"]) == (-1.0, 0, 1.0, 2)
    assert svm.shrink_filter(state, -1, 1).count() == 4
    assert svm.shrink_stats(state).first()["total"] == 4
    assert svm.model_table(spark, model).count() == 4


def test_errors_and_edges(spark):
    bad = spark.createDataFrame([(0, 2, [1.0])], SCHEMA)
    with pytest.raises(ValueError):
        svm.fit(bad, 1.0, 1.0)
    with pytest.raises(Exception, match="must be"):
        svm.init_state(bad).collect()
    one_class = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [2.0])], SCHEMA)
    assert svm.fit(one_class, 1.0, 1.0).iterations == 0
    scored = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (1.0, 1.0)], "label double, f double")
    assert svm.evaluate(scored).first()["missed"] == 1  # f of 0 is wrong for +1 and right for -1
    assert svm.evaluate(scored.limit(0)).select(F.col("n")).first()["n"] == 0
