"""Queries for single steps of the iterative operators, and for what evaluates them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.functions.plan import cut
from quarry.operators import kmeans, metrics, network, prefix_tree, prep, svm
from quarry.plans import catalog
from quarry.plans.catalog import C, CLUSTERS, SIGMASQR, SUPPORT, _NODES, _P, _SEEDS, _STATE, _assigned, _moved, brand_baskets, points, query, r6, table
from quarry.sources import images


@query(f"WITH {_NODES} SELECT array_to_string(path, '>') AS path, item, depth, cnt FROM o")
def fp_tree_merge(spark, sf_dir: str) -> DataFrame:
    """Two trees, of the even and the odd orders, merged."""
    baskets = brand_baskets(spark, sf_dir)
    found = cut(prefix_tree.paths(baskets, prefix_tree.item_rank(baskets, SUPPORT)))
    halves = [prefix_tree.tree_nodes(found.filter(F.col("tid") % 2 == k)) for k in (0, 1)]
    return prefix_tree.merge_trees(*halves).select(catalog._said("path"), "item", "depth", "cnt")


@query(f"""WITH {_P}, {_SEEDS}, {_assigned(0)}, {_moved(0)}, {_assigned(1)}, {_moved(1)}, {_assigned(2)}
SELECT 0 AS round, count(*) AS changed FROM a0 UNION ALL SELECT 1, count(*) FILTER (WHERE a0.cluster <> a1.cluster) FROM a0 JOIN a1 USING (id)
UNION ALL SELECT 2, count(*) FILTER (WHERE a1.cluster <> a2.cluster) FROM a1 JOIN a2 USING (id)""")
def kmeans_changed(spark, sf_dir: str) -> DataFrame:
    history = kmeans.fit(points(spark, sf_dir), CLUSTERS, rounds=3)[1]
    return spark.createDataFrame(list(enumerate(history)), "round int, changed bigint")


@query("SELECT batch, count(*) AS n FROM (SELECT CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 64) AS BIGINT) AS batch FROM embeddings) GROUP BY batch")
def batch_sizes(spark, sf_dir: str) -> DataFrame:
    return prep.batches(points(spark, sf_dir), 64, epoch=1, seed=3).groupBy("batch").agg(F.countDistinct("id").alias("n"))


@query("WITH w AS (SELECT vec_id AS id, sum(vec_id % 7 + 1) OVER (ORDER BY vec_id) AS upto, sum(vec_id % 7 + 1) OVER () AS total FROM embeddings) SELECT min(id) AS id FROM w WHERE upto > 0.37 * total")
def weighted_choice(spark, sf_dir: str) -> DataFrame:
    weights = points(spark, sf_dir).select("id", (F.col("id") % 7 + 1).cast("double").alias("weight"))
    return prep.weighted_choice(weights, 0.37).select("id")


@query(f"WITH {_P}, u AS (SELECT id, unnest(v) AS x, unnest(range(0, len(v))) AS k FROM p) SELECT id, k::INT AS k, round((x / 255)::FLOAT::DOUBLE, 6) AS v FROM u")
def pixel_scaling(spark, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", F.posexplode(V.scaled("vector")).alias("k", "v")).withColumn("v", r6(F.col("v").cast("double")))


_PIXELS = f"WITH {_P}, x AS (SELECT id, label, unnest(v) AS x, unnest(range(0, len(v))) AS k FROM p), g AS (SELECT id, x, k // 8 AS r, k % 8 AS c, k FROM x)"


@query(f"{_PIXELS}, m AS (SELECT k, avg(x::FLOAT::DOUBLE) AS m FROM g GROUP BY k) SELECT id, ((r - 1) * 6 + c - 1)::INT AS k, round((x::FLOAT - m::FLOAT)::DOUBLE, 6) AS v FROM g JOIN m USING (k) WHERE r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6")
def image_transform(spark, sf_dir: str) -> DataFrame:
    """Vectors as images of 8 by 8: less the mean image, cropped to 6 by 6 at the centre."""
    df = points(spark, sf_dir).select("id", F.col("vector").cast("array<float>").alias("pixels"), "label")
    out = images.transform_images(df, (1, 8, 8), crop=(6, 6), mean=images.mean_image(df))
    return out.select("id", F.posexplode("pixels").alias("k", "v")).withColumn("v", r6(F.col("v").cast("double")))


def _kernel_weight(i: int, j: int) -> float:
    return ((i * 5 + j) * 7 % 11 - 5) / 10


@query(f"""{_PIXELS}, w AS (SELECT i, j, (((i * 5 + j) * 7) % 11 - 5) / 10 AS w FROM range(0, 5) a(i), range(0, 5) b(j)),
o AS (SELECT q.id, q.r, q.c, greatest(sum(g.x * w.w) + 0.1, 0) AS z FROM g q JOIN w ON true JOIN g ON g.id = q.id AND g.r = q.r + w.i - 2 AND g.c = q.c + w.j - 2 GROUP BY ALL)
SELECT id, (r // 2)::INT AS r, (c // 2)::INT AS c, round(max(z), 6) AS v FROM o GROUP BY ALL""")
def conv_layer(spark, sf_dir: str) -> DataFrame:
    """A 5 by 5 convolution with stated weights, ReLU and 2 by 2 pooling over vectors as images."""
    w = np.array([[_kernel_weight(i, j) for j in range(5)] for i in range(5)]).reshape(5, 5, 1, 1)

    def run(batches):
        for pdf in batches:
            x = np.array(pdf["vector"].tolist(), float).reshape(-1, 8, 8, 1)
            out = network.pool_same(np.maximum(network.conv_same(x, w, np.array([0.1])), 0))[0] if len(x) else x
            n, h, wd = out.shape[:3]
            yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), h * wd), "r": np.tile(np.repeat(np.arange(h), wd), n), "c": np.tile(np.arange(wd), n * h), "v": out.ravel()})

    return points(spark, sf_dir).select("id", "vector").mapInPandas(run, "id bigint, r int, c int, v double").withColumn("v", r6("v"))


@query(f"""WITH {_P}, x AS (SELECT label, unnest(v) AS x, unnest(range(0, len(v))) AS d FROM p)
SELECT d::INT AS d, k::INT AS k, round(-0.5 * avg(x * (0.1 - CASE WHEN label = k THEN 1 ELSE 0 END)), 6) AS w FROM x, range(0, 10) t(k) GROUP BY d, k
UNION ALL SELECT -1, k::INT, round(-0.5 * 2 * avg(0.1 - CASE WHEN label = k THEN 1 ELSE 0 END), 6) FROM p, range(0, 10) t(k) GROUP BY k""")
def gradient_step(spark, sf_dir: str) -> DataFrame:
    """Weights (d, k) and biases (-1, k) of a softmax layer after one step from zero over the whole table; biases move twice as fast."""
    net = network.Network(64, 10)
    net.params = [np.zeros_like(p) for p in net.params]
    trainer = network.Trainer(net, rate=0.5, bias_rate=2.0, momentum=0.9, l2=0.01)  # neither counts in a first step from zero
    sums, _, _, n = network.gradient_sums(points(spark, sf_dir).select(F.col("vector").alias("x"), "label"), net)
    trainer.update(sums, n)
    weights, biases = net.params
    rows = [(d, k, float(weights[d, k])) for d in range(64) for k in range(10)] + [(-1, k, float(biases[k])) for k in range(10)]
    return spark.createDataFrame(rows, "d int, k int, w double").withColumn("w", r6("w"))


@query("SELECT s::INT AS step, round(0.5 * power(0.1, s // 4), 9) AS stepped, round(0.5 / (1 + 0.9 * s / 10), 9) AS inverse, round(0.5 * power(0.999964, s), 9) AS exponential FROM range(0, 12) t(s)")
def rate_schedules(spark, sf_dir: str) -> DataFrame:
    rows = [(s, network.step_decay(0.5, s, 4), network.inverse_time_decay(0.5, s, 10, 0.9), network.exponential_decay(0.5, s)) for s in range(12)]
    df = spark.createDataFrame(rows, "step int, stepped double, inverse double, exponential double")
    return df.select("step", *[F.round(c, 9).alias(c) for c in df.columns[1:]])


_EPOCHS = "e AS (SELECT CAST(date_part('doy', ts) AS INT) AS epoch, round(avg(value), 6) AS accuracy FROM events GROUP BY 1)"


@query(f"WITH {_EPOCHS} SELECT epoch, accuracy, max(accuracy) OVER w AS best, accuracy > coalesce(max(accuracy) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS is_best FROM e WINDOW w AS (ORDER BY epoch)")
def running_best(spark, sf_dir: str) -> DataFrame:
    """A day of events as an epoch, its mean value as the accuracy."""
    epochs = table(spark, sf_dir, "events").groupBy(F.dayofyear("ts").alias("epoch")).agg(r6(F.avg("value")).alias("accuracy"))
    return metrics.running_best(epochs)


@query(f"{catalog._LAYER}, e AS (SELECT id, label, list_transform(h, lambda x: exp(x)) AS e FROM h), l AS (SELECT id, round(-ln(greatest(least(e[label + 1] / list_sum(e), 1), 1e-10)), 6) AS loss FROM e) SELECT id, loss FROM l WHERE loss > (SELECT quantile_cont(loss, 0.75) FROM l)")
def sample_elimination(spark, sf_dir: str) -> DataFrame:
    return metrics.drop_easy(catalog.QUERIES["softmax_loss"](spark, sf_dir), percentile=0.75)


@query(f"{_STATE} SELECT count(*) AS total FROM z")
def svm_shrink_stats(spark, sf_dir: str) -> DataFrame:
    """Largest and smallest share depend on how the table is split; their sum does not."""
    return svm.shrink_stats(catalog._state(spark, sf_dir)).select("total")


@query(f"""{_STATE}, b AS (SELECT (SELECT arg_min(id, (f, id)) FROM z WHERE setinfo IN (0, 1, 2)) AS i, (SELECT arg_max(id, (f, -id)) FROM z WHERE setinfo IN (0, 3, 4)) AS j),
q AS (SELECT u.v AS v1, l.v AS v2, u.id AS i, l.id AS j, u.y AS y1, l.y AS y2, u.alpha AS a1, l.alpha AS a2, l.f - u.f AS slope, list_inner_product(u.v, u.v) AS n1, list_inner_product(l.v, l.v) AS n2 FROM b JOIN z u ON u.id = i JOIN z l ON l.id = j),
k AS (SELECT *, 2 - 2 * exp((2 * list_inner_product(v1, v2) - n1 - n2) / {2 * SIGMASQR}) AS curve, greatest(CASE WHEN y1 > 0 THEN -a1 ELSE a1 - {C} END, CASE WHEN y2 > 0 THEN a2 - {C} ELSE -a2 END) AS low, least(CASE WHEN y1 > 0 THEN {C} - a1 ELSE a1 END, CASE WHEN y2 > 0 THEN a2 ELSE {C} - a2 END) AS high FROM q),
sh AS (SELECT *, least(greatest(slope / curve, low), high) AS t FROM k)
SELECT z.id, round(z.alpha + CASE z.id WHEN i THEN y1 * t WHEN j THEN -y2 * t ELSE 0 END, 6) AS alpha,
  round(z.f + t * (exp((2 * list_inner_product(z.v, v1) - list_inner_product(z.v, z.v) - n1) / {2 * SIGMASQR}) - exp((2 * list_inner_product(z.v, v2) - list_inner_product(z.v, z.v) - n2) / {2 * SIGMASQR})), 6) AS f FROM z, sh""")
def svm_pair_step(spark, sf_dir: str) -> DataFrame:
    """Multipliers and gradient of all rows after one step on the most violating pair of the stated state."""
    state = catalog._state(spark, sf_dir).join(points(spark, sf_dir).select("id", "vector"), "id").withColumn("active", F.lit(True))
    pair = svm.select_pair(state).first()
    rows = {r["id"]: r for r in state.filter(F.col("id").isin(pair["i_up"], pair["i_low"])).collect()}
    u, low = rows[pair["i_up"]], rows[pair["i_low"]]
    x = np.array([u["vector"], low["vector"]])
    k = svm.kernel(x, x, SIGMASQR)
    new1, new2, d1, d2 = svm.pair_step(u["y"], low["y"], u["alpha"], low["alpha"], u["f"], low["f"], k[0, 0], k[0, 1], k[1, 1], C)
    after = svm._updated(state, np.array([u["id"], low["id"]]), x, np.array([u["y"] * d1, low["y"] * d2]), np.array([new1, new2]), SIGMASQR)
    return after.select("id", r6("alpha").alias("alpha"), r6("f").alias("f"))
