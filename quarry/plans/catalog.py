"""Registered queries and the SQL that they are held against.

Each query is a function of (spark, sf_dir) over whole tables; SQL is DuckDB's for the same rows. Doubles are rounded to 6 places.
Searches take the rows whose id is divisible by 50 as queries, against all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import kmeans, knn, metrics, network, prefix_tree, prep, spectral, svm
from quarry.sources import text

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    from quarry.plans import files, steps  # noqa: F401  they register their own

    return dict(QUERIES)


def oracle_sql() -> dict:
    queries()
    return dict(SQL)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x):
    return F.round(x, 6)


# nearest neighbours

K = 5


def points(spark, sf_dir: str) -> DataFrame:
    """id, label, vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))


def _test_train(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf_dir)
    return p.filter(F.col("id") % 50 == 0), p.filter(F.col("id") % 50 != 0)


_P = "p AS (SELECT vec_id AS id, label::INT AS label, embedding::DOUBLE[] AS v FROM embeddings)"
_NEAR = f"""WITH {_P}, n AS (SELECT q.id AS qid, q.label AS own, t.id, t.label, list_distance(q.v, t.v) AS dist FROM p q, p t WHERE q.id % 50 = 0 AND t.id % 50 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM n QUALIFY rank <= {K})"""
_MAJORITY = f"""{_NEAR}, c AS (SELECT qid, own, label, count(*) AS n, min(rank) AS near FROM r GROUP BY ALL),
m AS (SELECT qid, own AS label, label AS predicted FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, near) = 1)"""


@query(f"{_NEAR} SELECT qid, id, round(dist, 6) AS dist, rank::INT AS rank FROM r")
def knn_topk(spark, sf_dir: str) -> DataFrame:
    test, train = _test_train(spark, sf_dir)
    return knn.neighbours(test, train, K).withColumn("dist", r6("dist"))


@query(f"{_MAJORITY} SELECT * FROM m")
def knn_vote_majority(spark, sf_dir: str) -> DataFrame:
    return knn.classify(*_test_train(spark, sf_dir), K)


@query(f"""{_NEAR}, f AS (SELECT qid, own, rank, row_number() OVER (PARTITION BY qid, label ORDER BY rank DESC) * 1000000 + label + 500 AS x FROM r)
SELECT qid, own AS label, list_reduce(list(x ORDER BY rank DESC), lambda m, x: CASE WHEN x // 1000000 > m THEN x % 1000000 - 500 ELSE m END, 0)::INT AS predicted FROM f GROUP BY qid, own""")
def knn_vote_fold(spark, sf_dir: str) -> DataFrame:
    return knn.classify(*_test_train(spark, sf_dir), K, "fold")


@query(f"{_MAJORITY} SELECT count(*) AS n, count(*) FILTER (WHERE label <> predicted) AS missed, round(100.0 - missed / n * 100.0, 6) AS accuracy FROM m")
def knn_accuracy(spark, sf_dir: str) -> DataFrame:
    return metrics.accuracy(knn.classify(*_test_train(spark, sf_dir), K))


# vectors

_NEXT = f"WITH {_P}, n AS (SELECT a.id, a.v AS a, b.v AS b FROM p a JOIN p b ON b.id = a.id + 1)"
_SPARSE = f"""WITH {_P}, s AS (SELECT id, unnest(v) AS val, unnest(range(1, len(v) + 1)) AS idx FROM p), f AS (SELECT id, idx, val FROM s WHERE val > 0),
e AS (SELECT a.id, a.idx, a.val AS x, b.val AS y FROM f a JOIN f b ON b.id = a.id + 1 AND a.idx = b.idx)"""


def _sparse(spark, sf_dir: str) -> DataFrame:
    positive = F.transform("vector", lambda x: F.when(x > 0, x).otherwise(0.0))
    return points(spark, sf_dir).select("id", "label", V.sparsify(positive).alias("features"))


def _next(df: DataFrame, column: str) -> DataFrame:
    """id, a, b: each row's column and that of the row with the next id."""
    return df.select("id", F.col(column).alias("a")).join(df.select((F.col("id") - 1).alias("id"), F.col(column).alias("b")), "id")


@query(f"{_NEXT} SELECT id, round(list_inner_product(a, b), 6) AS dot, round(list_distance(a, b), 6) AS dist, round(sqrt(abs(list_inner_product(a, a) + list_inner_product(b, b) - 2 * list_inner_product(a, b))), 6) AS dist_abs FROM n")
def dense_distance(spark, sf_dir: str) -> DataFrame:
    return _next(points(spark, sf_dir), "vector").select("id", r6(V.dot("a", "b")).alias("dot"), r6(F.sqrt(V.sq_dist("a", "b"))).alias("dist"), r6(V.euclid_abs("a", "b")).alias("dist_abs"))


@query(f"{_SPARSE} SELECT p.id, round(coalesce(sum(x * y), 0), 6) AS dot FROM p LEFT JOIN e USING (id) WHERE p.id + 1 IN (SELECT id FROM p) GROUP BY p.id")
def sparse_dot(spark, sf_dir: str) -> DataFrame:
    return _next(_sparse(spark, sf_dir), "features").select("id", r6(V.sparse_dot("a", "b")).alias("dot"))


@query(f"""{_SPARSE}, n AS (SELECT id, sum(val * val) AS nn FROM f GROUP BY id), d AS (SELECT id, sum(x * y) AS xy FROM e GROUP BY id)
SELECT p.id, round(coalesce(a.nn, 0) + coalesce(b.nn, 0) - 2 * coalesce(xy, 0), 6) AS sq_dist, round(sqrt(abs(coalesce(a.nn, 0) + coalesce(b.nn, 0) - 2 * coalesce(xy, 0))), 6) AS dist
FROM p JOIN p q ON q.id = p.id + 1 LEFT JOIN n a ON a.id = p.id LEFT JOIN n b ON b.id = p.id + 1 LEFT JOIN d ON d.id = p.id""")
def sparse_sqdist(spark, sf_dir: str) -> DataFrame:
    return _next(_sparse(spark, sf_dir), "features").select("id", r6(V.sparse_sq_dist("a", "b")).alias("sq_dist"), r6(V.sparse_euclid("a", "b")).alias("dist"))


@query(f"WITH {_P}, s AS (SELECT id, unnest(v) AS val, unnest(range(1, len(v) + 1)) AS dim FROM p) SELECT id, dim::INT AS dim, round(CASE WHEN val > 0 THEN val ELSE 0 END, 6) AS val FROM s")
def densify(spark, sf_dir: str) -> DataFrame:
    dense = _sparse(spark, sf_dir).select("id", F.posexplode(V.densify("features", 64)).alias("k", "val"))
    return dense.select("id", (F.col("k") + 1).alias("dim"), r6("val").alias("val"))


@query(f"{_SPARSE}, w AS (SELECT id, count(*) AS n FROM f GROUP BY id) SELECT (SELECT max(idx) FROM f)::INT AS max_dim, (SELECT max(n) FROM w)::INT AS max_width, (SELECT count(*) FROM p) AS n")
def max_dimension(spark, sf_dir: str) -> DataFrame:
    return text.max_dimension(_sparse(spark, sf_dir))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, concat(l_linenumber, ' 1:', l_quantity, ',', l_returnflag, chr(9), l_tax, 'x') AS line FROM lineitem),
t AS (SELECT l_orderkey, l_linenumber, list_transform(list_filter(string_split_regex(line, '[ :,\\t\\r]+'), lambda t: t <> ''), lambda t: coalesce(try_cast(regexp_extract(t, '^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?') AS DOUBLE), 0.0)) AS t FROM l)
SELECT l_orderkey, l_linenumber, len(t)::INT AS n_tokens, round(list_sum(t), 6) AS total FROM t""")
def tokenize(spark, sf_dir: str) -> DataFrame:
    said = F.concat(F.col("l_linenumber").cast("string"), F.lit(" 1:"), F.col("l_quantity").cast("string"), F.lit(","), "l_returnflag", F.lit("\t"), F.col("l_tax").cast("string"), F.lit("x"))
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.tokens(said).alias("t"))
    return t.select("l_orderkey", "l_linenumber", F.size("t").alias("n_tokens"), r6(V.total("t")).alias("total"))


# items and the prefix tree

SUPPORT = 0.15
_BASKETS = "b AS (SELECT DISTINCT l_orderkey AS tid, substr(p_brand, 7)::BIGINT AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
_RANKS = f"""{_BASKETS}, n AS (SELECT count(DISTINCT tid) AS n FROM b), c AS (SELECT item, count(*) AS freq FROM b GROUP BY item),
k AS (SELECT item, freq, row_number() OVER (ORDER BY freq DESC, item) + 1 AS rank FROM c, n WHERE freq / n.n > {SUPPORT})"""
_NODES = f"""{_RANKS}, t AS (SELECT tid, list(rank ORDER BY rank DESC) AS path, list(item ORDER BY rank DESC) AS items FROM b JOIN k USING (item) GROUP BY tid),
x AS (SELECT path[:d] AS path, items[d] AS item, d FROM (SELECT path, items, unnest(range(1, len(path) + 1)) AS d FROM t)), o AS (SELECT path, item, d::INT AS depth, count(*) AS cnt FROM x GROUP BY ALL)"""


def brand_baskets(spark, sf_dir: str) -> DataFrame:
    """tid, items: the different brands of an order."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tid"), "l_partkey")
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring("p_brand", 7, 10).cast("bigint").alias("item"))
    return lines.join(brands, "l_partkey").groupBy("tid").agg(F.collect_set("item").alias("items"))


def supplier_baskets(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tid")).agg(F.collect_set("l_suppkey").alias("items"))


def _said(path: str):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">").alias(path)


@query("SELECT l_suppkey AS item, count(DISTINCT l_orderkey) AS freq FROM lineitem GROUP BY 1")
def item_frequency(spark, sf_dir: str) -> DataFrame:
    return prefix_tree.item_frequency(supplier_baskets(spark, sf_dir))


@query(f"WITH {_RANKS} SELECT item, k.freq, round(k.freq / n.n, 6) AS support FROM k, n")
def frequent_items(spark, sf_dir: str) -> DataFrame:
    return prefix_tree.frequent_items(brand_baskets(spark, sf_dir), SUPPORT).withColumn("support", r6("support"))


@query(f"WITH {_RANKS} SELECT item, freq, rank FROM k")
def item_rank(spark, sf_dir: str) -> DataFrame:
    return prefix_tree.item_rank(brand_baskets(spark, sf_dir), SUPPORT)


@query("SELECT max(l_suppkey) AS max_item FROM lineitem")
def max_item(spark, sf_dir: str) -> DataFrame:
    return prefix_tree.max_item(supplier_baskets(spark, sf_dir))


def _paths(spark, sf_dir: str) -> DataFrame:
    baskets = brand_baskets(spark, sf_dir)
    return prefix_tree.paths(baskets, prefix_tree.item_rank(baskets, SUPPORT))


@query(f"{'WITH ' + _NODES} SELECT tid, array_to_string(path, '>') AS path FROM t")
def fp_paths(spark, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("tid", _said("path"))


@query(f"WITH {_NODES} SELECT array_to_string(path, '>') AS path, item, depth, cnt FROM o")
def fp_tree_nodes(spark, sf_dir: str) -> DataFrame:
    return prefix_tree.tree_nodes(_paths(spark, sf_dir)).select(_said("path"), "item", "depth", "cnt")


@query(f"WITH {_NODES} SELECT array_to_string(path, '>') AS path, item, depth, cnt, coalesce(lag(depth) OVER (ORDER BY path) - depth + 1, 0)::BIGINT AS closers FROM o")
def fp_tree_preorder(spark, sf_dir: str) -> DataFrame:
    return prefix_tree.preorder(prefix_tree.tree_nodes(_paths(spark, sf_dir))).select(_said("path"), "item", "depth", "cnt", "closers")


@query(f"""WITH {_NODES}, w AS (SELECT path FROM o WHERE item % 2 = 0) SELECT array_to_string(path, '>') AS path, cnt FROM o
WHERE EXISTS (SELECT 1 FROM w WHERE w.path = o.path[:len(w.path)] OR o.path = w.path[:len(o.path)])""")
def fp_tree_pruned(spark, sf_dir: str) -> DataFrame:
    nodes = prefix_tree.tree_nodes(_paths(spark, sf_dir))
    return prefix_tree.prune(nodes, list(range(0, 100, 2))).select(_said("path"), "cnt")


# k-means

CLUSTERS = 8
_SEEDS = f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS cluster, v FROM p ORDER BY id LIMIT {CLUSTERS})"


def _assigned(k: int) -> str:
    d = "sqrt(abs(list_inner_product(p.v, p.v) + list_inner_product(c.v, c.v) - 2 * list_inner_product(p.v, c.v)))"
    return f"a{k} AS MATERIALIZED (SELECT p.id, p.v, c.cluster FROM p, c{k} c QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {d}, c.cluster) = 1)"


def _moved(k: int) -> str:
    return f"s{k} AS (SELECT cluster, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS dim FROM a{k}), m{k} AS MATERIALIZED (SELECT cluster, dim, avg(x) AS val FROM s{k} GROUP BY ALL), c{k + 1} AS MATERIALIZED (SELECT cluster, list(val ORDER BY dim) AS v FROM m{k} GROUP BY cluster)"


def _rounds(n: int) -> str:
    return ", ".join([f"WITH {_P}", _SEEDS, *[x for k in range(n) for x in (_assigned(k), _moved(k))]])


@query(f"WITH {_P}, {_SEEDS}, u AS (SELECT cluster, unnest(v) AS val, unnest(range(1, len(v) + 1)) AS dim FROM c0) SELECT cluster, dim::INT AS dim, round(val, 6) AS val FROM u WHERE val <> 0")
def kmeans_seed(spark, sf_dir: str) -> DataFrame:
    return kmeans.centroid_table(spark, kmeans.seeds(points(spark, sf_dir), CLUSTERS)).withColumn("val", r6("val"))


@query(f"WITH {_P}, {_SEEDS}, {_assigned(0)} SELECT id, cluster FROM a0")
def kmeans_assign(spark, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return kmeans.assign(p, kmeans.seeds(p, CLUSTERS)).select("id", "cluster")


@query(f"{_rounds(1)} SELECT cluster, dim::INT AS dim, round(val, 6) AS val FROM m0 WHERE val <> 0")
def kmeans_step(spark, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return kmeans.centroid_table(spark, kmeans.step(p, kmeans.seeds(p, CLUSTERS))[0]).withColumn("val", r6("val"))


@query(f"{_rounds(kmeans.ROUNDS)}, {_assigned(kmeans.ROUNDS)} SELECT id, cluster FROM a{kmeans.ROUNDS}")
def kmeans_fit(spark, sf_dir: str) -> DataFrame:
    return kmeans.memberships(points(spark, sf_dir), CLUSTERS)


# spectral clustering

T = 10
_GRAPH = f"""WITH {_P}, d AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS w FROM p a, p b WHERE a.id <> b.id QUALIFY row_number() OVER (PARTITION BY i ORDER BY w, j) <= {T}),
sym AS (SELECT i, j, max(w) AS w FROM (SELECT i, j, w FROM d UNION ALL SELECT j, i, w FROM d) GROUP BY ALL),
g AS (SELECT i, avg(w) AS g FROM sym GROUP BY i), sim AS (SELECT s.i, s.j, CASE WHEN w = 0 THEN 1.0 ELSE exp(-w * w / (2 * a.g * b.g)) END AS w FROM sym s JOIN g a ON a.i = s.i JOIN g b ON b.i = s.j),
t AS (SELECT i, sum(w) AS d FROM sim GROUP BY i), nrm AS (SELECT s.i, s.j, w / sqrt(a.d * b.d) AS w FROM sim s JOIN t a ON a.i = s.i JOIN t b ON b.i = s.j)"""


def _normalized(spark, sf_dir: str) -> DataFrame:
    return spectral.normalize(spectral.similarity(spectral.symmetric_closure(spectral.tnn_graph(points(spark, sf_dir), T))))


@query(f"{_GRAPH} SELECT i, j, round(w, 6) AS w FROM d")
def tnn_distance(spark, sf_dir: str) -> DataFrame:
    return spectral.tnn_graph(points(spark, sf_dir), T).withColumn("w", r6("w"))


@query(f"{_GRAPH} SELECT i, j, round(w, 6) AS w FROM sym")
def tnn_symmetric(spark, sf_dir: str) -> DataFrame:
    return spectral.symmetric_closure(spectral.tnn_graph(points(spark, sf_dir), T)).withColumn("w", r6("w"))


@query(f"{_GRAPH} SELECT i, j, round(w, 6) AS w FROM sim")
def similarity_selftuned(spark, sf_dir: str) -> DataFrame:
    return spectral.similarity(spectral.symmetric_closure(spectral.tnn_graph(points(spark, sf_dir), T))).withColumn("w", r6("w"))


@query(f"{_GRAPH} SELECT i, j, round(w, 6) AS w FROM nrm")
def laplacian_norm(spark, sf_dir: str) -> DataFrame:
    return _normalized(spark, sf_dir).withColumn("w", r6("w"))


@query(f"{_GRAPH} SELECT i AS id, round(sum(w / (1 + j)), 6) AS y FROM nrm GROUP BY i")
def matvec(spark, sf_dir: str) -> DataFrame:
    x = points(spark, sf_dir).select("id", (1.0 / (1 + F.col("id"))).alias("x"))
    return spectral.matvec(_normalized(spark, sf_dir), x).withColumn("y", r6("y"))


@query()
def evd_top(spark, sf_dir: str) -> DataFrame:
    values, _, _ = spectral.eigenpairs(_normalized(spark, sf_dir), 8)
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(values)], "k int, value double")


@query()
def spectral_clusters(spark, sf_dir: str) -> DataFrame:
    return spectral.spectral_clusters(points(spark, sf_dir), CLUSTERS, T)


# support vector machines; the multipliers of the single steps are stated: by id mod 4, with C = 1

C, SIGMASQR, THRESHOLD = 1.0, 0.5, 0.125
_ROWS = "s AS (SELECT id, v, CASE WHEN label < 5 THEN 1.0 ELSE -1.0 END AS y FROM p)"
_STATE = f"WITH {_P}, {_ROWS}, m AS (SELECT *, CASE id % 4 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 0.0 END AS alpha, ((id * 37) % 101 - 50) / 50.0 - y AS f FROM s), z AS (SELECT *, CASE WHEN alpha > 0 AND alpha < 1 THEN 0 WHEN y > 0 THEN CASE WHEN alpha = 0 THEN 1 ELSE 3 END ELSE CASE WHEN alpha = 0 THEN 4 ELSE 2 END END AS setinfo FROM m)"
_PAIR = f"{_STATE}, b AS (SELECT (SELECT min(f) FROM z WHERE setinfo IN (0, 1, 2)) AS b_up, (SELECT max(f) FROM z WHERE setinfo IN (0, 3, 4)) AS b_low)"
_KERNEL = "exp((2 * list_inner_product(a.v, b.v) - list_inner_product(a.v, a.v) - list_inner_product(b.v, b.v)) / (2 * 0.5))"


def svm_rows(spark, sf_dir: str) -> DataFrame:
    """id, label (+1 for labels under 5, else -1), vector."""
    return points(spark, sf_dir).withColumn("label", F.when(F.col("label") < 5, 1).otherwise(-1))


def _state(spark, sf_dir: str) -> DataFrame:
    y = F.col("label").cast("double")
    alpha = F.when(F.col("id") % 4 == 1, 0.5).when(F.col("id") % 4 == 2, 1.0).otherwise(0.0)
    out = svm_rows(spark, sf_dir).select("id", y.alias("y"), alpha.alias("alpha"), (((F.col("id") * 37) % 101 - 50) / 50.0 - y).alias("f"))
    return out.withColumn("setinfo", svm.set_of(F.col("y"), F.col("alpha"), C))


@query(f"WITH {_P}, n AS (SELECT a.id, a, b FROM (SELECT id, {{'v': v}} AS a FROM p) a JOIN (SELECT id, {{'v': v}} AS b FROM p) b ON b.id = a.id + 1) SELECT id, round({_KERNEL}, 6) AS k FROM n")
def rbf_kernel(spark, sf_dir: str) -> DataFrame:
    return _next(points(spark, sf_dir), "vector").select("id", r6(V.rbf(V.dot("a", "b"), V.norm_sq("a"), V.norm_sq("b"), SIGMASQR)).alias("k"))


@query(f"WITH {_P}, {_ROWS} SELECT id, y::DOUBLE AS y, 0.0::DOUBLE AS alpha, -y::DOUBLE AS f, CASE WHEN y > 0 THEN 1 ELSE 4 END AS setinfo FROM s")
def svm_init_state(spark, sf_dir: str) -> DataFrame:
    return svm.init_state(svm_rows(spark, sf_dir))


@query(f"{_STATE} SELECT id, setinfo FROM z")
def svm_sets(spark, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select("id", "setinfo")


@query(f"{_PAIR} SELECT round(b_up, 6)::DOUBLE AS b_up, (SELECT min(id) FROM z WHERE setinfo IN (0, 1, 2) AND f = b_up) AS i_up, round(b_low, 6)::DOUBLE AS b_low, (SELECT min(id) FROM z WHERE setinfo IN (0, 3, 4) AND f = b_low) AS i_low FROM b")
def svm_select_pair(spark, sf_dir: str) -> DataFrame:
    return svm.select_pair(_state(spark, sf_dir)).withColumns({"b_up": r6("b_up"), "b_low": r6("b_low")})


@query(f"{_STATE} SELECT round(avg(f) FILTER (WHERE setinfo = 0), 6)::DOUBLE AS threshold, count(*) FILTER (WHERE alpha > 0) AS nsv FROM z")
def svm_threshold(spark, sf_dir: str) -> DataFrame:
    return svm.threshold(_state(spark, sf_dir), C).withColumn("threshold", r6("threshold"))


@query(f"{_STATE} SELECT id FROM z WHERE NOT (setinfo IN (3, 4) AND f < -0.5 OR setinfo IN (1, 2) AND f > 0.5)")
def svm_shrink_filter(spark, sf_dir: str) -> DataFrame:
    return svm.shrink_filter(_state(spark, sf_dir), -0.5, 0.5).select("id")


def _support(spark, sf_dir: str) -> DataFrame:
    rows = svm_rows(spark, sf_dir).filter(F.col("id") % 50 == 0)
    return rows.select("id", (F.col("label") * (F.col("id") % 4 + 1) / 4.0).alias("weight"), "vector")


_DECISION = f"WITH {_P}, {_ROWS}, f AS (SELECT b.id, b.y, sum(a.y * (a.id % 4 + 1) / 4.0 * {_KERNEL}) AS f FROM s a, s b WHERE a.id % 50 = 0 GROUP BY ALL)"


@query(f"{_DECISION} SELECT id, y::DOUBLE AS label, round(f - {THRESHOLD}, 6) AS f FROM f")
def svm_decision(spark, sf_dir: str) -> DataFrame:
    return svm.decision_in_blocks(svm_rows(spark, sf_dir), _support(spark, sf_dir), THRESHOLD, SIGMASQR).withColumn("f", r6("f"))


@query(f"{_DECISION} SELECT id, round(f - y, 6) AS f FROM f")
def svm_gradient_reconstruct(spark, sf_dir: str) -> DataFrame:
    f = svm.decision_in_blocks(svm_rows(spark, sf_dir), _support(spark, sf_dir), 0.0, SIGMASQR)
    return f.select("id", r6(F.col("f") - F.col("label")).alias("f"))


@query(f"{_DECISION}, e AS (SELECT f - {THRESHOLD} AS f, y FROM f) SELECT count(*) AS n, count(*) FILTER (WHERE f < 1e-12 AND y > 0 OR f > 1e-12 AND y < 0) AS missed, round(100.0 * (n - missed) / n, 6) AS accuracy FROM e")
def svm_accuracy(spark, sf_dir: str) -> DataFrame:
    return svm.evaluate(svm.decision_in_blocks(svm_rows(spark, sf_dir), _support(spark, sf_dir), THRESHOLD, SIGMASQR))


def _trained(spark, sf_dir: str, fit) -> DataFrame:
    rows = svm_rows(spark, sf_dir)
    model = fit(rows.filter(F.col("id") % 5 != 0), C, SIGMASQR)
    return svm.evaluate(svm.decision(rows.filter(F.col("id") % 5 == 0), model))


@query()
def svm_train(spark, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, svm.fit)


@query()
def svm_train_shrinking(spark, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, svm.fit_shrinking)


@query()
def svm_train_approximate(spark, sf_dir: str) -> DataFrame:
    return _trained(spark, sf_dir, svm.fit_approximate)


@query()
def svm_train_rounds(spark, sf_dir: str) -> DataFrame:
    """The rounds that tables of more rows than one task takes go through, on these."""
    return _trained(spark, sf_dir, lambda rows, *how: svm.fit_shrinking(rows, *how, bound=100))


# dataset preparation

_SPLIT = "n AS (SELECT count(*) AS n FROM labels), r AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM labels), s AS (SELECT doc_id, quality, pos, CASE WHEN pos < n - n * 10 // 100 - n * 20 // 100 THEN 'train' WHEN pos < n - n * 10 // 100 THEN 'validation' ELSE 'test' END AS part FROM r, n)"


@query(f"WITH {_SPLIT} SELECT doc_id, pos, part FROM s")
def csv_split(spark, sf_dir: str) -> DataFrame:
    return prep.split_in_order(table(spark, sf_dir, "labels"), 20, 10, ["doc_id"]).select("doc_id", "pos", "part")


@query("SELECT doc_id, CASE WHEN pos < (SELECT count(*) FROM labels) * 15 // 100 THEN 'validation' ELSE 'train' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM labels)")
def validation_first(spark, sf_dir: str) -> DataFrame:
    return prep.split_validation_first(table(spark, sf_dir, "labels"), 15, ["doc_id"]).select("doc_id", "part")


@query("SELECT doc_id, quality::INT AS label FROM labels")
def label_remap(spark, sf_dir: str) -> DataFrame:
    signed = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 - 1).cast("int").alias("label"))
    return prep.remap_labels(signed)


@query("SELECT min(label)::INT AS least, max(label)::INT AS most, (max(label) + 1)::INT AS classes FROM embeddings")
def class_range(spark, sf_dir: str) -> DataFrame:
    return prep.class_range(points(spark, sf_dir))


@query("SELECT vec_id AS id, k::INT AS k, CASE WHEN label = k THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM embeddings, range(0, (SELECT max(label) + 1 FROM embeddings)) t(k)")
def one_hot(spark, sf_dir: str) -> DataFrame:
    return prep.with_one_hot(points(spark, sf_dir)).select("id", F.posexplode("onehot").alias("k", "v"))


_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("WITH s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _COLUMNS) + " FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _COLUMNS) + " FROM lineitem, s")
def standardize(spark, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_COLUMNS)
    return prep.standardize(df, _COLUMNS, None).select("l_orderkey", "l_linenumber", *[r6(c).alias(c) for c in _COLUMNS])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS sd FROM lineitem" for c in _COLUMNS))
def column_stats(spark, sf_dir: str) -> DataFrame:
    return prep.column_stats(table(spark, sf_dir, "lineitem"), _COLUMNS).withColumns({"mean": r6("mean"), "sd": r6("sd")})


# networks: one layer with stated weights as expressions, and training


def _weight(d: int, j: int) -> float:
    return ((d * 3 + j) % 7 - 3) / 10


_LAYER = f"WITH {_P}, h AS (SELECT id, label, list_transform(range(0, 10), lambda j: 1 / (1 + exp(-(list_sum(list_transform(range(0, len(v)), lambda d: v[d + 1] * ((d * 3 + j) % 7 - 3) / 10)) + j / 10)))) AS h FROM p)"


def _layer(spark, sf_dir: str) -> DataFrame:
    """id, label, scores: ten sigmoid outputs."""
    return points(spark, sf_dir).select("id", "label", V.dense_layer("vector", [[_weight(d, j) for j in range(10)] for d in range(64)], [j / 10 for j in range(10)]).alias("scores"))


@query(f"{_LAYER}, u AS (SELECT id, unnest(h) AS v, unnest(range(0, 10)) AS k FROM h) SELECT id, k::INT AS k, round(v, 6) AS v FROM u")
def dense_forward(spark, sf_dir: str) -> DataFrame:
    return _layer(spark, sf_dir).select("id", F.posexplode("scores").alias("k", "v")).withColumn("v", r6("v"))


@query(f"{_LAYER}, e AS (SELECT id, label, list_transform(h, lambda x: exp(x)) AS e FROM h) SELECT id, round(-ln(greatest(least(e[label + 1] / list_sum(e), 1), 1e-10)), 6) AS loss FROM e")
def softmax_loss(spark, sf_dir: str) -> DataFrame:
    return _layer(spark, sf_dir).select("id", r6(V.cross_entropy(V.one_hot("label", 10), V.softmax("scores"))).alias("loss"))


@query(f"{_LAYER}, t AS (SELECT len(list_filter(h, lambda x: x > h[label + 1])) < 5 AS ok FROM h) SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS hits, round(100.0 * hits / n, 6) AS accuracy FROM t")
def in_top_k(spark, sf_dir: str) -> DataFrame:
    return metrics.top_k_accuracy(_layer(spark, sf_dir), 5)


@query()
def mlp_train(spark, sf_dir: str) -> DataFrame:
    """Loss and accuracy of three epochs of whole-table gradient descent."""
    rows = points(spark, sf_dir).select("id", F.col("vector").alias("x"), "label", F.lit(0).alias("batch"))
    net = network.Network(64, 10, [16], seed=1)
    history = network.Trainer(net, rate=0.5).fit(rows, 3, 1)
    return spark.createDataFrame([(h["epoch"], round(h["loss"], 6), round(h["accuracy"], 6)) for h in history], "epoch int, loss double, accuracy double")
