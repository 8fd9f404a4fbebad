"""Queries that write a table to files and read it back: the sources and sinks, held against SQL on the table."""

from __future__ import annotations

import pickle
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.functions.plan import shared_folder
from quarry.operators import kmeans, prep, spectral
from quarry.plans import catalog
from quarry.plans.catalog import CLUSTERS, _GRAPH, _P, _SEEDS, _SPARSE, _assigned, _sparse, points, query, r6
from quarry.sources import images, netcdf, text
from quarry.sources.files import listed, write_packed


def _path(spark) -> str:
    return f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"


def _put(df: DataFrame, order: str) -> str:
    path = _path(df.sparkSession)
    text.write_lines(df, order, path)
    return path


def _entries(features: str):
    return F.array_join(F.transform(features, lambda p: F.concat(p["idx"].cast("string"), F.lit(":"), p["val"].cast("string"))), " ")


#: A number of 6 significant digits, as sinks of matrices write it.
def _six(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round({x}, 5 - floor(log10(abs({x})))::INT) END"


@query(f"{_SPARSE}, r AS (SELECT id AS key, label, row_number() OVER (ORDER BY id) - 1 AS id FROM p) SELECT r.id, label, idx::INT AS idx, round(val, 6) AS val FROM r JOIN f ON f.id = r.key")
def sparse_text(spark, sf_dir: str) -> DataFrame:
    rows = _sparse(spark, sf_dir).select("id", F.concat_ws(" ", F.col("label").cast("string"), _entries("features")).alias("value"))
    back = text.read_labelled(spark, _put(rows, "id"))
    return back.select("id", "label", F.inline("features").alias("idx", "val")).withColumn("val", r6("val"))


@query(f"{_SPARSE}, r AS (SELECT id AS key, row_number() OVER (ORDER BY id) - 1 AS id FROM p WHERE id IN (SELECT id FROM f)) SELECT r.id, idx::INT AS idx, round(val, 6) AS val FROM r JOIN f ON f.id = r.key")
def unlabelled_text(spark, sf_dir: str) -> DataFrame:
    rows = _sparse(spark, sf_dir).select("id", _entries("features").alias("value"))
    return text.read_unlabelled(spark, _put(rows, "id")).select("id", F.inline("features").alias("idx", "val")).withColumn("val", r6("val"))


@query("SELECT count(*) FILTER (WHERE l_linenumber <> 2) AS n, count(*) AS n_all FROM lineitem")
def text_rows(spark, sf_dir: str) -> DataFrame:
    lines = catalog.table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 2, " , ").otherwise(F.col("l_quantity").cast("string")).alias("value"))
    path = _put(lines, "l_orderkey")
    return text.n_rows(spark, path).join(text.n_rows(spark, path, blank=True).withColumnRenamed("n", "n_all"))


@query(f"{_SPARSE}, k AS (SELECT id AS key, row_number() OVER (ORDER BY id) - 1 AS id FROM p WHERE id % 7 <> 0 AND id IN (SELECT id FROM f)) SELECT k.id, round(sum(val * val), 6) AS norm_sq FROM k JOIN f ON f.id = k.key GROUP BY k.id")
def document_text(spark, sf_dir: str) -> DataFrame:
    rows = _sparse(spark, sf_dir).select("id", F.concat(F.when(F.col("id") % 7 == 0, "# ").otherwise(""), _entries("features")).alias("value"))
    return text.read_documents(spark, _put(rows, "id")).select("id", r6("norm_sq").alias("norm_sq"))


@query("""WITH t AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS items FROM lineitem GROUP BY 1), r AS (SELECT row_number() OVER (ORDER BY l_orderkey) - 1 AS tid, items FROM t)
SELECT tid, array_to_string(items, ' ') AS items FROM r""")
def transaction_text(spark, sf_dir: str) -> DataFrame:
    items = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string"))
    rows = catalog.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(items, " ").alias("value"))
    back = text.read_transactions(spark, _put(rows, "l_orderkey"))
    return back.select("tid", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"))


@query(f"{_GRAPH}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS line FROM p) SELECT r.line AS i, j, {_six('w')} AS w FROM sym JOIN r ON r.id = sym.i")
def edge_text(spark, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    path = _path(spark)
    text.write_edges(spectral.symmetric_closure(spectral.tnn_graph(p, catalog.T)), path, p.select("id"))
    return text.read_edges(spark, path)


@query(f"WITH {_P}, {_SEEDS}, {_assigned(0)} SELECT row_number() OVER (ORDER BY id) - 1 AS id, cluster FROM a0")
def membership_text(spark, sf_dir: str) -> DataFrame:
    p, path = points(spark, sf_dir), _path(spark)
    text.write_memberships(kmeans.assign(p, kmeans.seeds(p, CLUSTERS)), path)
    return text.read_memberships(spark, path)


@query(f"WITH {_P}, {_SEEDS}, u AS (SELECT cluster, unnest(v) AS val, unnest(range(1, len(v) + 1)) AS dim FROM c0) SELECT cluster::BIGINT AS id, dim::INT AS idx, {_six('val')} AS val FROM u WHERE val <> 0")
def centroid_text(spark, sf_dir: str) -> DataFrame:
    lines = text.centroid_lines(kmeans.centroid_table(spark, kmeans.seeds(points(spark, sf_dir), CLUSTERS)))
    return text.read_unlabelled(spark, _put(lines, "cluster")).select("id", F.inline("features").alias("idx", "val"))


@query(f"WITH {_P}, r AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, v FROM p), u AS (SELECT id, unnest(v) AS v, unnest(range(0, len(v))) AS k FROM r) SELECT id, k::INT AS k, round(v, 6) AS v FROM u")
def vector_text(spark, sf_dir: str) -> DataFrame:
    path = _path(spark)
    text.write_vectors(points(spark, sf_dir), path, "vector")
    return text.read_vectors(spark, path).select("id", F.posexplode("vector").alias("k", "v")).withColumn("v", r6("v"))


_X = ", ".join(f"v[{d}] AS x{d}" for d in range(1, 5))


@query(f"""WITH {_P}, r AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, label % 3 AS label, {_X}, count(*) OVER () AS n FROM p),
s AS (SELECT *, CASE WHEN id < n - n * 10 // 100 - n * 20 // 100 THEN 'train' WHEN id < n - n * 10 // 100 THEN 'validation' ELSE 'test' END AS part FROM r),
t AS (SELECT {", ".join(f"avg(x{d}) AS m{d}, stddev_pop(x{d}) AS s{d}" for d in range(1, 5))} FROM s WHERE part = 'train')
SELECT id, part, label::INT AS label, {", ".join(f"round((x{d} - m{d}) / s{d}, 6) AS x{d}" for d in range(1, 5))} FROM s, t""")
def csv_text(spark, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("id", F.concat_ws(",", (F.col("label") % 3).cast("string"), *[F.get("vector", F.lit(d)).cast("string") for d in range(4)]).alias("value"))
    back = prep.read_csv(spark, _put(rows, "id"), 20, 10)
    return back.select("id", "part", "label", *[r6(F.get("x", F.lit(d))).alias(f"x{d + 1}") for d in range(4)])


@query(f"WITH {_P}, n AS (SELECT a.id, a.v AS a, b.v AS b FROM p a JOIN p b ON b.id = a.id + 1) SELECT id, round(sqrt(list_inner_product(a, a) + list_inner_product(b, b) - 2 * list_inner_product(a, b)), 6) AS dist FROM n")
def dense_euclid(spark, sf_dir: str) -> DataFrame:
    return catalog._next(points(spark, sf_dir), "vector").select("id", r6(V.euclid("a", "b")).alias("dist"))


def _bytes(spark, sf_dir: str) -> DataFrame:
    """id, label, data: vectors as bytes."""
    return points(spark, sf_dir).select("id", "label", F.transform("vector", lambda x: F.pmod(F.floor(x * 100), F.lit(256)).cast("int")).alias("data"))


_HEX = "array_to_string(list_transform(v, lambda x: printf('%02X', (floor(x * 100)::INT % 256 + 256) % 256)), '') AS data"


def _netcdf(spark, sf_dir: str) -> str:
    path = _path(spark)
    write_packed(_bytes(spark, sf_dir), path, lambda pdf: netcdf.pack(np.array(pdf["data"].tolist(), np.uint8), pdf["label"].to_numpy()), 500)
    return path


@query(f"WITH {_P} SELECT row_number() OVER (ORDER BY id) - 1 AS id, label, {_HEX} FROM p")
def netcdf_rows(spark, sf_dir: str) -> DataFrame:
    return netcdf.read_netcdf(spark, _netcdf(spark, sf_dir), rows_per_partition=200).select("id", "label", F.hex("data").alias("data"))


@query("SELECT u.name, u.kind, u.dims, count(*) AS n_rows, u.width FROM embeddings, (VALUES ('data', 'BYTE', 'row,byte', 64), ('labels', 'INT', 'row', 1)) u(name, kind, dims, width) GROUP BY ALL")
def netcdf_metadata(spark, sf_dir: str) -> DataFrame:
    found = [v for path in listed(_netcdf(spark, sf_dir)) for v in netcdf.describe(path)]  # two variables a file
    rows = [(v["name"], v["kind"], ",".join(v["dims"]), v["shape"][0], int(np.prod(v["shape"][1:]))) for v in found]
    return spark.createDataFrame(rows, "name string, kind string, dims string, n bigint, width int").groupBy("name", "kind", "dims", "width").agg(F.sum("n").alias("n_rows"))


@query(f"WITH {_P} SELECT label, {_HEX} FROM p")
def image_batches(spark, sf_dir: str) -> DataFrame:
    """Batch files of images, as pickled arrays; their rows are numbered by file, so only labels and pixels are held against the table."""
    path = _path(spark)
    write_packed(_bytes(spark, sf_dir), path, lambda pdf: pickle.dumps({b"data": np.array(pdf["data"].tolist(), np.uint8), b"labels": pdf["label"].tolist()}), 500)
    back = images.read_cifar(spark, path, scale=False)
    return back.select("label", F.array_join(F.transform("pixels", lambda x: F.lpad(F.hex(x.cast("int")), 2, "0")), "").alias("data"))
