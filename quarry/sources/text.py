"""Text sources and sinks: sparse samples, transactions, documents, edge lists, memberships.

Delimiters are blanks, colons, commas and tabs; runs of them count once. A token's numeric prefix is its value, and 0.0
where there is none. Blank lines are skipped, and ids count the lines that are left from 0, in file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.plan import SPLIT, with_position, with_split

DELIMITERS = r"[ :,\t\r]+"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def number(token: Column) -> Column:
    found = F.regexp_extract(token, NUMBER, 0)
    return F.coalesce(F.when(found != "", found.try_cast("double")), F.lit(0.0))


def tokens(line: str | Column) -> Column:
    """All numbers of a line as array<double>."""
    line = F.col(line) if isinstance(line, str) else line
    return F.transform(F.filter(F.split(line, DELIMITERS), lambda t: t != ""), number)


def pairs(values: Column) -> Column:
    """index, value, index, value ... as array<struct<idx, val>>; a last odd token is left out."""
    n = F.floor(F.size(values) / 2).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(values, 2 * i).cast("int").alias("idx"), F.get(values, 2 * i + 1).alias("val")))
    return F.when(n > 0, made).otherwise(F.slice(made, F.lit(1), F.lit(0)))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """id, t (array of numbers) of each line that holds a token."""
    df = with_split(spark.read.text(path)).select(*SPLIT, tokens("value").alias("t")).filter(F.size("t") > 0)
    return with_position(df, name="id").select("id", "t")


def n_rows(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """n: the number of lines; blank ones count only if asked for."""
    df = spark.read.text(path)
    return (df if blank else df.filter(F.size(tokens("value")) > 0)).agg(F.count("*").alias("n"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """id, label, features: the first token of a line is the class."""
    return lines(spark, path).select("id", F.get("t", F.lit(0)).cast("int").alias("label"), pairs(F.slice("t", F.lit(2), F.size("t"))).alias("features"))


def read_unlabelled(spark: SparkSession, path: str) -> DataFrame:
    """id, features."""
    return lines(spark, path).select("id", pairs(F.col("t")).alias("features"))


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """tid, items."""
    return lines(spark, path).select(F.col("id").alias("tid"), F.transform("t", lambda x: x.cast("bigint")).alias("items"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """id, features, norm_sq of `index:value` lines; blank lines and those that start with # are skipped."""
    df = with_split(spark.read.text(path)).filter(~F.col("value").startswith("#")).select(*SPLIT, tokens("value").alias("t")).filter(F.size("t") > 0)
    rows = with_position(df, name="id").select("id", pairs(F.col("t")).alias("features"))
    return rows.withColumn("norm_sq", F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x["val"] * x["val"]))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """i, j, w: line i (from 0, all lines count) holds `j:w` entries."""
    df = with_position(with_split(spark.read.text(path)), name="i").select("i", pairs(tokens("value")).alias("f"))
    return df.select("i", F.inline("f").alias("j", "w")).select("i", F.col("j").cast("bigint").alias("j"), "w")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """id, vector: a dense row in each line."""
    return lines(spark, path).select("id", F.col("t").alias("vector"))


def read_memberships(spark: SparkSession, path: str) -> DataFrame:
    """id, cluster: a class in each line."""
    return lines(spark, path).select("id", F.get("t", F.lit(0)).cast("int").alias("cluster"))


def max_dimension(rows: DataFrame) -> DataFrame:
    """max_dim, max_width (pairs in the widest row) and n of a table with features."""
    return rows.agg(F.coalesce(F.max(F.array_max(F.transform("features", lambda x: x["idx"]))), F.lit(0)).alias("max_dim"), F.coalesce(F.max(F.size("features")), F.lit(0)).alias("max_width"), F.count("*").alias("n"))


def _six(x: Column) -> Column:
    """6 significant digits as C++ streams write them: fixed for exponents of -4 to 5, else scientific, without trailing zeros."""
    s = F.format_string("%.5e", x)
    exponent = F.regexp_extract(s, r"e([+-][0-9]+)$", 1).cast("int")
    fixed = F.array(*[F.format_string(f"%.{p}f", x) for p in range(10)])  # one for each number of places
    fixed = F.get(fixed, F.least(F.greatest(5 - exponent, F.lit(0)), F.lit(9)))
    fixed = F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    short = F.regexp_replace(F.regexp_replace(s, r"\.?0+e", "e"), r"\.e", "e")
    return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when((exponent < -4) | (exponent >= 6), short).otherwise(fixed)


def edge_lines(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """i, value: `j:w` entries by j, a line for each row; rows without an entry are empty lines where ids (id) are given."""
    entry = F.concat(F.col("j").cast("string"), F.lit(":"), _six(F.col("w")))
    rows = edges.groupBy("i").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("j", entry.alias("s")))), lambda x: x["s"]), " ").alias("value"))
    if ids is None:
        return rows
    return ids.select(F.col("id").alias("i")).join(rows, "i", "left").select("i", F.coalesce("value", F.lit("")).alias("value"))


def write_lines(df: DataFrame, order: str, path: str) -> None:
    """Writes `value` in the order of a column, in as many part files as the sort has; their names keep the order."""
    df.orderBy(order).select("value").write.mode("overwrite").text(path)


def write_edges(edges: DataFrame, path: str, ids: DataFrame | None = None) -> None:
    write_lines(edge_lines(edges, ids), "i", path)


def write_memberships(df: DataFrame, path: str) -> None:
    write_lines(df.select("id", F.col("cluster").cast("string").alias("value")), "id", path)


def write_vectors(df: DataFrame, path: str, column: str = "v") -> None:
    write_lines(df.select("id", F.array_join(F.transform(column, lambda x: x.cast("string")), " ").alias("value")), "id", path)


def write_values(spark: SparkSession, values, path: str) -> None:
    """Eigenvalues, one in each line."""
    rows = spark.createDataFrame([(k, repr(float(v))) for k, v in enumerate(values)], "k int, value string")
    write_lines(rows, "k", path)


def centroid_lines(centroids: DataFrame) -> DataFrame:
    """cluster, value: `dim:value` entries of a centroid table; zeros are not there."""
    entry = F.concat(F.col("dim").cast("string"), F.lit(":"), _six(F.col("val")))
    return centroids.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dim", entry.alias("s")))), lambda x: x["s"]), " ").alias("value"))


def dump(rows: DataFrame, n: int = 20) -> str:
    """The first n rows by id as `label idx:val ...` lines."""
    out = []
    for r in rows.orderBy("id").limit(n).collect():
        said = [str(r["label"])] if "label" in rows.columns else []
        out.append(" ".join([*said, *(f"{p['idx']}:{p['val']:g}" for p in r["features"])]))
    return "\n".join(out)
