"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.plan import broadcast_if, cut  # noqa: F401  the operators take these from here

SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def short_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """df, whose session sends Python at most so many rows at once from now on: texts can be long, and memory is bounded so."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def record(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that names of the operator's own cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("rec")


def with_text(df: DataFrame, columns: list[str], text: Column, text_col: str = "text") -> DataFrame:
    """Unpacks `rec`, with another text and, where there is such a column, n_chars to match."""
    def pick(c: str) -> Column:
        if c == text_col:
            return text.alias(c)
        if c == "n_chars":
            return F.length(text).cast("bigint").alias(c)
        return F.col(f"rec.`{c}`").alias(c)

    return df.select(*[pick(c) for c in columns])


def running_sum(lengths: Column, chunk: int = 256) -> Column:
    """Inclusive running sums of an array of longs. Works by chunks, as appending to an array copies it."""
    zero = F.lit(0).cast("bigint")

    def sums(array: Column, start: Column) -> Column:
        out = F.aggregate(array, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(out, F.lit(2), F.greatest(F.size(array), F.lit(1)))

    n = F.ceil(F.size(lengths) / F.lit(chunk)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.slice(lengths, c * chunk + 1, F.lit(chunk)))
    totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: a + x))
    starts = F.concat(F.array(zero), sums(totals, zero))
    parts = F.zip_with(chunks, starts, lambda c, s: F.when(c.isNull(), F.array().cast("array<bigint>")).otherwise(sums(c, s)))
    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(parts))


def pieces(text: Column, separator: str) -> Column:
    """How many non-empty pieces a text has between matches of the separator, as long; null: 0."""
    parts = F.split(text, separator, -1)
    n = F.size(parts) - (F.get(parts, F.lit(0)) == "").cast("int") - (F.element_at(parts, -1) == "").cast("int")
    return F.coalesce(F.greatest(n, F.lit(0)), F.lit(0)).cast("bigint")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else; lower() is the quick way where no other letters are."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))
