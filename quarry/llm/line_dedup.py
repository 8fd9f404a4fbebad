"""Line dedup by repeated windows of three lines.

Lines are what newlines separate. A window is `width` consecutive non-blank lines of a document (blank: only
spaces, tabs, returns); its key is 128 bits of hash. Of the places of a window the first by (doc_id, line) stays,
the lines of the others go, with blank lines between them; overlapping places merge into one covered range.

Defined cases: a null text stays null; an empty text, or one of fewer lines than a window, stays as it is; a text
whose every line is covered becomes empty; a null doc_id sorts first; documents that share a doc_id follow each
other by a hash of their texts, and rows that repeat both get the same result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import read, record, with_text

BLANK = " \t\r"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(record(docs), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tk"))


def windows(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each window: h1, h2 (its key), id, tk, first, last (line numbers from 0)."""
    numbered = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    lines = F.filter(numbered, lambda x: F.length(F.btrim(x["line"], F.lit(BLANK))) > 0)

    def window(k):
        own = [F.get("lines", k + j) for j in range(width)]
        said = [x["line"] for x in own]
        return F.struct(F.xxhash64(*said).alias("h1"), F.xxhash64(F.lit(width), *said).alias("h2"), own[0]["i"].alias("first"), own[-1]["i"].alias("last"))

    found = F.when(F.size("lines") >= width, F.transform(F.sequence(F.lit(0), F.size("lines") - width), window))
    return _keyed(docs, id_col, text_col).select("id", "tk", lines.alias("lines")).select("id", "tk", F.inline(found)).select("h1", "h2", "id", "tk", "first", "last")


def _covered(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Every row with rec, text, lines and keep, the numbers of the lines that stay."""
    places = windows(docs, width, id_col, text_col)
    repeated = places.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "tk", "first")).alias("origin")).filter("n > 1").select("h1", "h2", "origin")
    later = places.join(repeated, ["h1", "h2"]).filter(~F.struct("id", "tk", "first").eqNullSafe(F.col("origin")))
    covers = later.groupBy(F.col("id").alias("cid"), F.col("tk").alias("ctk")).agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    all_lines = F.split("text", "\n", -1)
    numbers = F.sequence(F.lit(0), F.size(all_lines) - 1)
    gone = F.flatten(F.transform("ranges", lambda r: F.sequence(r["first"], r["last"])))
    keyed = _keyed(docs, id_col, text_col)
    return keyed.join(covers, keyed["id"].eqNullSafe(F.col("cid")) & (keyed["tk"] == F.col("ctk")), "left").select(
        "rec", "id", "text", all_lines.alias("lines"), F.when(F.col("ranges").isNotNull(), F.array_except(numbers, gone)).alias("keep")
    )


def _kept_text():
    joined = F.array_join(F.transform("keep", lambda i: F.get("lines", i)), "\n")
    return F.when(F.col("keep").isNull(), F.col("text")).otherwise(joined)


def dedup_lines(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, with later places of repeated windows taken out of the text."""
    return with_text(_covered(docs, width, id_col, text_col), docs.columns, _kept_text(), text_col)


def line_report(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_lines, n_removed, text (what stays)."""
    n = F.coalesce(F.size("lines"), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n).cast("bigint")
    return _covered(docs, width, id_col, text_col).select(
        F.col("id").alias("doc_id"), n.alias("n_lines"), F.when(F.col("keep").isNull(), F.lit(0).cast("bigint")).otherwise(n - F.size("keep")).alias("n_removed"), _kept_text().alias("text")
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_report(read(spark, sf_dir, "documents"))


SQL = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
b AS (SELECT doc_id, i AS first, line, lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3, lead(i, 2) OVER w AS last
      FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, first, last, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, first) AS k FROM b WHERE last IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM r WHERE k > 1),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, k.text FROM documents d LEFT JOIN k USING (doc_id)
"""
