"""Benchmark decontamination by windows of test words.

Words are runs of letters a-z, digits and non-ASCII characters, A-Z lower-cased. A window is `width` consecutive
words of an item, or all words of a shorter one. Every window of at least 2b - 1 words that occurs in a document
holds a whole block of b words that starts at a multiple of b there (b is the largest such number for the shortest
window). So documents are cut into these blocks, each with the words around it that a window could reach; a
broadcast hash set of the items' b-grams leaves the few blocks that any window could hold; the windows around these
are held against the items' windows, text against text, and only what occurs is joined with the ids of its items. Windows
of less than half the length of the longest are looked for in a scan of their own, so that a short item does not shorten
the blocks of all. Sets are broadcast up to BOUND rows and BYTES of text; beyond, joins shuffle.

Defined cases: a null or empty text has no words and no hits; items without words have no window; an item_id that is
null marks words but is not listed; a very long text is scanned as a whole, block by block; items or documents that repeat count once, and each row of the same doc_id and
text gets the same result; an empty benchmark hits nothing; other columns are not read, or pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import ascii_lower, broadcast_if, cut, pieces, read, record, with_text

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for a text whose A-Z have not been lower-cased.
NOT_WORD_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BOUND, BYTES = 1_000_000, 64 << 20


def words(text) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def _grams(ws, n) -> Column:
    """All runs of n words, joined by blanks."""
    return F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))


def item_windows(benchmark: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """gram, len, item (the id as a string): a row for each different window of an item."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    n = F.least(F.lit(width), F.size("ws"))
    return items.select("item", n.alias("len"), F.explode(_grams(F.col("ws"), n)).alias("gram")).distinct()


def length_classes(lens: list[int]) -> list[list[int]]:
    """The lengths in classes, each from half its longest on."""
    out: list[list[int]] = []
    for n in sorted(lens, reverse=True):
        if out and 2 * n >= out[-1][0]:
            out[-1].append(n)
        else:
            out.append([n])
    return out


def _scan(docs: DataFrame, grams: DataFrame, lens: list[int], small: bool, id_col: str, text_col: str) -> DataFrame:
    """id, tk, start, len, gram of the windows of these lengths that occur."""
    grams, most, b = grams.filter(F.col("len").isin(lens)), max(lens), (min(lens) + 1) // 2
    reach = -(-(most - b) // b)  # blocks to either side that a window around a block can touch
    block = lambda g: F.xxhash64(F.lower(g))  # noqa: E731  lower() changes more than A-Z, so equal words still have equal hashes
    blocks = grams.select(F.explode(_grams(F.split("gram", " "), F.lit(b))).alias("g")).select(block(F.col("g")).alias("bh")).distinct()

    cutup = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tk"), F.split(text_col, NOT_WORD_RAW).alias("ws"))
    numbers = F.sequence(F.lit(0), F.ceil(F.size("ws") / b).cast("int") - 1)
    cutup = cutup.select("id", "tk", (F.get("ws", F.lit(0)) == "").cast("int").alias("blank"), F.transform(numbers, lambda k: F.array_join(F.slice("ws", k * b + 1, F.lit(b)), " ")).alias("bs"))

    def row(g: Column, k: Column) -> Column:
        first = F.greatest(k - reach, F.lit(0))
        return F.struct((k * b).alias("s"), (first * b).alias("low"), block(g).alias("bh"), F.array_join(F.slice("bs", first + 1, k + reach + 1 - first), " ").alias("near"))

    cutup = cutup.select("id", "tk", "blank", F.inline(F.transform("bs", row)))
    cutup = cutup.join(broadcast_if(cut(blocks), BOUND), "bh", "left_semi").withColumn("near", F.split(ascii_lower(F.col("near")), " "))

    def around(length: int) -> Column:
        first = F.greatest(F.col("low"), F.col("s") - (length - b))
        last = F.least(F.col("s"), F.col("low") + F.size("near") - length)
        window = lambda i: F.struct((i - F.col("blank")).alias("start"), F.lit(length).alias("len"), F.array_join(F.slice("near", i - F.col("low") + 1, F.lit(length)), " ").alias("gram"))
        return F.when(last >= first, F.transform(F.sequence(first, last), window)).otherwise(F.array().cast("array<struct<start:int,len:int,gram:string>>"))

    tried = cutup.select("id", "tk", F.inline(F.concat(*[around(x) for x in sorted(lens)])))
    return tried.join(F.broadcast(grams) if small else grams, ["gram", "len"], "left_semi").select("id", "tk", "start", "len", "gram")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", with_items: bool = True) -> DataFrame | None:
    """id, tk, places (start and len of windows that occur, word numbers from 0), items (without with_items: none); None for a benchmark without words."""
    owned = cut(item_windows(benchmark, width))
    grams = cut(owned.select("gram", "len").distinct())
    sizes = {r["len"]: r for r in grams.groupBy("len").agg(F.count("*").alias("n"), F.sum(F.octet_length("gram")).alias("bytes")).collect()}  # `width` rows at most
    if not sizes:
        return None
    found = None
    for lens in length_classes(list(sizes)):
        small = sum(sizes[x]["n"] for x in lens) <= BOUND and sum(sizes[x]["bytes"] for x in lens) <= BYTES
        own = _scan(docs, grams, lens, small, id_col, text_col)
        found = own if found is None else found.union(own)
    if with_items:
        found = found.join(owned, ["gram", "len"])
    items = F.collect_set("item") if with_items else F.array().cast("array<string>")
    return found.groupBy("id", "tk").agg(F.collect_set(F.struct("start", "len")).alias("places"), items.alias("items"))


def mark(docs: DataFrame, benchmark: DataFrame, width: int = 10, with_items: bool = True) -> DataFrame:
    """rec (the columns of docs), id, text, n_words, hit (sorted numbers of hit words), items (sorted ids, if with_items)."""
    rows = docs.select(record(docs), F.col("doc_id").alias("id"), F.col("text").alias("text"), F.xxhash64("text").alias("tk"))
    found = hits(docs, benchmark, width, with_items=with_items)
    none = F.array().cast("array<int>"), F.array().cast("array<string>")
    rows = rows.withColumn("n_words", pieces(F.col("text"), NOT_WORD_RAW))
    if found is None:
        return rows.select("rec", "id", "text", "n_words", none[0].alias("hit"), none[1].alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["len"] - 1))))
    found = found.select(F.col("id").alias("hid"), F.col("tk").alias("htk"), F.sort_array(covered).alias("hit"), F.sort_array("items").alias("items"))
    out = rows.join(found, rows["id"].eqNullSafe(F.col("hid")) & (rows["tk"] == F.col("htk")), "left")
    return out.select("rec", "id", "text", "n_words", F.coalesce("hit", none[0]).alias("hit"), F.coalesce("items", none[1]).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, remove: str = "documents") -> DataFrame:
    """The columns of docs, without the documents that hold a window, or ("spans") with the hit words cut out of the texts."""
    marked = mark(docs, benchmark, width, with_items=False)
    if remove == "documents":
        return with_text(marked.filter(F.size("hit") == 0), docs.columns, F.col("text"))
    gaps = F.split("text", NOT_WORD_RAW.replace("[", "[^", 1), -1)  # between words; each run of them is one match
    raw = F.array_remove(F.split("text", NOT_WORD_RAW), "")
    kept = F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), F.col("hit"))
    parts = marked.select("rec", "text", "hit", F.when(F.size("hit") > 0, gaps).alias("gaps"), F.when(F.size("hit") > 0, raw).alias("raw"), F.when(F.size("hit") > 0, kept).alias("kept"))
    # kept stands here twice, so Spark leaves the splits in a step of their own and does not repeat them for each word
    joined = F.concat(F.array_join(F.transform("kept", lambda i: F.concat(F.get("gaps", i), F.get("raw", i))), ""), F.element_at("gaps", -1))
    return with_text(parts, docs.columns, F.when(F.col("kept").isNull(), F.col("text")).otherwise(joined))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    marked = mark(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit").cast("bigint")
    return marked.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_WS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_WS} AS ws FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WS} AS ws FROM benchmark),
g AS (SELECT item, least(10, len(ws)) AS n, unnest(list_transform(range(0, len(ws) - least(10, len(ws)) + 1), lambda i: array_to_string(ws[i + 1 : i + least(10, len(ws))], ' '))) AS gram FROM b WHERE len(ws) > 0),
n AS (SELECT DISTINCT n FROM g),
w AS (SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS gram FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM d, n)),
h AS (SELECT w.doc_id, w.i, w.n, g.item FROM w JOIN g ON w.gram = g.gram AND w.n = g.n),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
