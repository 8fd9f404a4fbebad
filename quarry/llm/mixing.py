"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is as long as the input. Each source has a target: its share of all words by weight, at most `most` times
its own words; what is above goes to the others by weight. The mix is then cut into equal blocks of `block`
words. Blocks go to sources by the highest quotients target / (2k + 1), and in each source to its shards (documents
dealt out by a seeded hash, at most `max_shards` or the root of their number, if that is more) by words / (2k + 1): whole quotas for each shard. In a
shard, the documents stand in seeded order as one line of words; a quota of more than the line is taken as whole
passes, and the rest as consecutive blocks of it from a seeded block on, going round at the end.

Each source's taken words so differ from its target by about a block. No document is taken more than `most` times.

Defined cases: null and empty texts have size 0 and are never taken; a null source is a source, the last by code
point; a column of documents that has the name of one of the results is replaced by it; rows that repeat are documents of their own; all sizes 0: all targets 0; an empty table: an empty result.
One row per source is ranked in one task; what grows with the documents is not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import SPACE, broadcast_if, cut, pieces, read, record

WEIGHTS = (5, 2, 1)


def seeded(seed: int, *cols) -> Column:
    """A number of 0 to 2^32 - 1 from the MD5 of the seed and the values."""
    said = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("bigint")


def sainte_lague(votes: DataFrame, group: list[str], key: list[str], vote: str, seats: str) -> DataFrame:
    """group, key, quota, vote: `seats` (one number for each group) given out by the highest quotients, ties by key.

    Only the quotients near the cut are ranked: what shares are rounded to moves by less than c below, so each
    key's first `low` quotients are in and those above `high` are out. That is about 10 rows for each key.
    """
    g = W.partitionBy(*group)
    with_all = votes.withColumns({"q_sum": F.sum(vote).over(g).cast("double"), "q_n": F.count(F.lit(1)).over(g)})
    share = F.when(F.col("q_sum") > 0, F.col(vote).cast("double") / F.when(F.col("q_sum") > 0, F.col("q_sum"))).otherwise(0.0)
    near = with_all.withColumn("q_share", share).withColumn("q_c", 2 + 2 * F.col("q_n") * F.col("q_share"))
    near = near.withColumn("q_low", F.greatest(F.lit(0), F.floor(F.col(seats) * F.col("q_share") - F.col("q_c"))).cast("bigint"))
    near = near.withColumn("q_high", F.ceil(F.col(seats) * F.col("q_share") + F.col("q_c")).cast("bigint"))
    left = F.col(seats) - F.sum("q_low").over(g)
    near = near.withColumn("q_left", left)
    quotients = near.withColumn("q_k", F.explode(F.sequence("q_low", "q_high")))
    quotients = quotients.withColumn("q_rank", F.row_number().over(g.orderBy((F.col(vote).cast("double") / (2 * F.col("q_k") + 1)).desc(), *key)))
    quota = F.max("q_low") + F.sum(F.when((F.col("q_rank") <= F.col("q_left")) & (F.col(vote) > 0), 1).otherwise(0))
    return quotients.groupBy(*group, *key).agg(quota.cast("bigint").alias("quota"), F.max(vote).alias(vote))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """source, src (number by code point from 0), n_docs, source_size, total, target; one row for each source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    every = W.partitionBy()
    out = sources.withColumn("src", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    out = out.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("src", F.lit(len(weights)))))
    by_limit = W.orderBy(most * F.col("source_size") / F.col("weight"), "src")
    out = out.withColumns({
        "total": F.sum("source_size").over(every),
        "capped": F.coalesce(F.sum(most * F.col("source_size")).over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "open": F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing)),
    })
    # with the first k sources at their limits, the level is (total - capped) / open; it rises up to the right k and falls after
    out = out.withColumn("level", F.max((F.col("total") - F.col("capped")) / F.col("open")).over(every))
    target = F.least((most * F.col("source_size")).cast("double"), F.col("level") * F.col("weight"))
    return out.select("source", "src", "n_docs", "source_size", "total", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = 3, block: int = 32, shard_docs: int = 256, max_shards: int = 4096, seed: int = 17, carry: bool = False) -> DataFrame:
    """For each row: doc_id, size, source_size, target, taken; with carry also rec, all columns of docs."""
    raw = docs.select(record(docs), F.col("doc_id").alias("id"), F.col("source").alias("source"), pieces(F.col("text"), SPACE).alias("size"))
    sizes = cut(raw.select("id", "source", "size"))
    rows = raw if carry else sizes.withColumn("rec", F.lit(None))
    plan = cut(targets(sizes, weights, most))
    blocks = F.round(F.col("total") / block).cast("bigint")
    given = sainte_lague(plan.withColumns({"all": F.lit(0), "seats": blocks}), ["all"], ["src"], "target", "seats").select("src", "quota")
    shards = F.least(F.greatest(F.lit(max_shards), F.ceil(F.sqrt("n_docs"))), F.ceil(F.col("n_docs") / shard_docs)).cast("bigint")
    sources = broadcast_if(cut(plan.join(given, "src").withColumn("n_shards", shards)).withColumnRenamed("source", "source2"), 100_000)

    def placed(rows: DataFrame) -> DataFrame:
        out = rows.join(sources, F.col("source").eqNullSafe(F.col("source2")))
        return out.withColumn("shard", F.pmod(seeded(seed, "id"), F.col("n_shards")))

    lines = placed(sizes).groupBy("src", "shard").agg(F.sum("size").alias("line"), F.max("quota").alias("seats"))
    quotas = sainte_lague(lines, ["src"], ["shard"], "line", "seats")
    own = placed(rows).select("rec", "id", "size", "source_size", "target", "src", "shard")
    order = W.partitionBy("src", "shard").orderBy(seeded(seed + 1, "id"), "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = own.withColumn("upto", F.sum("size").over(order)).join(quotas, ["src", "shard"])  # a running sum: no shard's texts are held
    length = F.greatest(F.col("line"), F.lit(1))
    out = out.withColumn("words", F.least(F.col("quota") * block, most * F.col("line")))
    out = out.withColumns({"passes": F.floor(F.col("words") / length), "rest": F.pmod("words", length), "start": F.pmod(seeded(seed + 2, "src", "shard"), F.ceil(length / F.lit(block))) * block})
    a, b, end = F.col("upto") - F.col("size"), F.col("upto"), F.col("start") + F.col("rest")
    inside = F.greatest(F.lit(0), F.least(b, end, F.col("line")) - F.greatest(a, F.col("start"))) + F.greatest(F.lit(0), F.least(b, end - F.col("line")) - a)
    return out.select(*["rec"] * carry, F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("passes") * F.col("size") + inside).cast("bigint").alias("taken"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The columns of docs of the rows that the mix takes words of, then size, source_size, target, taken."""
    extra = ["size", "source_size", "target", "taken"]
    out = mix(docs, carry=True, **how).filter("taken > 0")
    return out.select(*[F.col(f"rec.`{c}`").alias(c) for c in docs.columns if c not in extra], *extra)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src, sum(source_size) OVER ()::BIGINT AS total FROM s),
w AS (SELECT *, CASE src % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM o),
c AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
      sum(weight) OVER (ORDER BY 3 * source_size / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open FROM w),
t AS (SELECT *, least((3 * source_size)::DOUBLE, max((total - capped)::DOUBLE / open) OVER () * weight) AS target, round(total / 32.0)::BIGINT AS seats FROM c),
q AS (SELECT src, target / (2 * k + 1) AS quotient FROM t, unnest(range(0, CAST(2 + 2 * seats * target / greatest(total, 1) AS BIGINT))) AS u(k)),
r AS (SELECT src, row_number() OVER (ORDER BY quotient DESC, src) AS place FROM q WHERE quotient > 0),
g AS (SELECT t.src, (SELECT count(*) FROM r WHERE r.src = t.src AND place <= t.seats) AS quota FROM t),
p AS (SELECT d.*, t.src, t.source_size, t.target, g.quota AS source_quota, n_md5(concat('17:', d.doc_id)) % least(greatest(4096, ceil(sqrt(t.n_docs))::BIGINT), ceil(t.n_docs / 256.0)::BIGINT) AS shard
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN g USING (src)),
l AS (SELECT src, shard, sum(size)::BIGINT AS line, any_value(source_quota) AS seats FROM p GROUP BY src, shard),
lq AS (SELECT src, shard, seats, line::DOUBLE / (2 * k + 1) AS quotient FROM l, unnest(range(0, CAST(2 + 2 * seats AS BIGINT))) AS u(k)),
lr AS (SELECT src, shard, seats, row_number() OVER (PARTITION BY src ORDER BY quotient DESC, shard) AS place FROM lq WHERE quotient > 0),
lg AS (SELECT src, shard, count(*) FILTER (WHERE place <= seats) AS quota FROM lr GROUP BY src, shard),
x AS (SELECT p.*, l.line, coalesce(lg.quota, 0) AS quota, (sum(size) OVER (PARTITION BY src, shard ORDER BY n_md5(concat('18:', doc_id)), doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS b
      FROM p JOIN l USING (src, shard) LEFT JOIN lg USING (src, shard)),
y AS (SELECT *, b - size AS a, least(quota * 32, 3 * line) AS words, greatest(line, 1) AS len, (n_md5(concat('19:', src, ':', shard)) % ceil(greatest(line, 1) / 32.0)::BIGINT) * 32 AS start FROM x),
z AS (SELECT *, words // len AS passes, start + words % len AS stop FROM y)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(b, stop, line) - greatest(a, start)) + greatest(0, least(b, stop - line) - a) AS BIGINT) AS taken FROM z
"""
# the oracle's number from an MD5, spelled out where it is used
SQL = re.sub(r"n_md5\((concat\((?:[^()]|\([^()]*\))*\))\)", r"(('0x' || substr(md5(\1), 1, 8))::BIGINT)", SQL)
