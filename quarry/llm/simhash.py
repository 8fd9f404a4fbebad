"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprint: 64 bits; bit i is set if it is in over half of the XXH64 hashes (seed 42) of the text's 3-word shingles,
repeats included. Fingerprints that differ in at most 3 bits are linked; a component is what links reach.

Equal fingerprints are first folded into one (a map-side combined aggregate), so a group of copies, however large, is one
row. The 64 bits are cut into 5 parts; of 3 differing bits at most 3 parts are touched, so two linked fingerprints
agree in 2 parts at least, and they meet in one of 10 tables keyed by a pair of parts. A bucket is indexed by `GrayIndex`: its
fingerprints sorted by Gray rank, so that neighbours share bits; nodes of the tree over them hold the mask of bits
that all below share and their pattern; a search adds up the differences in shared bits and leaves a whole node once they
exceed 3, or takes it once they cannot. A bucket gives a spanning forest of its links, never all pairs. Buckets of more than
BUCKET fingerprints are dealt out once more by quarters of the bits outside their key: 3 differences leave one quarter equal, so this loses no link.

Components come from alternating large-star and small-star steps on links, as joins and aggregates, until all are stars.

Defined cases: a null text counts as empty; a text without words has fingerprint 0, which is linked like any other; fewer
than 3 words are one shingle; a null doc_id comes after all others, so a component of only such has null; rows
that repeat are copies; an empty table gives an empty result; other columns pass through or are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import broadcast_if, cut, read, record, short_batches

BITS, MOST = 64, 3
EDGES = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
BUCKET = 4096


def fingerprint(text: str | None, size: int = 3) -> int:
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not ws:
        return 0
    said = b" ".join(ws)
    if len(ws) <= size:
        return xxhash.xxh64_intdigest(said, 42)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(ws) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, n, 65536):  # so a long text takes no more memory than this many
        h = np.array([digest(said[s:e], 42) for s, e in zip(starts[at : at + 65536], ends[at : at + 65536])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts)).view(np.int64))


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    out = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Fingerprints in Gray order under a tree of shared masked bit patterns."""

    LEAF = 32

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        level = [(i, min(i + self.LEAF, len(fps))) for i in range(0, len(fps), self.LEAF)]
        ands = np.array([np.bitwise_and.reduce(self.fps[a:b]) for a, b in level], np.uint64)
        ors = np.array([np.bitwise_or.reduce(self.fps[a:b]) for a, b in level], np.uint64)
        self.leaves, self.levels = level, []
        while True:  # from the leaves up; an upper node shares what its 8 lower ones do
            self.levels.append((~(ands ^ ors), ands))
            if len(ands) <= 1:
                break
            cuts = np.arange(0, len(ands), 8)
            ands, ors = np.bitwise_and.reduceat(ands, cuts), np.bitwise_or.reduceat(ors, cuts)
        self.gone = [np.zeros(len(m), bool) for m, _ in self.levels]
        self.left = np.ones(len(fps), bool)
        self.n_left = [b - a for a, b in level]

    def take(self, fp: np.uint64) -> np.ndarray:
        """Places in self.fps, of those not yet taken, within MOST bits; they are taken then."""
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[depth]
            nodes = nodes[~self.gone[depth][nodes]]
            nodes = nodes[np.bitwise_count((pattern[nodes] ^ fp) & mask[nodes]) <= MOST]  # differences in bits that all below share
            if not len(nodes):
                return nodes
            if depth:
                below = (nodes[:, None] * 8 + np.arange(8)).ravel()
                nodes = below[below < len(self.levels[depth - 1][0])]
        at = (nodes[:, None] * self.LEAF + np.arange(self.LEAF)).ravel()
        at = at[at < len(self.fps)]
        at = at[self.left[at]]
        at = at[np.bitwise_count(self.fps[at] ^ fp) <= MOST]
        self.left[at] = False
        for leaf in np.unique(at // self.LEAF):
            a, b = self.leaves[leaf]
            node, depth = leaf, 0
            if not self.left[a:b].any():
                self.gone[0][leaf] = True
                while depth + 1 < len(self.levels) and self.gone[depth][node // 8 * 8 : node // 8 * 8 + 8].all():
                    node, depth = node // 8, depth + 1
                    self.gone[depth][node] = True
        return at

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of a spanning forest: each fingerprint is taken once, by the one it was reached from."""
        a, b = [], []
        for i in range(len(self.fps)):
            if not self.left[i]:
                continue
            self.left[i] = False
            reached = [i]
            while reached:
                k = reached.pop()
                got = self.take(self.fps[k])
                a += [self.fps[k]] * len(got)
                b += self.fps[got].tolist()
                reached += got.tolist()
        return np.array(a, np.uint64), np.array(b, np.uint64)


def _part(column: str, low: int, high: int):
    return F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def _forests(rows: DataFrame) -> DataFrame:
    """a, b: links within each bucket (all columns but fp are its key)."""
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = GrayIndex(pdf["fp"].to_numpy(np.int64).view(np.uint64)).forest()
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    key = [c for c in rows.columns if c != "fp"]
    # buckets are few bytes and much work, so they are dealt out by number of tasks, not by size
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    return dealt.groupBy(*key).applyInPandas(links, "a bigint, b bigint")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, b: links (of at most MOST differing bits) with the same components as all links; fps: distinct `fp`."""
    keys = []
    for i in range(len(EDGES)):
        for j in range(i):
            value = F.shiftleft(_part("fp", *EDGES[i]), EDGES[j][1] - EDGES[j][0]).bitwiseOR(_part("fp", *EDGES[j]))
            keys.append(F.struct(F.lit(len(keys)).alias("t"), value.alias("v")))
    dealt = fps.select("fp", F.inline(F.array(*keys)))
    counts = dealt.groupBy("t", "v").agg(F.count("*").alias("n")).filter("n > 1")  # a third of all may share a bucket: combined map-side
    met = cut(dealt.join(counts, ["t", "v"]).select("t", "v", "n", "fp"))
    small = met.filter(F.col("n") <= bucket).select("t", "v", "fp")
    out = _forests(small)
    large = met.filter(F.col("n") > bucket).select("t", "v", "fp")
    if not large.isEmpty():
        pairs = [(i, j) for i in range(len(EDGES)) for j in range(i)]
        quarters = []
        for i, j in pairs:  # the bits outside a table's own parts, in 4 runs
            rest = [x for k, e in enumerate(EDGES) if k not in (i, j) for x in range(*e)]
            cuts = [rest[len(rest) * q // 4 : len(rest) * (q + 1) // 4] for q in range(4)]
            quarters.append(F.array(*[F.struct(F.lit(q).alias("q"), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << x for x in c)))).alias("w")) for q, c in enumerate(cuts)]))
        again = large.select("t", "v", "fp", F.inline(F.get(F.array(*quarters), F.col("t"))))
        out = out.unionByName(_forests(again))
    return out.distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _to_least(pairs: DataFrame, moving: str = "true") -> DataFrame:
    """a, b: a, and those beside it in pairs that are `moving`, move to the smallest of a and all beside it.

    Pairs are distinct, of different nodes. The pair with the smallest stands for a itself, so no pair makes more than one row.
    """
    least = pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    moved = pairs.join(least, "a").filter(f"{moving} or b = m")
    return moved.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _pairs(edges: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    return edges.select(F.inline(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """v, root: the smallest node that links reach, for every node that has a link."""
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        # settled: each node is below one other at most, and none is both above and below, so all roots are least
        below, above = F.struct(F.col("a").alias("v"), F.lit(1).alias("d"), F.lit(0).alias("u")), F.struct(F.col("b").alias("v"), F.lit(0).alias("d"), F.lit(1).alias("u"))
        roles = edges.select(F.inline(F.array(below, above))).groupBy("v").agg(F.sum("d").alias("d"), F.max("u").alias("u"))
        if roles.filter("d > 1 or d > 0 and u > 0").isEmpty():
            break
        # large star: a node and its larger neighbours move to the smallest of it and its neighbours; small star: the smaller ones do
        up = _to_least(_pairs(edges, ("a", "b"), ("b", "a")), "b > a")
        edges = cut(_to_least(up))
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b"))).distinct()


def fingerprints(docs: DataFrame) -> DataFrame:
    """id, tk (hash of the text), fp of each row, written once as computing them is the costly part."""
    return cut(short_batches(docs).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tk"), fingerprint_of(F.col("text")).alias("fp")))


#: Rows of one fingerprint that one task gets.
SPREAD = 1024


def grouped(prints: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """fp, n (rows), component (no_id, id, tk of its first row) for each different fingerprint; a null id comes last.

    roots (v, root): components by other links than those of SimHash.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tk"))
    least = cut(prints.groupBy("fp").agg(first.alias("least"), F.count("*").alias("n")))
    roots = cut(components(links(least.select("fp")))) if roots is None else roots
    of_root = roots.join(least, roots["v"] == least["fp"]).groupBy("root").agg(F.min("least").alias("component"))
    known = roots.join(of_root, "root").select(F.col("v").alias("fp"), "component")
    return least.join(known, "fp", "left").select("fp", "n", F.coalesce("component", "least").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of each row. The component of a fingerprint of many rows is copied, so that no task gets all of them."""
    prints = fingerprints(docs)
    known = cut(grouped(prints).select("fp", F.col("component.id").alias("component_id"), F.ceil(F.col("n") / SPREAD).cast("int").alias("parts")))
    many = known.filter("parts > 1").select("fp", "parts")
    rows = prints.join(broadcast_if(many, 1_000_000), "fp", "left").withColumn("part", F.pmod(F.xxhash64("id", "tk", F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1))).cast("int"))
    copied = known.select("fp", "component_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return rows.drop("parts").join(copied, ["fp", "part"]).select(F.col("id").alias("doc_id"), "fp", "component_id")


def keep_first(docs: DataFrame, prints: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """The columns of docs, with one row of each component: the one with the smallest doc_id, then the smallest hash of the text."""
    key = [F.col("id").alias("k1"), F.col("tk").alias("k3")]
    kept = grouped(prints, roots).select("component.*").select(*key).distinct()
    rows = docs.select(record(docs), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tk")).select("rec", *key)
    kept = kept.select(F.col("k1").alias("c1"), F.col("k3").alias("c3"))
    # rows that share both are repeats of one document; the group by uses the join's partitioning
    one = rows.join(kept, F.col("k1").eqNullSafe(F.col("c1")) & (F.col("k3") == F.col("c3")), "left_semi").groupBy("k1", "k3").agg(F.first("rec").alias("rec"))
    return one.select("rec.*")


def keep_one(docs: DataFrame) -> DataFrame:
    """keep_first by the fingerprints of op6."""
    return keep_first(docs, fingerprints(docs))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
