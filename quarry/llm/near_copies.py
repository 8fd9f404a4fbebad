"""Near copies by SimHash candidates and exact verification; the pipeline's near-duplicate stage.

Two texts are linked if the sets of their 5-word shingles have a Jaccard similarity of 0.8 at least; a component is what links
reach. Words and short texts are as in `simhash`: bytes in lower case, and fewer than 5 words are one shingle.

Texts with equal sets are first folded into one. A set's fingerprint is a SimHash of WORDS words of 64 bits: a bit is set if it
is in over half of its shingles' hashes. At 0.8 a bit differs with a probability of 0.1613 at most (0.1875 for sets of 4 and 5),
so 64 bits do not tell such pairs from others (10 differ on average and up to 23, as in 2 % of all unrelated pairs), but many do:

- The first word is a fingerprint as in `simhash`: its Gray-order index links what differs in 3 bits at most.
- For links of more bits there are tables, each keyed by a few bits of the words after the first CHECK. A bucket has some thousand
  sets, whatever the table's size; in it those that differ in at most MOST of the 256 bits of the first CHECK words meet in a group
  (what such differences reach). `tables` takes as many as needed for a pair at 0.8 to share no bucket with a probability of
  1e-6 (less above 0.8). It differs in more than MOST bits with one of 6e-10 (6e-7 for sets of 4 and 5). Unrelated sets are
  closer than that with one of 1e-9.

Groups of the same members are one group, and so are groups with members in common, up to WHOLE sets. All similarities are computed from the whole sets, so no link is wrong:

1. Each member is held against the smallest member of its group, its hub. This settles groups of copies, however large, as
   pairs that are dealt out evenly; a group whose members are all in one component then is done.
2. In the other groups, the members outside the hub's component are held against all. Blocks of at most BLOCK shingles of
   either side make one piece of work, so none grows with its group; it gives a spanning forest of the components it joins.

Defined cases: a null text counts as empty, and texts without words are copies of each other; a very long text is compared by its whole set;
ids, repeats, empty tables and columns as in `simhash`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import broadcast_if, cut, short_batches
from quarry.llm.simhash import components, keep_first, links

SIZE, LEAST = 5, 0.8
#: Words of a fingerprint; of these, the ones that are compared within a bucket, and the most bits that may differ there.
WORDS, CHECK, MOST = 20, 4, 80
#: The most that a bit differs at LEAST, and sets of 4 and 5 shingles, where it differs more.
DIFFERS, DIFFERS_SMALL, SMALL = 0.1613, 0.1875, 5
MISSED = 1e-6
#: Sets of a bucket, on average at most; in buckets up to DENSE all pairs are compared.
BUCKET, DENSE = 4096, 16384
#: Sets of a group that takes the place of those it consists of.
WHOLE = 4096
#: Shingles of one side of a piece of work: 16 MB.
BLOCK = 1 << 21
#: What a member outside the hub's component counts for besides its shingles, as each is held against a whole block: 8192 at most in a piece.
EACH = 256
#: Pairs with the same hub that one task gets.
SPREAD = 2048
_RANDOM = np.random.default_rng(42).integers(0, 1 << 64, (3, WORDS), np.uint64, endpoint=False)
FACTORS, SHIFTS, AGAIN = _RANDOM[0] | np.uint64(1), _RANDOM[1], _RANDOM[2] | np.uint64(1)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The hashes of a text's different shingles, in order."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not ws:
        return np.zeros(0, np.uint64)
    said, digest = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= size:
        return np.array([digest(said, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(ws) - size + 1].tolist()
    return np.unique(np.fromiter((digest(said[s:e], 42) for s, e in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts)))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS words whose bits are set where they are in over half of a set's hashes."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte can count
        h = hashes[at : at + 255, None] * FACTORS + SHIFTS
        h ^= h >> np.uint64(31)
        h *= AGAIN
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


CODE = [f"c{k}" for k in range(CHECK)]
_PRINT = [("fp", T.LongType()), ("n", T.LongType()), *[(c, T.LongType()) for c in CODE], ("rest", T.BinaryType())]


@F.pandas_udf(T.StructType([T.StructField(*f) for f in _PRINT]))
def _print_of(texts: pd.Series) -> pd.DataFrame:
    sets = [shingles(t) for t in texts]
    fps = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets), np.uint64, len(sets))
    words = np.array([fingerprint(s) for s in sets], np.uint64).reshape(-1, WORDS)
    codes = {c: words[:, k].view(np.int64) for k, c in enumerate(CODE)}
    return pd.DataFrame({"fp": fps.view(np.int64), "n": [len(s) for s in sets], **codes, "rest": [w[CHECK:].tobytes() for w in words]})


def tables(width: int, differs: float = DIFFERS) -> int:
    """How many tables of keys of so many bits miss a pair with a probability of MISSED, where a bit of it differs with one of `differs`."""
    if not width:
        return 1
    bits = 64 * (WORDS - CHECK)
    n = math.ceil(math.log(MISSED) / math.log1p(-((1 - differs) ** width)))
    if n * width <= bits:  # no bit is in two tables
        return n
    # tables share bits: by how many of all the bits differ
    chance = [math.comb(bits, d) * differs**d * (1 - differs) ** (bits - d) for d in range(bits + 1)]
    apart = np.array([1 - math.comb(bits - d, width) / math.comb(bits, width) for d in range(bits + 1)])
    while (np.array(chance) * apart**n).sum() > MISSED:
        n += 1 + n // 50
    return n


def key_bits(width: int, n: int) -> np.ndarray:
    """The places of the bits that make the keys of n tables; every bit is taken once before one is taken again."""
    rng, bits, out = np.random.default_rng(42), 64 * (WORDS - CHECK), []
    while len(out) < n:
        out += rng.permutation(bits)[: bits // max(width, 1) * width].reshape(-1, width).tolist() if width else [[]]
    return np.array(out[:n], np.int64).reshape(n, width)


def _keys(width: int):
    """A table's number and a set's key in it as one number, for all tables; sets of at most SMALL shingles have more tables."""
    few, many = tables(width), tables(width, DIFFERS_SMALL)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(rest: pd.Series, n: pd.Series) -> pd.Series:
        bits = np.unpackbits(np.frombuffer(b"".join(rest), np.uint8).reshape(len(rest), -1), axis=1, bitorder="little")
        places = key_bits(width, many)
        out = np.broadcast_to(np.arange(many, dtype=np.int64), (len(rest), many))
        for k in range(width):
            out = out * 2 + bits[:, places[:, k]]
        return pd.Series([row if small else row[:few] for row, small in zip(out, n <= SMALL)])

    return keys


def _close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    differ = sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]) for k in range(CHECK - 1))
    return np.add(differ, np.bitwise_count(a[:, None, -1] ^ b[None, :, -1]), dtype=np.uint16) <= most


def groups(codes: np.ndarray, most: int = MOST) -> np.ndarray:
    """A label for each row of codes: which rows are reached from it by differences of at most `most` bits."""
    n = len(codes)
    labels, left = np.arange(n), np.arange(n)
    if n <= DENSE:  # those that are close to no other go first
        met, step = np.zeros(n, bool), max(1, (1 << 15) // max(n, 1))
        for at in range(0, n, step):
            close = _close(codes[at : at + step], codes[at:], most)
            np.fill_diagonal(close, False)
            if close.any():
                met[at : at + step] |= close.any(axis=1)
                met[at:] |= close.any(axis=0)
        left = np.flatnonzero(met)
    while len(left):  # many may be close: each is compared with what is left, as those reached are taken out
        label, reached, left = left[0], left[:1], left[1:]
        while len(reached) and len(left):
            got = np.zeros(len(left), bool)
            step = max(1, (1 << 15) // len(left))
            for at in range(0, len(reached), step):
                got |= _close(codes[reached[at : at + step]], codes[left], most).any(axis=0)
            reached, left = left[got], left[~got]
            labels[reached] = label
    return labels


def _grouped(pdf: pd.DataFrame) -> pd.DataFrame:
    labels = groups(pdf[CODE].to_numpy(np.int64).view(np.uint64))
    _, of, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    kept = sizes[of] > 1
    fps = pdf["fp"].to_numpy(np.int64)
    return pd.DataFrame({"v": pdf["v"].to_numpy()[kept], "g": fps[labels[kept]], "fp": fps[kept]})


@F.pandas_udf(T.BinaryType())
def _set_of(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).tobytes() for t in texts])


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], dtype=bool)


def joins(some: list[np.ndarray], all_: list[np.ndarray], some_of: np.ndarray, all_of: np.ndarray, least: float = LEAST) -> list[tuple[int, int]]:
    """Links (a place in some, a place in all_) of a similarity of `least`, a spanning forest of what they join: rows
    with the same label in some_of and all_of are joined before."""
    sizes = np.array([len(s) for s in all_])
    order = np.argsort(sizes, kind="stable")
    sizes, labels = sizes[order], np.asarray(all_of)[order].copy()
    vocabulary, tokens = np.unique(np.concatenate([all_[i] for i in order]), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    mark, out = np.zeros(len(vocabulary), np.int64), []
    now = dict(zip(some_of, some_of))  # label of those in some, as it moves
    for k, own in enumerate(some):
        label = now[some_of[k]]
        # sets of other sizes than this cannot be similar enough; a margin leaves rounding to the exact test
        low, high = np.searchsorted(sizes, (len(own) * least - 1, len(own) / least + 1))
        other = labels[low:high] != label
        if not other.any():
            continue
        at = np.searchsorted(vocabulary, own)
        known = at < len(vocabulary)
        at, own_known = at[known], own[known]
        at = at[vocabulary[at] == own_known]
        mark[at] = 1
        shared = np.add.reduceat(mark[tokens[starts[low] : starts[high]]], starts[low:high] - starts[low])
        mark[at] = 0
        found = np.flatnonzero(other & (shared >= least * (sizes[low:high] + len(own) - shared) - 1e-9))
        for g in found:
            joined = labels[low + g]
            if joined != label:
                out.append((k, int(order[low + g])))
                labels[labels == joined] = label
                now = {x: label if y == joined else y for x, y in now.items()}
    return out


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    rest, rows = pdf[pdf["rest"]], pdf[~pdf["rest"]]
    if not len(rest) or not len(rows):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    sets = [[np.frombuffer(s, np.uint64) for s in side["shingles"]] for side in (rest, rows)]
    roots = rest["root"].to_numpy(), rows["root"].to_numpy()
    pairs = np.array(joins(*sets, *roots), np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": roots[0][pairs[:, 0]], "b": roots[1][pairs[:, 1]]})


def _hub_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: which members are alike to a hub of theirs. A hub of many members is copied, so that no task gets all of them."""
    pairs = members.filter("fp <> hub").select("fp", "hub").distinct()
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("parts"))
    hubs = sets.withColumnsRenamed({"fp": "hub", "shingles": "other"}).join(parts, "hub").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    most = parts.filter("parts > 1")
    own = pairs.join(broadcast_if(most, 1_000_000), "hub", "left").withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    both = own.join(sets, "fp").join(hubs.drop("parts"), ["hub", "part"])
    return both.filter(_alike("shingles", "other")).select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def _rest_links(members: DataFrame, sets: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """a, b: which components (by their roots; a set without links is one) have links in the buckets that hold more than one. roots: v, root."""
    rooted = members.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_hub = roots.select(F.col("v").alias("hub"), F.col("root").alias("hub_root"))
    rooted = cut(rooted.join(of_hub, "hub", "left").withColumn("rest", F.col("root") != F.coalesce("hub_root", "hub")))
    size = lambda only: F.greatest(F.lit(1), F.ceil(F.sum(only) / block)).cast("int")
    open_ = rooted.groupBy("v").agg(F.max("rest").alias("open"), size("n").alias("n_blocks"), size(F.when(F.col("rest"), F.col("n") + EACH).otherwise(0)).alias("n_chunks")).filter("open")
    # written first, so that the join has no aggregate above its shuffle and a large bucket can be split
    rows = rooted.join(broadcast_if(cut(open_), 1_000_000), "v").select("v", "fp", "root", "rest", "n_blocks", "n_chunks")
    block_of, chunk_of = F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int"), F.pmod(F.xxhash64("fp"), F.col("n_chunks")).cast("int")
    as_row = rows.select("v", "fp", "root", F.lit(False).alias("rest"), block_of.alias("block"), F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"))
    as_rest = rows.filter("rest").select("v", "fp", "root", F.lit(True).alias("rest"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), chunk_of.alias("chunk"))
    met = as_row.union(as_rest).join(sets, "fp")
    # pieces are few bytes and much work, so they are dealt out by number of tasks, not by size
    key = ["v", "block", "chunk"]
    met = met.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    return met.groupBy(*key).applyInPandas(_joined, "a bigint, b bigint").distinct()


def _gray_groups(own: DataFrame) -> DataFrame:
    """v, fp: sets of the same first word, and the first ones of two words that the Gray-order index links."""
    word = cut(own.groupBy("c0").agg(F.min("fp").alias("fp")))
    pairs = links(word.select(F.col("c0").alias("fp"))).select(F.xxhash64("a", "b").alias("v"), F.explode(F.array("a", "b")).alias("c0"))
    return own.select(F.xxhash64("c0").alias("v"), "fp").union(pairs.join(broadcast_if(word, 1_000_000), "c0").select("v", "fp"))


def _table_groups(own: DataFrame) -> DataFrame:
    """v, fp: sets of a bucket that reach each other."""
    n = own.count()
    width = max(0, math.ceil(math.log2(max(n, 1) / BUCKET)))
    dealt = own.select(F.explode(_keys(width)("rest", "n")).alias("v"), "fp", *CODE)
    # buckets are few bytes and much work, so they are dealt out by number of tasks, not by size
    dealt = dealt.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v")
    return dealt.groupBy("v").applyInPandas(_grouped, "v bigint, g bigint, fp bigint").select(F.xxhash64("v", "g").alias("v"), "fp")


def _merged(members: DataFrame) -> DataFrame:
    """v, fp, hub: one group instead of all those that sets in common join, where it has WHOLE sets at most; else the groups as they are."""
    whole = cut(components(members.select(F.col("fp").alias("a"), F.col("hub").alias("b"))))
    few = broadcast_if(cut(whole.groupBy("root").agg((F.count("*") <= WHOLE).alias("few"))), 1_000_000)
    of = cut(whole.withColumnRenamed("v", "fp").join(few, "root"))
    apart = members.join(of.filter("not few").select("fp"), "fp", "left_semi").select("v", "fp", "hub")
    return of.filter("few").select(F.col("root").alias("v"), "fp", F.col("root").alias("hub")).union(apart)


def linked(docs: DataFrame, prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """v, root: the smallest set (fp) that links reach, for every set that has a link."""
    own = cut(prints.filter("n > 0").groupBy("fp").agg(F.min("tk").alias("tk"), *[F.first(c).alias(c) for c in ("n", *CODE, "rest")]))
    dealt, member = cut(_gray_groups(own).union(_table_groups(own))), F.xxhash64("fp")
    met = dealt.groupBy("v").agg(F.count("*").alias("c"), F.bit_xor(member).alias("x"), F.min("fp").alias("hub"), F.max("fp").alias("l")).filter("c > 1")
    chosen = cut(met.groupBy("c", "x", "hub", "l").agg(F.min("v").alias("v")).select("v", "hub"))
    sizes = broadcast_if(own.select("fp", "n"), 1_000_000)
    members = cut(_merged(cut(dealt.join(broadcast_if(chosen, 1_000_000), "v"))).join(sizes, "fp").select("v", "fp", "n", "hub"))
    # the text of one row of each member; its hash finds it
    wanted = cut(own.join(members.select("fp").distinct(), "fp", "left_semi").select("fp", "tk"))
    texts = short_batches(docs).select(F.xxhash64("text").alias("tk"), "text").join(broadcast_if(wanted, 1_000_000), "tk")
    sets = cut(texts.groupBy("fp").agg(F.first("text").alias("text")).select("fp", _set_of("text").alias("shingles")))
    roots = cut(components(_hub_links(members, sets)))
    rest = cut(_rest_links(members, sets, roots, block))
    if rest.isEmpty():
        return roots
    upper = cut(components(rest)).withColumnsRenamed({"v": "low", "root": "top"})
    moved = roots.join(upper, F.col("root") == F.col("low"), "left").select("v", F.coalesce("top", "root").alias("root"))
    return moved.union(upper.join(roots, F.col("low") == F.col("v"), "left_anti").select("low", "top"))


def prints(docs: DataFrame) -> DataFrame:
    """id, tk (hash of the text), fp (hash of the set), n (its size) and the fingerprint of each row, written once as computing them is the costly part."""
    rows = short_batches(docs).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tk"), _print_of(F.col("text")).alias("p"))
    return cut(rows.select("id", "tk", "p.*"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of docs, with one row of each component: the one with the smallest doc_id, then the smallest hash of the text."""
    found = prints(docs)
    return keep_first(docs, found, linked(docs, found))
