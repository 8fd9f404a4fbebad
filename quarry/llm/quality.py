"""Quality classifier on supervised subword embeddings.

Features of a text are its words (what white space separates, as they are), their character 2- and 3-grams, and its word 2-grams,
each hashed to one of BUCKETS learned vectors; a document is their average, and a softmax over two classes gives the score. Vectors and
output are trained by numpy stochastic gradient descent on a sample of at most `sample` labelled documents: those of the smallest
hashes of doc_id. Only labels whose crc32(doc_id as text) mod 3 is not 1 are ever read.

As the output is linear in the average, each bucket comes down to one number; scoring sums these over a text's
features. The model is BUCKETS doubles, whatever the size of the corpus.

Defined cases: a null or empty text has no features and gets the score of the output's bias alone; a very long text is read whole; a null doc_id counts as not held out and is never trained
on; labels that repeat count once, by their largest quality; null qualities are left out; without labels
every score is 0.5; rows that repeat get the same score each; other columns pass through or are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import read, record, short_batches

BUCKETS, DIMS, CACHE = 1 << 15, 12, 400_000
#: Factors that make one hash of the hashes of two words.
LEFT, RIGHT = np.uint64(2654435761), np.uint64(2246822519)


def gram_features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words, each between < and >, one after another: the bucket of the 2-gram and of the 3-gram at each code point, -1 where the word
    ends before; and how many code points each word has."""
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 2
    points = np.frombuffer("".join([f"<{t}>" for t in tokens]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points = np.concatenate((points, np.zeros(2, np.uint64)))
    two = points[:-2] * LEFT + points[1:-1] * RIGHT
    three = (two ^ two >> np.uint64(29)) * LEFT + points[2:] * RIGHT
    ends = np.cumsum(lengths)
    two, three = bucket_of(two), bucket_of(three)
    two[ends - 1] = three[ends - 1] = three[ends - 2] = -1
    return two, three, lengths


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * LEFT >> np.uint64(24)) % np.uint64(BUCKETS)).astype(np.int64)


def word_hash(token: str) -> int:
    return zlib.crc32(b"w" + token.encode("utf-8", "surrogatepass"))


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each two words that follow each other, of their hashes (uint64)."""
    return bucket_of(hashes[:-1] * LEFT + hashes[1:] * RIGHT)


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of a text and how often each occurs."""
    tokens = (text or "").split()
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    counts: dict[str, int] = {}
    for t in tokens:
        counts[t] = counts.get(t, 0) + 1
    times = np.fromiter(counts.values(), np.int64, len(counts))
    hashes = {t: word_hash(t) for t in counts}
    two, three, lengths = gram_features(list(counts))
    each = np.repeat(times, lengths)
    own = np.fromiter(hashes.values(), np.int64, len(hashes)) % BUCKETS
    pairs = pair_features(np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens)))
    total = np.zeros(BUCKETS, np.int64)
    for ids, n in ((own, times), (two, each), (three, each), (pairs, np.ones(len(pairs), np.int64))):
        total += np.bincount(ids[ids >= 0], n[ids >= 0], BUCKETS).astype(np.int64)
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), total[ids].astype(np.int32)


class Words(dict):
    """Words to places in arrays of the sum and number of their features and of their hashes."""

    def __init__(self, numbers: np.ndarray, most: int = CACHE):
        super().__init__()
        self.numbers, self.most = np.append(numbers, 0.0), most  # bucket -1 counts nothing
        self.sums, self.sizes, self.hashes = np.zeros(1024), np.zeros(1024, np.int64), np.zeros(1024, np.uint64)

    def learn(self, tokens: list[str]) -> None:
        """Gives places to words that have none."""
        first, last = len(self), len(self) + len(tokens)
        while last > len(self.sums):
            self.sums, self.sizes, self.hashes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.sizes, self.hashes))
        two, three, lengths = gram_features(tokens)
        hashes = np.fromiter(map(word_hash, tokens), np.uint64, len(tokens))
        starts = np.cumsum(lengths) - lengths
        self.sums[first:last] = np.add.reduceat(self.numbers[two] + self.numbers[three], starts) + self.numbers[(hashes % np.uint64(BUCKETS)).astype(np.int64)]
        self.sizes[first:last] = 2 * lengths - 2
        self.hashes[first:last] = hashes
        self.update(zip(tokens, range(first, last)))

    def mean(self, text: str | None) -> float:
        """The mean number of a text's features; 0 without any."""
        tokens, total, n, before = (text or "").split(), 0.0, 0, None
        for at in range(0, len(tokens), 4096):  # so that one text adds few words at once
            if len(self) > self.most:
                self.clear()
            part = tokens[at : at + 4096]
            if new := [t for t in dict.fromkeys(part) if t not in self]:
                self.learn(new)
            places = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            hashes = self.hashes[places] if before is None else np.concatenate((before, self.hashes[places]))
            before = hashes[-1:]
            total += float(self.sums[places].sum() + self.numbers[pair_features(hashes)].sum())
            n += int(self.sizes[places].sum()) + len(hashes) - 1
        return total / n if n else 0.0


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, rate: float = 0.2, seed: int = 7) -> tuple[np.ndarray, float]:
    """A number for each bucket and the bias: the logit of class 1 is the bias plus the mean of a text's numbers."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS))
    out, bias = rng.normal(0, 0.1, (2, DIMS)), np.zeros(2)
    n_of = np.bincount([y for *_, y in rows], minlength=2) if rows else np.zeros(2, int)
    if not n_of.all():
        return np.zeros(BUCKETS), 0.0 if not rows else float(np.sign(n_of[1] - n_of[0]))
    weight = np.sqrt(len(rows) / (2 * n_of))  # the rarer class counts for more
    scale = 10.0  # averages of many features are short
    step = 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, counts, y = rows[k]
            now = rate * (1 - step / (epochs * len(rows)))
            step += 1
            part = counts / max(1, counts.sum())
            mean = scale * (part @ vectors[ids]) if len(ids) else np.zeros(DIMS)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= now * weight[y]
            if len(ids):
                vectors[ids] -= scale * part[:, None] * (p @ out)
            out -= np.outer(p, mean)
            bias -= p
    return scale * (vectors @ (out[1] - out[0])), float(bias[1] - bias[0])


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> tuple[np.ndarray, float]:
    chosen = labels.filter(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "id")
    texts = short_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "quality", "text")

    def shorten(batches):  # a text comes down to at most BUCKETS counts
        for pdf in batches:
            found = [text_features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype(str), "quality": pdf["quality"], "ids": [a.tobytes() for a, _ in found], "counts": [b.tobytes() for _, b in found]})

    # rows of documents that repeat could be more than were chosen
    rows = texts.mapInPandas(shorten, "doc_id string, quality int, ids binary, counts binary").orderBy("doc_id", "ids", "counts").limit(sample).collect()
    return train([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.int32), r["quality"]) for r in rows])


def scorer(model: tuple[np.ndarray, float]):
    """A pandas UDF of the text: the probability of class 1."""
    numbers, bias = model
    raw = numbers.tobytes()

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Words(np.frombuffer(raw))  # known words serve all batches of a task
        for texts in batches:
            out = bias + np.fromiter(map(known.mean, texts), np.float64, len(texts))
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -700, 700))))

    return score


def scored(docs: DataFrame, model) -> DataFrame:
    """rec (the columns of docs) and score."""
    return short_batches(docs).select(record(docs), scorer(model)(F.col("text")).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The columns of docs of the rows whose score is at least so much."""
    return scored(docs, fit(docs, labels)).filter(F.col("score") >= least).select("rec.*")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    score = scorer(fit(docs, labels))(F.col("text"))
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
