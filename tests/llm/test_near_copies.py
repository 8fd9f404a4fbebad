"""The pipeline's near-duplicate stage: against brute force over all pairs, on cases that 3 bits of a fingerprint miss."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import near_copies, simhash

from .test_native import docs


def brute_sets(text, size=5):
    ws = (text or "").encode().lower().split()
    return {b" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def brute_kept(rows):
    sets = [brute_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] | sets[j])
        if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * both:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[find(i)][0] for i in range(len(rows))}


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def near_rows(seed=3):
    rng, rows = random.Random(seed), []
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 300))]
        for n in (0, 1, 2, len(words) // 60, len(words) // 40, len(words) // 20):
            rows.append((len(rows), " ".join(edited(rng, words, n))))
    return rows


def test_near_copies_beyond_three_bits(spark):
    rows = near_rows()
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs(spark, rows), None).collect())
    assert got == sorted(brute_kept(rows))


@pytest.mark.parametrize("block", [300])
def test_near_copies_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(near_copies, "SPREAD", 3)
    rows = near_rows(7)
    df = docs(spark, rows)
    found = near_copies.prints(df)
    roots = near_copies.linked(df, found, block)
    assert {r["doc_id"] for r in simhash.keep_first(df, found, roots).collect()} == brute_kept(rows)


def test_joins_against_all_pairs():
    rng = random.Random(5)
    sets = [np.unique(np.array([rng.randrange(12) for _ in range(rng.randrange(1, 14))], np.uint64)) for _ in range(60)]
    got = near_copies.joins(sets, sets, np.arange(60), np.arange(60))
    root = list(range(60))
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in got:
        assert near_copies.alike(sets[a], sets[b]) and find(a) != find(b)
        root[find(a)] = find(b)
    for i, j in itertools.combinations(range(60), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        assert near_copies.alike(sets[i], sets[j]) == (10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both))
        assert not near_copies.alike(sets[i], sets[j]) or find(i) == find(j)
    for a, b in near_copies.joins(sets[:25], sets[20:50], np.arange(25), np.arange(20, 50)):
        assert near_copies.alike(sets[a], sets[20 + b])


def test_near_copies_on_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in df.collect())
    got = near_copies.keep_one(df)
    assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} == brute_kept(rows)


def test_near_copies_edges(spark):
    t = "some words that make a text of a fair length " * 5
    rows = [(5, t), (3, t), (3, t), (9, t.upper()), (7, None), (8, ""), (None, "alone in here"), (None, "another one that is alone"), (2, "x " * 50_000), (11, "twice the id"), (11, "same id and different text")]
    kept = near_copies.keep_one(docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(3, t), (7, None), (None, "alone in here"), (None, "another one that is alone"), (2, "x " * 50_000), (11, "twice the id"), (11, "same id and different text")], key=str)
    assert near_copies.keep_one(docs(spark, [])).count() == 0
