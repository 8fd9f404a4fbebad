"""The pipeline's near-duplicate stage takes its candidates from SimHash: fingerprints, Gray-order index, tables for more bits."""

import random

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from quarry.llm import near_copies

from .test_native import docs
from .test_near_copies import brute_kept, near_rows


def differ(a, b):
    return int(np.bitwise_count(a ^ b).sum())


def pair_at(rng, n, common):
    """Two sets of n and n or more hashes that share `common`, at a similarity of 0.8."""
    extra = common * 10 // 8 - n  # of the other set alone
    h = rng.integers(0, 1 << 64, n + extra, np.uint64, endpoint=False)
    return h[:n], np.concatenate((h[:common], h[n:]))


@pytest.mark.parametrize("n", [1, 2, 7, 255, 256, 700])
def test_fingerprint_is_the_majority_of_bits(n):
    h = np.random.default_rng(n).integers(0, 1 << 64, n, np.uint64, endpoint=False)
    ones, mask = [0] * (64 * near_copies.WORDS), (1 << 64) - 1
    for x in h.tolist():
        for w in range(near_copies.WORDS):
            y = (x * int(near_copies.FACTORS[w]) + int(near_copies.SHIFTS[w])) & mask
            y = ((y ^ y >> 31) * int(near_copies.AGAIN[w])) & mask
            y ^= y >> 32
            for k in range(64):
                ones[64 * w + k] += y >> k & 1
    got = near_copies.fingerprint(h)
    assert [int(got[i // 64]) >> i % 64 & 1 for i in range(len(ones))] == [2 * c > n for c in ones]


@pytest.mark.parametrize("n,common,most", [(4, 4, near_copies.DIFFERS_SMALL), (12, 12, near_copies.DIFFERS), (90, 80, near_copies.DIFFERS), (720, 640, near_copies.DIFFERS)])
def test_bits_of_pairs_at_the_limit(n, common, most):
    rng, apart = np.random.default_rng(7), []
    keys = near_copies._keys(6).func
    for _ in range(200):
        a, b = pair_at(rng, n, common)
        assert near_copies.alike(np.unique(a), np.unique(b))
        fa, fb = near_copies.fingerprint(a), near_copies.fingerprint(b)
        apart.append(differ(fa, fb))
        assert differ(fa[: near_copies.CHECK], fb[: near_copies.CHECK]) <= near_copies.MOST
        ka, kb = keys(pd.Series([f[near_copies.CHECK :].tobytes() for f in (fa, fb)]), pd.Series([len(a), len(b)]))
        assert set(ka.tolist()) & set(kb.tolist())
    assert np.mean(apart) / (64 * near_copies.WORDS) < most + 0.003
    # no two words of a fingerprint say the same
    words = np.array([near_copies.fingerprint(pair_at(rng, n, common)[0]) for _ in range(100)])
    bits = np.unpackbits(words.view(np.uint8), axis=1).astype(float)
    c = np.corrcoef(bits[:, bits.std(axis=0) > 0].T)
    assert np.abs(c - np.eye(len(c))).max() < 0.65


def test_enough_tables():
    assert near_copies.tables(0) == 1
    for width in range(1, 15):
        for q in (near_copies.DIFFERS, near_copies.DIFFERS_SMALL):
            n = near_copies.tables(width, q)
            assert (1 - (1 - q) ** width) ** n <= near_copies.MISSED
            bits = near_copies.key_bits(width, n)
            assert bits.shape == (n, width) and all(len(set(row)) == width for row in bits.tolist())


@pytest.mark.parametrize("dense", [1000, 5])
def test_groups_against_all_pairs(dense, monkeypatch):
    monkeypatch.setattr(near_copies, "DENSE", dense)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, (12, near_copies.CHECK), np.uint64, endpoint=False)
    codes = np.repeat(base, 6, axis=0)
    for row in codes:
        for at in rng.integers(0, 256, 9):
            row[at // 64] ^= np.uint64(1) << np.uint64(at % 64)
    codes = np.concatenate((codes, ~codes[:1]))[rng.permutation(73)]
    for most in (0, 10, 14, 18, 256):
        root = list(range(73))
        find = lambda i: i if root[i] == i else find(root[i])
        for i in range(73):
            for j in range(i):
                if differ(codes[i], codes[j]) <= most:
                    root[find(i)] = find(j)
        got, brute = near_copies.groups(codes, most), [find(i) for i in range(73)]
        assert len(set(zip(got.tolist(), brute))) == len(set(got.tolist())) == len(set(brute))


def test_gray_groups_are_what_three_bits_link(spark):
    rows = near_rows(11)
    own = near_copies.prints(docs(spark, rows)).dropDuplicates(["fp"])
    words = {r["fp"]: np.array([r["c0"]], np.int64).view(np.uint64) for r in own.collect()}
    by = {}
    for r in near_copies._gray_groups(own).collect():
        by.setdefault(r["v"], []).append(r["fp"])
    linked = [x for x in by.values() if len(x) > 1]
    assert linked and all(differ(words[x[0]], words[fp]) <= 3 for x in linked for fp in x)
    root = {fp: fp for fp in words}
    find = lambda i: i if root[i] == i else find(root[i])
    for x in linked:
        root[find(x[0])] = find(x[1])
    for a in words:
        for b in words:
            assert differ(words[a], words[b]) > 3 or find(a) == find(b)


@pytest.mark.parametrize("bucket,whole", [(4, 4), (40, 4096)])
def test_stage_with_tables_of_keys(spark, bucket, whole, monkeypatch):
    asked, known = [], near_copies.links
    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    monkeypatch.setattr(near_copies, "WHOLE", whole)
    monkeypatch.setattr(near_copies, "links", lambda fps: asked.append(fps.columns) or known(fps))
    rows = near_rows(5)
    rng = random.Random(9)
    for _ in range(60):  # 8 words, then one more: sets of 4 and 5
        ws = [f"s{rng.randrange(10**6)}" for _ in range(9)]
        rows += [(len(rows), " ".join(ws[:8])), (len(rows) + 1, " ".join(ws))]
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs(spark, rows), None).collect())
    assert got == sorted(brute_kept(rows)) and asked
