"""Components of groups that meet in many tables: right, and with no more rows from a join than links and nodes."""

import random

from quarry.llm import simhash


def in_tables(members, tables, buckets, seed):
    """(member, hub) of each table: members are dealt into buckets, whose smallest is the hub."""
    rng, out = random.Random(seed), set()
    for _ in range(tables):
        dealt = [(rng.randrange(buckets), m) for m in members]
        hubs = {b: min(m for k, m in dealt if k == b) for b, _ in dealt}
        out |= {(m, hubs[b]) for b, m in dealt if m != hubs[b]}
    return out


def test_rows_of_a_round(spark, monkeypatch):
    groups = [[7 * m + k for m in range(100)] for k in range(3)]
    links = sorted(set().union(*[in_tables(g, 20, 16, k) for k, g in enumerate(groups)]))
    chain = [(10_001 + k, 10_000 + k) for k in range(40)]
    edges = spark.createDataFrame([*links, *chain], "a bigint, b bigint")
    made, known = [], type(edges).distinct
    monkeypatch.setattr(type(edges), "distinct", lambda df: made.append(df.count()) or known(df))
    got = simhash.components(edges)
    monkeypatch.undo()
    want = {m: min(g) for g in groups for m in g} | {10_000 + k: 10_000 for k in range(41)}
    assert sorted((r["v"], r["root"]) for r in got.collect()) == sorted(want.items())
    assert len(links) > 10 * 300 and max(made) <= len(links) + len(chain) + len(want)
