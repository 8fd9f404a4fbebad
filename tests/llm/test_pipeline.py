"""The pipeline: each stage against the operator's brute force on the stage's own input."""

import corpus_pipeline
from quarry.llm import decontam, quality, simhash

from .test_native import brute_hits, brute_lines
from .test_near_copies import brute_kept


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before, out = docs.columns, docs.collect(), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out[name] = (before, docs.collect())
        before = out[name][1]
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    good, lines, near, clean, mixed = (out[n] for n, _ in corpus_pipeline.STAGES)

    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r["rec"]["doc_id"]: r["score"] for r in quality.scored(d, quality.fit(d, lab)).collect()}
    assert {r["doc_id"] for r in good[1]} == {i for i, s in scores.items() if s >= 0.5}
    labels = {r["doc_id"]: r["quality"] for r in lab.collect()}
    kept = {r["doc_id"] for r in good[1]}
    assert sum(i in kept for i, q in labels.items() if q == 1) > 0.9 * sum(labels.values())

    assert {r["doc_id"]: r["text"] for r in lines[1]} == brute_lines([(r["doc_id"], r["text"]) for r in lines[0]])
    assert all(r["n_chars"] == len(r["text"]) for r in lines[1])

    assert {r["doc_id"] for r in near[1]} == brute_kept(sorted((r["doc_id"], r["text"]) for r in near[0]))

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in clean[1]} == {r["doc_id"] for r in clean[0] if not brute_hits(r["text"], items)[1]}

    assert {r["doc_id"] for r in mixed[1]} <= {r["doc_id"] for r in mixed[0]} and all(0 < r["taken"] <= 3 * r["size"] for r in mixed[1])


def test_run_is_the_stages(spark, sf):
    a = sorted((r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, sf).collect())
    b = sorted((r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert a == b and a


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_imports():
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5 and simhash and decontam
