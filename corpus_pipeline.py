"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the columns of documents, and of the last stage also
size, source_size, target and taken. Stages are independent; run() applies them in order.
"""

from __future__ import annotations

from quarry.llm import decontam, line_dedup, mixing, near_copies, quality
from quarry.llm.shared import cut, read


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier, trained on the labelled ones of these, takes for good."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def line_stage(spark, docs, sf_dir):
    """All documents, without later places of repeated windows of three lines."""
    return line_dedup.dedup_lines(docs)


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each group of near duplicates: five-word shingles with a Jaccard similarity of 0.8 or more."""
    return near_copies.keep_one(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents without a window of the benchmark."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark, docs, sf_dir):
    """Documents that the mix takes words of, and how many."""
    return mixing.mix_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
]

#: SQL cannot express the classifier and the fingerprints; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)  # later stages read their input more than once
    return docs
