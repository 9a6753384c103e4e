"""The corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, removal of personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of documents. run() applies them to the documents table, writing each result to the shared folder and reading
it again, so a lost executor costs a stage and not the run.
"""

from __future__ import annotations

import public_tokenizers

from relscope.llm import exact_dedup, near_text, packing, pii, quality
from relscope.llm.common import scratch, table


def quality_stage(spark, docs, sf_dir):
    """Drops the documents that the classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark, docs, sf_dir):
    """Of texts equal but for the case of A-Z, the row with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near_stage(spark, docs, sf_dir):
    """Of each group of near copies the row with the smallest doc_id stays."""
    return near_text.keep_one(docs)


def pii_stage(spark, docs, sf_dir):
    """Personal data in texts is replaced by its kind in brackets; n_chars follows the text."""
    return pii.redact(docs)


def packing_stage(spark, docs, sf_dir):
    """One row a piece of at most 4096 tokens with its place in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("PII", pii_stage),
    ("best-fit packing", packing_stage),
]

#: None: the classifier, the field and the packing are no SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
