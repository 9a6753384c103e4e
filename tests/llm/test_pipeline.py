from pyspark.sql import functions as F

import corpus_pipeline
from relscope.llm import pii
from relscope.llm.common import table

from .test_near_text import brute
from .test_packing import check_layout

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, SF)
    rows = good.collect()
    assert good.columns == columns
    bad = {r.doc_id for r in table(spark, SF, "labels").where("quality = 0").collect()}
    clean = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}
    kept = {r.doc_id for r in rows}
    assert len(clean & kept) >= 0.98 * len(clean) and len(bad & kept) <= 0.05 * len(bad)

    good = spark.createDataFrame(rows, docs.schema)
    once = stages["exact dedup"](spark, good, SF)
    table_ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    best = {}
    for r in rows:
        key = r.text.translate(table_)
        best[key] = max(best.get(key, -1), r.doc_id)
    rows = once.collect()
    assert once.columns == columns and {r.doc_id for r in rows} == set(best.values()) and len(rows) == len(best)

    once = spark.createDataFrame(rows, docs.schema)
    near = stages["n-gram Jaccard join"](spark, once, SF)
    want = brute([(r.doc_id, r.text) for r in rows])
    rows = near.collect()
    assert near.columns == columns and {r.doc_id for r in rows} == {d for d, (c, _) in want.items() if d == c}

    near = spark.createDataFrame(rows, docs.schema)
    masked = stages["PII"](spark, near, SF)
    field = pii.trained()
    after = {r.doc_id: r for r in masked.collect()}
    assert masked.columns == columns and set(after) == {r.doc_id for r in rows}
    for r in rows:
        assert pii.base_spans(after[r.doc_id].text) == []
        assert (after[r.doc_id].text == r.text) == (pii.find([r.text], field) == [[]])
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)

    packed = stages["best-fit packing"](spark, masked, SF).collect()
    check_layout(packed, 4096)
    assert {r.doc_id for r in packed} == set(after)


def test_columns_with_clashing_names(spark):
    """Columns that operators use for themselves pass through every stage but the last untouched."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    for name in ("node", "size", "t", "hit", "kept", "measure", "set_hash", "class_id", "row", "bucket", "spans"):
        docs = docs.withColumn(name, F.concat(F.lit(name), "doc_id"))
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == names
        rows = docs.select("doc_id", "node", "row").collect()
        assert rows and all(r["node"] == f"node{r.doc_id}" and r["row"] == f"row{r.doc_id}" for r in rows)
    check_layout(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect(), 4096)


def test_run_and_empty_table(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    check_layout(rows, 4096)
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
