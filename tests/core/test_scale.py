"""What the plans and the counts of scale features are held to."""

import random

from pyspark.sql import functions as F

from relscope.operators import keys, profile, relationships, search
from relscope.operators.loops import scratch
from relscope.sources import readers


def explained(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_profile_scans_each_table_once(spark, tmp_path):
    spark.range(50).selectExpr("id", "cast(id % 7 as string) as s", "id / 3.0D as f").write.parquet(str(tmp_path / "t"))
    assert explained(profile.profile({"t": spark.read.parquet(str(tmp_path / "t"))})).count("FileScan") == 1


def test_merged_sketches_are_those_of_the_whole(spark):
    df = spark.range(40_000).selectExpr("id", "id % 1000 as few", "concat('v', id % 7777) as text", "if(id % 3 = 0, null, id / 7.0D) as f", "id < 0 as flag")
    parts = [profile.sketches({"t": df.where(f"id % 3 = {i}")}) for i in range(3)] + [profile.sketches({"t": df.limit(0)})]
    got = {r.column: r for r in profile.from_sketches(profile.merge_sketches(*parts)).collect()}
    exact = {r.column: r for r in profile.profile({"t": df}).collect()}
    for name, r in exact.items():
        assert abs(got[name].unique_count - r.unique_count) <= 0.08 * r.unique_count, name
        assert got[name].asDict() | {"unique_count": 0, "avg_len": 0} == r.asDict() | {"unique_count": 0, "avg_len": 0}
        assert got[name].avg_len == r.avg_len or abs(got[name].avg_len - r.avg_len) < 1e-9


def overlap_tables(spark):
    """Columns with known shares of their values in others, larger than what is drawn of them."""
    ids = spark.range(6000)
    return {
        "base": ids.selectExpr("id as k", "concat('v', id) as name"),
        "most": ids.selectExpr("id + 1000 as x", "if(id % 4 = 0, concat('w', id), concat('v', id)) as y", "id % 3 as z"),
        "half": spark.range(4000).selectExpr("if(id % 2 = 0, id, id + 100000) as x", "cast(id as string) as y", "if(id % 100 < 49, id, id + 100000) as z").unionAll(spark.range(10).selectExpr("0L", "'0'", "0L")),
        "none": spark.range(5000).selectExpr("id + 20000 as x", "concat('q', id) as y"),
    }


def test_no_overlap_is_lost_to_pruning(spark, monkeypatch):
    tables = overlap_tables(spark)
    keyed = profile.settled(keys.detect_keys(profile.profile(tables)))
    got = {(r.s_table, r.s_column, r.t_table, r.t_column): (r.common, r.source_size) for r in relationships.value_overlaps(tables, keyed, "true", "true", 0.5).collect()}
    cells = {(t, c): {str(r[0]) for r in df.select(c).distinct().collect()} for t, df in tables.items() for c in df.columns}
    want = {(*a, *b): (len(x & y), len(x)) for a, x in cells.items() for b, y in cells.items() if a[0] != b[0] and len(x & y) >= 0.5 * len(x)}
    assert got == want and ("half", "x", "base", "k") in got and ("half", "z", "base", "k") not in got
    facts = [r.asDict() | {"s": True, "t": True} for r in keyed.orderBy("table", "column").collect()]
    left = relationships.plausible_pairs(tables, facts, 0.5)
    named = {tuple(facts[i][k] for i in p for k in ("table", "column")) for p in left}
    all_pairs = sum(a["table"] != b["table"] for a in facts for b in facts)
    print("pairs", all_pairs, "left", len(named), "true", len(want))
    assert named >= set(want) and len(named) <= len(want) + 2 < all_pairs / 3
    monkeypatch.setattr(relationships, "SENT", 0)
    assert relationships.plausible_pairs(tables, facts, 0.5) == left


def test_bucketed_tables_join_without_a_shuffle(spark):
    rng = random.Random(2)
    rows = [(rng.choice([7, rng.randrange(500)]), i) for i in range(3000)]
    left = readers.sink_bucketed(spark.createDataFrame(rows, "k long, v long"), scratch(spark, "left"), ["k"], 4)
    right = readers.sink_bucketed(spark.range(500).toDF("k"), scratch(spark, "right"), ["k"], 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = left.join(right, "k")
        assert "Exchange" not in explained(met) and met.count() == 3000
        assert "Exchange" not in explained(left.groupBy("k").count())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_index_is_read_and_not_shuffled(spark):
    tables = {"a": spark.range(300).selectExpr("id as x", "id % 5 as other"), "b": spark.range(200).selectExpr("cast(id as string) as y")}
    rels = spark.createDataFrame([(0, "a", "x", "b", "y")], "rank int, source_table string, source_column string, target_table string, target_column string")
    index = search.value_index(tables, rels, scratch(spark, "index"), 8)
    seeds = spark.createDataFrame([(1, "a", "x", "17"), (2, "a", "x", "250"), (3, "b", "y", None)], "seed_id long, table string, column string, value string")
    plain, indexed = search.trace(tables, rels, seeds), search.trace({}, rels, seeds, index=index)
    for got, want in zip(indexed, plain):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    few = search.looked_up(index, seeds)
    assert "Exchange" not in explained(few) and few.count() == len(few.collect()) == 3
    # the scan gives rows of the values' buckets alone, an eighth of 500 each
    scan = few._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() <= 250
    many = seeds.crossJoin(spark.range(200)).withColumn("value", F.col("id").cast("string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = explained(search.looked_up(index, many))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    side = plan[: plan.index("FileScan")]
    assert "Bucketed: true" in plan and "Exchange" not in side.split("SortMergeJoin")[1]
    assert search.looked_up(index, many).count() == 400


def test_a_search_reads_the_files_that_may_have_hits(spark):
    rows = spark.range(800).selectExpr("id", "concat('Name#', lpad(id, 6, '0')) as name", "if(id % 100 = 3, 'Äpfel und Birnen', null) as note", "id % 7 as short")
    stored = {"t": scratch(spark, "stored")}
    rows.repartitionByRange(8, "id").write.parquet(stored["t"])
    index = search.gram_index(spark, stored, scratch(spark, "grams"))
    for query, mode, most in [
        ("#000123", "contains", 1), ("name#0007", "starts_with", 2), ("Name#000799", "exact", 1), ("name#.*77", "regex", 8), ("000123$", "regex", 1), ("ÄPFEL", "contains", 8), ("nowhere", "contains", 0),
        ("12", "contains", None), ("n(a|o)me#0001", "regex", None), ("[0-9]+1", "regex", None), ("", "contains", None), ("000x?123", "regex", 8), ("a*b", "regex", None),
    ]:
        files = search.files_with(index, "t", query, mode)
        print(query, mode, files and len(files))
        assert (files is None) == (most is None) and (files is None or len(files) <= most)
        got = search.search_stored(spark, stored, {"t": ["id"]}, index, query, mode).collect()
        assert got == search.search({"t": (rows, ["id"])}, query, mode).collect(), query
