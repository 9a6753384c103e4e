from relscope.llm.exact_dedup import exact_dedup, keep_one

SCHEMA = "doc_id long, text string, keep_id string, `group size` int"


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in pairs], SCHEMA)


def test_groups(spark):
    long = "w" * 200_000
    pairs = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, long), (8, long), (9, long + "x"), (None, "n"), (10, "z"), (10, "z")]
    got = sorted(((r.doc_id or -1), r.keep_id, r.group_size, r.kept) for r in exact_dedup(rows(spark, pairs)).collect())
    assert got == [
        (-1, None, 1, True), (1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True),
        (7, 8, 2, False), (8, 8, 2, True), (9, 9, 1, True), (10, 10, 2, True), (10, 10, 2, True),
    ]
    kept = keep_one(rows(spark, pairs))
    assert kept.columns == ["doc_id", "text", "keep_id", "group size"]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 4, 5, 6, 8, 9, 10]


def test_hot_group_and_small_sieve(spark):
    pairs = [(i, "same" if i % 3 == 0 else f"text {i}") for i in range(6000)]
    got = exact_dedup(rows(spark, pairs), sieve_buckets=2).collect()
    assert sum(r.kept for r in got) == 4001
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id % 3 == 0} == {(5997, 2000)}


def test_empty(spark):
    assert exact_dedup(rows(spark, [])).count() == 0


def test_native_plan(spark):
    plan = exact_dedup(rows(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
