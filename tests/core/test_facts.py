"""Small hand-made cases of the profile, key, relationship and advisory rules, and of adverse tables."""

import pytest
from pyspark.sql import functions as F

from relscope.operators import advisories, keys, profile, relationships


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_profile_of_adverse_tables(spark):
    tables = {
        "t": frame(spark, [(1, "a", None, 1.5), (2, "a", None, None), (None, "é", None, -2.0)], "i int, s string, n string, f double"),
        "empty": frame(spark, [], "x int, y string"),
        "nested": frame(spark, [([1, 2],), ([1, 2],)], "a array<int>"),
    }
    got = {(r.table, r.column): r for r in profile.profile(tables).collect()}
    i, s, n, f = (got["t", c] for c in "isnf")
    assert (i.type, i.nullable, i.unique_count, i.total_count, i.row_count, i.null_ratio, i.min_num, i.max_num) == ("INT", True, 2, 2, 3, 0.333, 1.0, 2.0)
    assert (s.type, s.unique_count, s.avg_len, s.max_len) == ("VARCHAR", 2, 1.0, 1)
    assert (n.unique_count, n.total_count, n.null_ratio) == (0, 0, 1.0)
    assert (f.type, f.min_num) == ("FLOAT", -2.0)
    assert got["empty", "x"].row_count == 0 and got["empty", "x"].null_ratio == 0 and not got["empty", "x"].nullable
    assert got["nested", "a"].unique_count == 1
    near = {(r.table, r.column): r for r in profile.profile(tables, approx=True).collect()}
    assert all(abs(near[k].unique_count - r.unique_count) <= 1 for k, r in got.items())


def test_text_type_needs_long_values(spark):
    got = profile.profile({"t": frame(spark, [("x" * 300, "y"), ("x" * 300, "y")], "long string, short string")}).collect()
    assert {r.column: r.type for r in got} == {"long": "TEXT", "short": "VARCHAR"}


@pytest.mark.parametrize(
    "name, want",
    [
        ("user_id", ["user", "users"]), ("order_ref", ["order", "orders"]), ("CustomerID", ["customer", "customers"]), ("OrderId", ["order", "orders"]),
        ("categoryId", ["category", "categorys", "categorie", "categories"]), ("status_key", ["status", "statu"]), ("c_custkey", None), ("_id", None), ("id", None), ("name", None),
    ],
)
def test_fk_candidates(spark, name, want):
    assert frame(spark, [(name,)], "c string").select(keys.fk_candidates(F.col("c"))).first()[0] == want


def test_key_precedence(spark):
    rows = [(1, 1, "u1", 1, 7, 1), (2, 2, "u2", 2, 7, None), (3, 3, None, 3, 7, None)]
    schema = "id int, customers_id int, uuid string, other_id int, same int, holes int"
    got = keys.detect_keys(profile.profile({"customers": frame(spark, rows, schema)})).collect()
    assert {r.column: r.key_type for r in got} == {"id": "PK", "customers_id": "PK", "uuid": "PK", "other_id": "FK", "same": None, "holes": None}


def test_surrogate_keys(spark):
    df = frame(spark, [(i % 7, i, "x") for i in range(500)], "a int, b int, part string").repartition(5)
    rows = keys.pk_surrogate(df, "k", ["a", "b"]).orderBy("k").collect()
    assert [r.k for r in rows] == list(range(1, 501)) and [(r.a, r.b) for r in rows] == sorted((i % 7, i) for i in range(500))
    loose = keys.pk_surrogate(df, "k")
    assert loose.columns == ["k", "a", "b", "part"] and loose.select("k").distinct().count() == 500
    assert sorted(loose.collect()) == sorted(loose.repartition(3, "b").collect())
    assert keys.pk_surrogate(df.limit(0), "k", ["a", "b"]).count() == 0


def shop(spark):
    return {
        "customers": frame(spark, [(i, f"n{i}") for i in range(1, 21)], "customer_id int, name string"),
        "orders": frame(spark, [(i, i % 20 + 1, i % 2) for i in range(1, 41)], "order_id int, customer_id int, paid int"),
        "people": frame(spark, [(1, None), (2, 1)], "id int, people_ref int"),
    }


def test_relationships(spark):
    tables = shop(spark)
    keyed = keys.detect_keys(profile.profile(tables)).cache()
    named = relationships.by_name(keyed).collect()
    assert [tuple(r) for r in named] == [("orders", "customer_id", "customers", "customer_id", "one-to-many", "high")]
    assert [r.source_column for r in relationships.self_references(keyed).collect()] == ["people_ref"]
    by_value = {(r.source_table, r.source_column, r.target_table, r.target_column): r.overlap for r in relationships.by_value(tables, keyed).collect()}
    assert by_value["orders", "customer_id", "customers", "customer_id"] == 1.0
    assert all(0.5 <= v <= 1 for v in by_value.values())
    found = relationships.implicit_fks(tables, keyed, relationships.by_name(keyed).limit(0)).collect()
    assert ("orders", "customer_id", "customers") in {(r.source_table, r.source_column, r.target_table) for r in found}


def test_combined_relationships_keep_the_first(spark):
    one = frame(spark, [("a", "x", "b", "y", "one-to-many", "high")], ", ".join(f"{c} string" for c in relationships.COLUMNS))
    got = relationships.combine({"metadata": one, "name": one.withColumn("confidence", F.lit("low"))}).collect()
    assert [(r.origin, r.confidence) for r in got] == [("metadata", "high")]


def test_advisories(spark):
    tables = shop(spark)
    keyed = keys.detect_keys(profile.profile(tables)).cache()
    rels = relationships.by_name(keyed)
    found = advisories.all_advisories(tables, keyed, rels)
    rules = {(r.rule, r.table, r.column) for r in found.collect()}
    assert ("boolean_masquerading", "orders", "paid") in rules and ("high_null_ratio", "people", "people_ref") in rules
    assert ("orphan_fk", "people", "people_ref") in rules and not any(r == "missing_primary_key" for r, _, _ in rules)
    assert {r.severity: r.n for r in advisories.counts(found).collect()}["error"] == 0
    scores = advisories.scores(found, keyed, rels).first()
    assert all(0 <= x <= 1 for x in scores)


def test_distinct_counts_of_sketches_stay_within_their_bound(spark):
    """A sketch with a relative standard deviation of rsd is off by more than four of them once in 16,000 columns."""
    tables = {"t": spark.range(50_000).selectExpr("id", "id % 1000 as thousand", "concat('x', id % 7777) as text", "id % 2 = 0 as flag")}
    exact = {r.column: r for r in profile.profile(tables).collect()}
    for rsd in (0.02, 0.05):
        near = {r.column: r for r in profile.profile(tables, approx=True, rsd=rsd).collect()}
        for name, r in exact.items():
            assert abs(near[name].unique_count - r.unique_count) <= 4 * rsd * r.unique_count
            assert near[name].total_count == r.total_count
    assert {n: r.unique_count for n, r in exact.items()} == {"id": 50_000, "thousand": 1000, "text": 7777, "flag": 2}


def test_distinct_values_of_nested_and_odd_columns(spark):
    nan = float("nan")
    df = spark.createDataFrame([({"a": 1}, [1, None], nan, 0.0), ({"a": 1}, [1, None], nan, -0.0), ({"a": 2}, None, 1.0, 1.0)], "m map<string,int>, a array<int>, f double, z double")
    got = {r.column: (r.unique_count, r.total_count) for r in profile.profile({"t": df}).collect()}
    assert got == {"m": (2, 3), "a": (1, 2), "f": (2, 3), "z": (2, 3)}
    assert [tuple(r) for r in profile.columns({"t": df}).collect()] == [("t", c, i) for i, c in enumerate("mafz")]


def test_declared_relationships(spark):
    keyed = keys.detect_keys(profile.profile({"a": frame(spark, [(1,), (2,)], "x int"), "b": frame(spark, [(1,), (1,)], "y int")}))
    names = frame(spark, [("A", "a"), ("B", "b")], "meta_name string, loaded_name string")
    fk = frame(spark, [("B", "y", "A", "x"), ("A", "x", "B", "y"), ("A", "none", "B", "y"), ("A", "x", "C", "z")], "parent_table string, parent_column string, referenced_table string, referenced_column string")
    rels = relationships.declared(fk, names, keyed)
    assert {(r.source_table, r.source_column): r.type for r in rels.collect()} == {("b", "y"): "one-to-many", ("a", "x"): "many-to-many", ("a", "none"): "one-to-many"}
    marked = {(r.table, r.column): r.key_type for r in relationships.mark_declared(keyed, rels).collect()}
    assert marked == {("a", "x"): "FK", ("b", "y"): "FK"}
