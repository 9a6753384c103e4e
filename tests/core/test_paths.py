"""Small cases of sources, search, traces, edges, checks, migrations and restructurings."""

import pytest
from pyspark.sql import functions as F

from relscope.operators import constraints, edges, keys, migrate, profile, relationships, restructure, search
from relscope.sources import readers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿id; name ;Unnamed: 2\n1;Ann;x\n2;;y\n", encoding="utf-8")
    df = readers.read_csv_table(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["id", "name"] and [tuple(r) for r in df.collect()] == [(1, "Ann"), (2, None)]


def test_csv_encodings(spark, tmp_path):
    for name, encoding, raw in (("u", "UTF-8", "id,name\n1,é\n".encode()), ("b", "UTF-8", b"\xef\xbb\xbf" + "id,name\n1,é\n".encode()), ("l", "ISO-8859-1", "id,name\n1,é\n".encode("latin-1"))):
        (tmp_path / f"{name}.csv").write_bytes(raw)
        path = str(tmp_path / f"{name}.csv")
        assert readers.text_encoding(spark, path) == encoding
        df = readers.read_csv_table(spark, path)
        assert df.columns == ["id", "name"] and df.first()["name"] == "é"


def test_partitioned_sinks(spark, tmp_path):
    df = frame(spark, [(i, "ab"[i % 2], None if i % 5 else i) for i in range(60)], "id int, kind string, other int")
    back = readers.sink_partitioned(df, str(tmp_path / "l"), "kind", "list")
    assert {(r.part, r["count"]) for r in back.groupBy("part").count().collect()} == {("a", 30), ("b", 30)}
    back = readers.sink_partitioned(df, str(tmp_path / "h"), "id", "hash", 4)
    assert back.select("part").distinct().count() <= 4 and sorted(r.id for r in back.collect()) == list(range(60))
    with pytest.raises(ValueError):
        readers.sink_partitioned(df, str(tmp_path / "x"), "id", "round")


def test_table_shape(spark):
    df = frame(spark, [(2, "b"), (1, None), (1, "a")], "id int, name string")
    assert tuple(readers.table_shape(df, "t", ["id", "name"]).first()) == ("t", 3, 2, True, "1|")
    assert tuple(readers.table_shape(df.limit(0), "t", ["name", "id"]).first()) == ("t", 0, 2, False, "")


def test_metadata(spark):
    loaded = frame(spark, [("dbo_Users", 0), ("users", 1), ("a_b_Orders", 2)], "loaded_name string, position int")
    meta = frame(spark, [("Users",), ("orders",), ("none",)], "meta_name string")
    assert {r.meta_name: r.loaded_name for r in readers.map_meta_names(meta, loaded).collect()} == {"Users": "users", "orders": "a_b_Orders"}
    assert readers.foreign_keys(frame(spark, [("a",)], "ParentTable string")).count() == 0
    cols = readers.declared_columns(frame(spark, [("t", "a", "BigInt", None), ("t", "b", "Money", "NO")], "TableName string, ColumnName string, DataType string, IsNullable string"))
    assert [(r.declared_type, r.is_nullable) for r in cols.orderBy("column_name").collect()] == [("INT", True), ("FLOAT", False)]


def test_search_modes_and_caps(spark):
    df = frame(spark, [(i, "Apple" if i % 2 else "apple pie", None) for i in range(300)], "id int, name string, gone string")
    tables = {"a": (df, ["id"]), "b": (df, ["id"])}
    assert search.search(tables, "Apple", "exact").count() == 200
    assert {r.table for r in search.search(tables, "PIE", scope="b").collect()} == {"b"}
    assert search.search(tables, "APPLE", "starts_with").count() == 200
    assert search.search(tables, "", "contains").count() == 0
    assert [r.row_key for r in search.search(tables, "^29", "regex", "a").collect()][:2] == ["29", "290"]
    with pytest.raises(ValueError):
        search.search(tables, "(", "regex")


def test_trace_stays_on_the_value_and_both_ways(spark):
    tables = {"c": frame(spark, [(1,), (2,)], "id int"), "o": frame(spark, [(7, 1)], "id int, c_id int"), "p": frame(spark, [(1, 2)], "id int, boss int")}
    rels = frame(spark, [(0, "o", "c_id", "c", "id"), (1, "p", "boss", "p", "id")], "rank int, source_table string, source_column string, target_table string, target_column string")
    seeds = frame(spark, [(1, "c", "id", "1"), (2, "x", "y", "9"), (3, "p", "id", "1"), (4, "c", "id", "2")], "seed_id long, table string, column string, value string")
    nodes, links = search.trace(tables, rels, seeds)
    assert {(r.seed_id, r.table, r.column, r.depth) for r in nodes.collect()} == {(1, "c", "id", 0), (1, "o", "c_id", 1), (2, "x", "y", 0), (3, "p", "id", 0), (4, "c", "id", 0)}
    assert [tuple(r) for r in links.collect()] == [(1, "c", "id", "o", "c_id")]


EDGES = "src string, dst string, type string"


def test_cycles_levels_and_reach(spark):
    e = frame(spark, [(a, b, "t") for a, b in ["ab", "bc", "ca", "cd", "de", "ef", "fe", "gg", "xa", "fy"]], EDGES)
    assert {r.node for r in edges.cycle_nodes(e).collect()} == set("abcef")
    dag = frame(spark, [(a, b, "t") for a, b in ["ab", "bd", "ad", "dd", "xy", "yx"]], EDGES)
    assert {r.node: r.level for r in edges.levels(dag).collect()} == {"a": 0, "b": 1, "d": 2, "x": 3, "y": 3}
    assert {r.node: r.depth for r in edges.reach(e, frame(spark, [("a",)], "node string"), 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert edges.component(e, "g").count() == 1
    assert edges.cycle_nodes(e.limit(0)).count() == 0 and edges.levels(e.limit(0)).count() == 0


def test_interval_gaps(spark):
    rows = frame(spark, [(1, 4, 2), (1, 8, 8), (1, 9, 1)], "owner int, start int, size int")
    got = sorted(tuple(r) for r in edges.interval_gaps(rows, frame(spark, [(1, 20)], "owner int, total int")).collect())
    assert got == [(1, 0, 4), (1, 6, 2), (1, 16, 4)]


def test_checks(spark):
    df = frame(spark, [(1, "a"), (1, "b"), (None, "c"), (None, "c"), (2, None)], "k int, s string")
    assert {r.column: r.violating_rows for r in constraints.not_null(df, ["k", "s"]).collect()} == {"k": 2, "s": 1}
    assert {(r.k, r.n) for r in constraints.primary_key(df, ["k"]).collect()} == {(1, 2), (None, 2)}
    assert constraints.unique(df, ["k", "s"]).count() == 0 and constraints.unique(df, ["k", "s"], nulls_distinct=False).count() == 1
    assert [r.s for r in constraints.foreign_key(df, ["k"], frame(spark, [(1,), (1,)], "id int"), ["id"]).collect()] == [None]
    assert constraints.expression(df, "k < 2").count() == 1
    assert constraints.cast(df, "s", "varchar(9)", "integer").count() == 4 and constraints.cast(df, "s", "varchar", "text").count() == 0
    assert constraints.length(df, "s", 0).count() == 4


def test_narrowing_casts(spark):
    df = frame(spark, [("1234.56", "abcdef"), ("12.30", "ab"), (None, None)], "n string, s string").selectExpr("cast(n as decimal(15,2)) as n", "s")
    assert constraints.cast(df, "n", "numeric(15,2)", "numeric(5,2)").count() == 1
    assert constraints.cast(df, "n", "numeric(15,2)", "numeric(20,2)").count() == 0
    assert constraints.cast(df, "n", "numeric(15,2)", "numeric").count() == 0
    assert [r.s for r in constraints.cast(df, "s", "varchar(50)", "varchar(5)").collect()] == ["abcdef"]
    assert constraints.cast(df, "s", "varchar(50)", "varchar(60)").count() == 0 and constraints.cast(df, "s", "text", "varchar(2)").count() == 1
    assert constraints.cast(df, "s", "varchar(50)", "text").count() == 0


def test_migrate_then_check_finds_nothing(spark):
    df = frame(spark, [(" 12 ", "x"), ("bad", None), ("", "y")], "v string, w string")
    out = migrate.migrate_select({"src": df}, {"t.v": {"sourceTable": "src", "sourceColumn": "v", "transform": "NULLIF_EMPTY"}, "t.w": {"sourceTable": "src", "sourceColumn": "w", "transform": "UPPER"}, "t.z": {}})["t"]
    assert sorted((r.v or "", r.w or "") for r in out.collect()) == [("", "Y"), ("12", "X"), ("bad", "")]
    fixed = migrate.conform_table(out, [{"op": "type", "column": "v", "type": "int"}, {"op": "default", "column": "w", "value": "?"}, {"op": "add", "column": "n", "type": "long"}, {"op": "not_null", "column": "v"}])
    assert [tuple(r) for r in fixed.collect()] == [(12, "X", None)]
    assert constraints.cast(fixed, "v", "integer", "smallint").count() == 0
    for name, value, want in [("CAST_BOOLEAN", "true", True), ("CAST_JSONB", "{", None), ("CAST_JSONB", "[1]", "[1]"), ("CAST_UUID", "nope", None), ("NO_SUCH", "v", "v")]:
        assert frame(spark, [(value,)], "c string").select(migrate.transform(F.col("c"), name)).first()[0] == want


def test_names():
    assert [restructure.table_name(n) for n in ["OrderItems", "categories", "class", "status", "boxes", "bus", "CustomerID"]] == ["order_item", "category", "class", "status", "box", "bus", "customer_id"]
    assert restructure.distinct_names(["a", "b", "a", "a"]) == ["a", "b", "a_2", "a_3"]


def test_restructurings(spark):
    wide = frame(spark, [tuple([i] + [None if i else 1] * 42) for i in range(20)], "id int, " + ", ".join(f"c{i} int" for i in range(42)))
    dense, side = restructure.vertical_split(wide, ["id"], profile.profile({"w": wide}), least=40)
    assert dense.columns == ["id"] and side.count() == 1
    assert restructure.vertical_split(wide, ["id"], profile.profile({"w": wide}))[1] is None
    lost = restructure.dangling(frame(spark, [(i,) for i in range(10)], "k int"), "k", frame(spark, [(1,), (2,)], "id int"), "id").first()
    assert (lost.dangling, lost.samples) == (8, "0|3|4|5|6")
    assert tuple(restructure.same_keys(frame(spark, [(1,), (1,)], "k int"), "k", frame(spark, [(1,)], "id int"), "id").first()) == (False, True)
    odd = restructure.encode_enum(frame(spark, [("b", 1, 2), ("a", 3, 4), (None, 5, 6)], "s string, v int, code int"), "s")
    assert odd.columns == ["s", "v", "code", "s_code"] and {tuple(r) for r in odd.collect()} == {("b", 1, 2, 2), ("a", 3, 4, 1), (None, 5, 6, None)}
    maps = restructure.eav_maps(frame(spark, [(1, "x", "b"), (1, "x", "a"), (1, "y", None), (1, None, "z"), (2, "x", "c")], "e int, a string, v string"), "e", "a", "v")
    assert {r.e: r.attributes for r in maps.collect()} == {1: {"x": ["a", "b"], "y": []}, 2: {"x": ["c"]}}
    coded = restructure.encode_enum(frame(spark, [("b",), ("a",), (None,)], "s string"), "s").collect()
    assert {(r.s, r.s_code) for r in coded} == {("b", 2), ("a", 1), (None, None)}


def test_apply_halves(spark):
    df = frame(spark, [(1, 300, "abc", 0.5), (2, -5, "d", 1.0)], "id long, n long, s string, f double")
    found = {r.column: r.new_type for r in restructure.type_downsize(profile.profile({"t": df})).collect()}
    assert found == {"id": "smallint", "n": "smallint", "s": "varchar(4)"}
    assert restructure.apply_downsize(df, found).dtypes == [("id", "smallint"), ("n", "smallint"), ("s", "string"), ("f", "double")]
    edge = profile.profile({"t": frame(spark, [(32768, None)], "a long, b string")})
    assert {r.column: r.new_type for r in restructure.type_downsize(edge).collect()} == {"a": "integer"}
    strict = restructure.apply_strict(df, ["n", "s"])
    assert [f.nullable for f in strict.schema.fields] == [True, False, False, True] and strict.count() == 2
    with pytest.raises(Exception, match="null in s"):
        restructure.apply_strict(frame(spark, [(1, None)], "n int, s string"), ["s"]).collect()


def test_detection_halves(spark):
    tables = {
        "colors": frame(spark, [(1, "red"), (2, "blue")], "id int, label string"),
        "cars": frame(spark, [(1, 1), (2, 1)], "id int, color_id int"),
        "traits": frame(spark, [(1, "k", "v")], "car_id int, attr_name string, val string"),
        "links": frame(spark, [(1, 1), (2, 2)], "car_id int, color_id int"),
    }
    keyed = keys.detect_keys(profile.profile(tables))
    rels = relationships.by_name(keyed)
    one = rels.where("source_table <> 'links'")
    assert [tuple(r) for r in restructure.lookup_candidates(keyed, one).collect()] == [("colors", "id", "label", "cars", "color_id")]
    assert restructure.lookup_candidates(keyed, rels).count() == 0  # two tables refer to it
    assert [tuple(r) for r in restructure.eav_candidates(keyed, rels).collect()] == [("traits", "car_id", "attr_name", "val")]
    assert [tuple(r) for r in restructure.mn_candidates(tables, keyed).collect()] == [("links", "car_id", "color_id", True, True, 2)]


def test_rebuild(spark):
    people = frame(spark, [(i, f"n{i}", "ab"[i % 2], None if i else 1.5) for i in range(12)], "PersonID int, FullName string, Kind string, score double")
    pets = frame(spark, [(i % 3, f"p{i}") for i in range(5)] + [(99, "lost")], "person_ref int, name string")
    tables = {"People": people, "Pets": pets}
    facts = profile.profile(tables)
    keyed = keys.detect_keys(facts).withColumn("key_type", F.expr("case when column = 'PersonID' then 'PK' else key_type end"))
    plan = restructure.rebuild_columns(tables, keyed, profile.suggest_type(facts, profile.pattern_fit(tables), enums=False))
    rels = frame(spark, [("Pets", "person_ref", "People", "PersonID", "one-to-many", "high")] * 2, "source_table string, source_column string, target_table string, target_column string, type string, confidence string")
    made, rules = restructure.rebuild_tables(tables, plan, rels)
    assert made["people"].columns == ["person_id", "full_name", "kind", "score"] and [f.nullable for f in made["people"].schema.fields] == [False, False, False, True]
    assert made["pet"].columns == ["pet_id", "person_ref", "name"] and not made["pet"].schema["name"].nullable
    got = {(r.table, r.kind, r.column, r.ref_table) for r in rules.collect()}
    assert {("people", "pk", "person_id", None), ("people", "enum", "kind", None), ("pet", "pk", "pet_id", None), ("pet", "fk", "person_ref", "people")} <= got
    assert sum(k == "fk" for _, k, _, _ in got) == 1
    bad = {(r.table, r.kind, r.column): r.violating_rows for r in restructure.rebuild_violations(made, rules, {("people", "kind"): ["a"]}).collect()}
    assert bad["pet", "fk", "person_ref"] == 1 and bad["people", "enum", "kind"] == 1 and sum(bad.values()) == 2
    decided = restructure.rebuild_decisions(tables, plan, rels, profile.enum_values(tables, plan.where("is_enum"))).collect()
    assert {(r.kind, r.table, r.column, r.detail) for r in decided} >= {
        ("rename", "people", None, "People"), ("rename", "pet", None, "Pets"), ("rename_column", "people", "full_name", "FullName"), ("enum", "people", "kind", "a|b"),
        ("pk", "pet", "pet_id", "surrogate"), ("fk", "pet", "person_ref", "people.person_id"), ("type", "people", "kind", "people_kind_enum not null"),
    }


def test_many_values_are_ranked_by_ranges(spark):
    df = spark.range(1500).selectExpr("concat('v', lpad(cast(id as string), 5, '0')) as s", "id")
    assert all(r.s_code == r.id + 1 for r in restructure.encode_enum(df, "s").collect())
    hot = spark.range(3000).selectExpr("id % 2 as a", "id as b")
    made = keys.pk_surrogate(hot, "n", ["a", "b"]).collect()
    assert sorted((r.n, r.a, r.b) for r in made) == [(i + 1, a, b) for i, (a, b) in enumerate(sorted((i % 2, i) for i in range(3000)))]
    assert keys.pk_surrogate(hot.limit(0), "n", ["a"]).count() == 0
