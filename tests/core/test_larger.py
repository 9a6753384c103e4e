"""What shows only beyond the smallest scale: larger keys, and work that follows the rows and not their pairs."""

import random
import re

import duckdb
import pytest

from relscope.operators import edges, profile, search
from relscope.plans import catalog, fixtures


def test_declared_types_of_larger_keys_match_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE VIEW customer AS SELECT * REPLACE (c_custkey + 40000 AS c_custkey) FROM '/root/testdata/sf0.001/customer.parquet'")
    con.execute(f"COPY customer TO '{tmp_path}/customer.parquet'")
    columns = ["table", "column", "old_type", "new_type"]
    got = catalog.QUERIES["type_downsize_declared"](spark, str(tmp_path)).select(*columns).collect()
    want = con.sql(catalog.ORACLE["type_downsize_declared"]).select(*[f'"{c}"' for c in columns]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("most", [1, 12, 4096])
def test_calls_are_resolved_without_a_shuffle_of_pairs(spark, most):
    draw = random.Random(5)
    called = [(draw.choice([None, *range(40)]), draw.choice([None, *range(20)])) for _ in range(300)] + [(99, f) for f in range(20)]
    given = [(draw.choice([None, *range(20)]), draw.choice([None, *range(30)])) for _ in range(200)]
    calls, assigned = spark.createDataFrame(called, "caller int, field int"), spark.createDataFrame(given, "field int, target int")
    known = spark.createDataFrame([(t,) for t in [*range(0, 30, 2), 4, None]], "target int")
    want = {(c, t) for c, f in called for g, t in given if f is not None and f == g and t is not None and t % 2 == 0}
    got = edges.resolve(calls, assigned, known, most)
    assert sorted(map(str, got.collect())) == sorted(f"Row(caller={c}, target={t})" for c, t in want)
    if most == 4096:
        lone = edges.resolve(calls.dropna(), assigned, known)
        assert "hashpartitioning(caller" in (plan := lone._jdf.queryExecution().toString()) and "target" not in "".join(x.split(")")[0] for x in plan.split("hashpartitioning(caller")[1:])


@pytest.mark.parametrize("most, kind", [(60, "long"), (4096, "long"), (4096, "string"), (4096, "int")])
def test_targets_of_a_task_are_bounded(spark, most, kind):
    draw = random.Random(6)
    wide = [-(2**63), -(2**31) - 1, -(2**31), -1, 0, 1, 2**31 - 1, 2**31, 2**62, 2**63 - 1] if kind == "long" else list(range(10))
    targets = [str(t) if kind == "string" else t for t in [*wide, *range(100, 130)]]
    called = [(draw.choice([-(2**63), -7, *range(50), 2**63 - 1]), draw.randrange(20)) for _ in range(400)] + [(3, f) for f in range(20)]
    given = [(draw.randrange(20), draw.choice(targets)) for _ in range(200)]
    calls, assigned = spark.createDataFrame(called, "caller long, field int"), spark.createDataFrame(given, f"field int, target {kind}")
    known = spark.createDataFrame([(t,) for t in targets[1:]], f"target {kind}")
    want = {(c, t) for c, f in called for g, t in given if f == g and t != targets[0]}
    got = edges.resolve(calls, assigned, known, most, 500)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(callers#\d+, (\d+)\)", got._jdf.queryExecution().toString())]
    assert dealt and min(dealt) > 2
    given_callers = calls.selectExpr("cast(caller as string) as caller", "field")
    named = edges.resolve(given_callers, assigned, known, most, 500)
    assert sorted(map(tuple, named.collect())) == sorted((str(c), t) for c, t in want)


def test_ranges_of_intervals_are_not_merged_by_their_bytes(spark):
    rows = spark.range(5000).selectExpr("id % 7 as owner", "id as start", "1L as size")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        assert edges.sliced(rows).select("slice").distinct().count() == 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_cells_of_traces_are_sorted_without_names(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "k int, v string")
    b = spark.createDataFrame([("1",), ("x",), ("z",)], "k string")
    rels = spark.createDataFrame([(0, "a", "k", "b", "k"), (1, "a", "v", "b", "k")], "rank int, source_table string, source_column string, target_table string, target_column string")
    wanted = spark.createDataFrame([("1",), ("x",), ("2",), (None,)], "value string")
    met = search._there(search._ends({"a": a, "b": b}, rels), wanted)
    assert sorted(map(tuple, met.collect())) == [("a", "k", "1"), ("a", "k", "2"), ("a", "v", "x"), ("b", "k", "1"), ("b", "k", "x")]
    assert re.search(r"Aggregate \[value#\d+, end#\d+\]", met._jdf.queryExecution().optimizedPlan().toString())


def test_leaves_take_no_part_in_the_rounds_of_components(spark, monkeypatch):
    draw, seen, known = random.Random(11), [], edges.components
    monkeypatch.setattr(edges, "components", lambda df: seen.append(df.count()) or known(df))
    star = [(f"o{i}", f"c{i % 9}") for i in range(200)] + [(f"c{i}", f"n{i % 3}") for i in range(9)] + [("n0", "r"), ("n1", "r"), ("n2", "q")]
    odd = [("o1", "o1"), ("o2", None), (None, "c0"), (None, None), ("x", "y"), ("z", "z"), ("o3", "c3"), ("y", None), ("o5", "o5"), ("p1", "p2"), ("p2", "p3")]
    rows = [(a, b, "t") for a, b in star + odd] + [(f"d{draw.randrange(20)}", f"d{draw.randrange(20)}", "u") for _ in range(12)]
    df = spark.createDataFrame(rows, "src string, dst string, type string")
    for start in ("o2", "x"):
        held = {start}
        while True:
            more = held | {n for a, b, _ in rows if a and b and (a in held or b in held) for n in (a, b)}
            if more == held:
                break
            held = more
        assert sorted(map(str, edges.component(df, start).collect())) == sorted(f"Row(src={a!r}, dst={b!r}, type={t!r})" for a, b, t in rows if a in held), start
    assert max(seen) < 40


def test_rows_are_dealt_before_they_become_cells(spark):
    table = spark.range(300).selectExpr("id", "id % 7 as few", "cast(id as string) as s").coalesce(1)
    dealt = profile.profile({"t": table}, dealt=True)
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString()
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, profile.profile({"t": table}).collect()))


def test_dense_numbers_share_the_groups_of_a_profile(spark):
    dense = spark.range(-640, 640).selectExpr("id", "cast(id as int) as few")
    assert profile._cells(0, dense).select("ordinal", "k1", "k2").distinct().count() == 2 * 20
    odd = [-(2**63), -(2**63) + 1, -65, -64, -1, 0, 1, 63, 64, 2**63 - 1, 2**63 - 1, None]
    rows = [(n, n is not None and n > 0, None if n is None else n % 7 / 4, None if n is None else str(n)) for n in odd]
    facts = profile.profile({"t": spark.createDataFrame(rows, "n long, b boolean, f double, s string")}).collect()
    got = {r.column: (r.unique_count, r.total_count, r.row_count, r.min_num, r.max_num, r.max_len) for r in facts}
    floats = [r[2] for r in rows if r[2] is not None]
    assert got == {
        "n": (10, 11, 12, float(-(2**63)), float(2**63), None), "b": (2, 12, 12, None, None, None),
        "f": (len(set(floats)), 11, 12, min(floats), max(floats), None), "s": (10, 11, 12, None, None, 20),
    }


def test_patterns_are_looked_for_only_where_they_can_be(spark):
    rows = [("a@b.c", 1.25, "10.0.0.1"), (None, -3.75, " 10.2.3.4 "), ("  ", 0.5, "")]
    df = spark.createDataFrame(rows, "s string, f double, a string").selectExpr("*", "cast(f as decimal(9,2)) as d")
    fit = profile.pattern_fit({"t": df})
    hits = {(r.column, k) for r in fit.collect() for k in profile.PATTERNS if r[k]}
    assert hits == {("s", "email"), ("a", "ip"), ("d", "money")}
    plan = fit._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2 * len(profile.PATTERNS) + 2


def test_tables_that_take_a_shuffle_are_made_once(spark, tmp_path):
    tables = fixtures.stored(fixtures.shop(spark, "/root/testdata/sf0.001", ["supply", "regions"]))
    assert not any("Aggregate" in df._jdf.queryExecution().optimizedPlan().toString() for df in tables.values())
    assert sorted(map(tuple, tables["supply"].collect())) == sorted(map(tuple, fixtures.view(spark, "/root/testdata/sf0.001", "supply").collect()))


def test_cells_are_unpivoted_and_grouped_table_by_table(spark):
    frames = {"t": spark.range(300).selectExpr("id", "cast(id as string) as s"), "u": spark.range(9).selectExpr("id / 4 as f", "cast(null as string) as none")}
    facts = profile.profile(frames)
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 2 and "Generate" not in plan and plan.index("Union") < plan.index("Expand")
    got = {(r.table, r.column): (r.unique_count, r.total_count, r.row_count, r.avg_len, r.max_len, r.min_num, r.max_num) for r in facts.collect()}
    assert got == {
        ("t", "id"): (300, 300, 300, None, None, 0.0, 299.0), ("t", "s"): (300, 300, 300, (10 + 2 * 90 + 3 * 200) / 300, 3, None, None),
        ("u", "f"): (9, 9, 9, None, None, 0.0, 2.0), ("u", "none"): (0, 0, 9, None, None, None, None),
    }


def test_numbers_become_text_only_where_it_may_be_money(spark):
    draw = random.Random(3)
    odd = [0.0, -0.0, 0.05, 0.01, 0.001, -0.25, 1.5, 2.0, 9999999.99, 1e7 + 0.25, 131072.02, 838861.06, 999999.9, float("nan"), float("inf"), None]
    rows = [(v,) for v in odd + [round(draw.uniform(-1, 1) * 10 ** draw.randrange(8), draw.randrange(4)) for _ in range(3000)]]
    df = spark.createDataFrame(rows, "d double").selectExpr("d", "cast(d as float) as f", "case when d < 1e7 then cast(d as decimal(12,2)) end as two", "case when d < 1e7 then cast(d as decimal(12,3)) end as three")
    for field in df.schema.fields:
        value = df[field.name]
        hits, may = value.cast("string").rlike(profile.PATTERNS["money"]), profile._may_be_money(value, field.dataType)
        assert df.where(hits & ~may).count() == 0, field
        assert field.name == "three" or df.where(hits & may).count() > 300
    assert df.where(~profile._may_be_money(df["d"], df.schema["d"].dataType)).count() > 1000
    wanted = df.where("cast(d as string) rlike '^-?[0-9]+[.][0-9]{2}$'").select("d", "two", "three")
    assert {(r.column, r.money) for r in profile.pattern_fit({"t": wanted}).collect()} == {("d", True), ("two", True), ("three", False)}


def test_values_of_enums_are_distinct_before_they_are_gathered(spark):
    df = spark.range(40).selectExpr("case when id % 5 > 0 then concat('v', id % 5) end as a", "id % 2 as b", "id")
    chosen = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "id")], "table string, column string")
    made = profile.enum_values({"t": df}, chosen)
    assert sorted(map(tuple, made.collect())) == [("t", "a", ["v1", "v2", "v3", "v4"]), ("t", "b", ["0", "1"])]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_decisions_of_a_rebuild_store_no_table(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(fixtures, "cut_round", lambda df: stored.append(df) or df)
    assert catalog.QUERIES["rebuild_decisions"](spark, "/root/testdata/sf0.001").count() > 0
    assert not stored
