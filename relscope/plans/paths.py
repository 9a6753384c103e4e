"""Queries over sources and sinks, search, traces and edges, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges, keys, search
from ..operators import profile as prof
from ..operators import relationships
from ..operators.loops import scratch
from ..sources import readers
from .facts import BY_NAME, CARD, KEYED, keyed_of
from .fixtures import SHOP, columns, filled, filled_sql, given, shop, sql, view

QUERIES: dict = {}
ORACLE: dict = {}


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


# 2.1 sources and sinks


@query("src_csv", f"SELECT nation_id, name, region_id FROM {sql('nations')}")
def _(spark, sf_dir):
    path = scratch(spark, "csv")
    view(spark, sf_dir, "nations").write.csv(path, header=True, sep=";")
    return readers.read_csv_table(spark, path)


#: Declared metadata as an export would have it, derived from the given tables: keys and references between names as they
#: are stored in other cases, repeated, missing and padded; a type for every event type, by the rows that have it.
META_PK = "SELECT * FROM (SELECT CASE WHEN r_regionkey = 0 THEN 'Customers' WHEN r_regionkey = 1 THEN 'ORDERS' ELSE r_name END AS t, CASE WHEN r_regionkey = 0 THEN 'name' WHEN r_regionkey = 1 THEN 'order_id' ELSE 'x' END AS c FROM {region}) m"
META_FK = (
    "SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'orders' WHEN n_nationkey % 4 = 1 THEN 'Orders' WHEN n_nationkey % 4 = 2 THEN 'accounts' ELSE 'nations' END AS pt, "
    "CASE WHEN n_nationkey % 4 < 2 THEN 'agent_ref' WHEN n_nationkey % 4 = 2 THEN 'customer_ref' ELSE 'region_id' END AS pc, "
    "CASE WHEN n_nationkey % 4 = 3 THEN n_name ELSE 'customers' END AS rt, CASE WHEN n_nationkey % 4 = 3 THEN 'id' ELSE 'customer_id' END AS rc FROM {nation}"
)
META_COLUMNS = (
    "SELECT CASE p_partkey % 3 WHEN 0 THEN 'customers' WHEN 1 THEN 'orders' ELSE 'articles' END AS t, CASE p_partkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'total' ELSE 'body' END AS c, "
    "CASE p_partkey % 3 WHEN 0 THEN 'bit' WHEN 1 THEN ' money ' ELSE 'nvarchar' END AS d, CASE p_partkey % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' END AS n FROM {part} GROUP BY p_partkey % 3"
)


def _metadata(spark, sf_dir):
    """The three exports, written as CSV and read as such, and their table names mapped to the shop's."""
    paths = []
    for text, names in ((META_PK, ["TableName ", "ColumnName"]), (META_FK, ["ParentTable", "ParentColumn", "ReferencedTable", "ReferencedColumn"]), (META_COLUMNS, ["TableName", "ColumnName", "DataType", "IsNullable"])):
        paths.append(scratch(spark, "metadata"))
        filled(spark, sf_dir, text).toDF(*names).write.csv(paths[-1], header=True)
    pk, fk, col = readers.read_metadata(spark, *paths)
    names = pk.select("table_name").union(fk.select("parent_table")).union(fk.select("referenced_table")).union(col.select("table_name")).distinct().toDF("meta_name")
    loaded = spark.createDataFrame([(n, i) for i, n in enumerate(SHOP)], "loaded_name string, position int")
    return pk, fk, col, readers.map_meta_names(names, loaded)


DECLARED = f"d AS (SELECT DISTINCT lower(pt) AS source_table, pc AS source_column, rt AS target_table, rc AS target_column FROM ({filled_sql(META_FK)}) WHERE rt = 'customers')"
DECLARED_ROWS = f"""declared AS (SELECT d.*, {CARD} AS type, 'high' AS confidence FROM d JOIN keyed s ON s."table" = source_table AND s."column" = source_column JOIN keyed t ON t."table" = target_table AND t."column" = target_column)"""


@query(
    "src_metadata",
    f"SELECT t AS source_table, c AS source_column, CASE trim(d) WHEN 'bit' THEN 'BOOLEAN' WHEN 'money' THEN 'FLOAT' ELSE 'VARCHAR' END AS declared_type, coalesce(n, 'YES') = 'YES' AS is_nullable FROM ({filled_sql(META_COLUMNS)})",
)
def _(spark, sf_dir):
    _, _, col, names = _metadata(spark, sf_dir)
    there = prof.columns(shop(spark, sf_dir)).select("table", "column")
    met = col.join(names, F.col("table_name") == F.col("meta_name"))
    return met.join(there, (F.col("loaded_name") == F.col("table")) & (F.col("column_name") == F.col("column"))).select(F.col("loaded_name").alias("source_table"), F.col("column_name").alias("source_column"), "declared_type", "is_nullable")


TYPE_CASE = "CASE WHEN upper(t) IN ('LONG', 'INT') THEN 'INT' WHEN upper(t) = 'DECIMAL' THEN 'FLOAT' WHEN upper(t) = 'BIT' THEN 'BOOLEAN' WHEN upper(t) = 'NVARCHAR' THEN 'VARCHAR' ELSE upper(t) END"
EVENT_TYPE = "CASE event_id % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'decimal' WHEN 2 THEN 'bit' WHEN 3 THEN 'nvarchar' ELSE event_type END"


@query("norm_declared_type", f"SELECT event_id, {TYPE_CASE} AS type FROM (SELECT event_id, {EVENT_TYPE} AS t FROM events)")
def _(spark, sf_dir):
    return given(spark, sf_dir, "events").select("event_id", readers.norm_declared_type(F.expr(EVENT_TYPE)).alias("type"))


@query(
    "map_meta_names",
    "WITH m AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN upper(p_brand) ELSE substr(p_brand, 2) END AS meta_name FROM part), l AS (SELECT loaded_name, row_number() OVER (ORDER BY loaded_name) AS position FROM (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'dbo_' || p_brand END AS loaded_name FROM part)) "
    "SELECT meta_name, loaded_name FROM m JOIN l ON lower(loaded_name) = lower(meta_name) OR ends_with(lower(loaded_name), '_' || lower(meta_name)) QUALIFY row_number() OVER (PARTITION BY meta_name ORDER BY CASE WHEN lower(loaded_name) = lower(meta_name) THEN 0 ELSE 1 END, position) = 1",
)
def _(spark, sf_dir):
    part = given(spark, sf_dir, "part")
    meta = part.select(F.expr("CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN upper(p_brand) ELSE substr(p_brand, 2) END").alias("meta_name")).distinct()
    loaded = part.select(F.expr("CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'dbo_' || p_brand END").alias("loaded_name")).distinct()
    return readers.map_meta_names(meta, loaded.withColumn("position", F.expr("row_number() over (order by loaded_name)")))


@query(
    "apply_metadata",
    f"""WITH {KEYED} SELECT "table", "column", CASE WHEN ("table", "column") IN (('customers', 'name'), ('orders', 'order_id')) THEN 'PK' ELSE key_type END AS key_type,
    CASE WHEN ("table", "column") = ('customers', 'active') THEN 'BOOLEAN' WHEN ("table", "column") = ('orders', 'total') THEN 'FLOAT' WHEN ("table", "column") = ('articles', 'body') THEN 'VARCHAR' ELSE type END AS type,
    CASE WHEN ("table", "column") IN (('customers', 'active'), ('articles', 'body')) THEN true WHEN ("table", "column") = ('orders', 'total') THEN false ELSE nullable END AS nullable FROM keyed""",
)
def _(spark, sf_dir):
    pk, _, col, names = _metadata(spark, sf_dir)
    return readers.apply_metadata(keyed_of(spark, sf_dir), pk, col, names).select("table", "column", "key_type", "type", "nullable")


@query(
    "rel_metadata",
    f"""WITH {KEYED}, {DECLARED}, {DECLARED_ROWS}
    SELECT declared.*, CASE WHEN s.key_type = 'PK' THEN 'PK' ELSE 'FK' END AS key_type FROM declared JOIN keyed s ON s."table" = source_table AND s."column" = source_column""",
)
def _(spark, sf_dir):
    _, fk, _, names = _metadata(spark, sf_dir)
    keyed = keyed_of(spark, sf_dir)
    rels = relationships.declared(fk, names, keyed)
    marked = relationships.mark_declared(keyed, rels).select(F.col("table").alias("source_table"), F.col("column").alias("source_column"), "key_type")
    return rels.join(marked, ["source_table", "source_column"])


@query(
    "rel_combine_metadata",
    f"""WITH {BY_NAME}, {DECLARED}, {DECLARED_ROWS}, every AS (SELECT *, 'metadata' AS origin, 0 AS r FROM declared UNION ALL SELECT *, 'name', 1 FROM by_name UNION ALL SELECT *, 'self', 2 FROM selfs)
    SELECT * EXCLUDE (r) FROM every QUALIFY row_number() OVER (PARTITION BY source_table, source_column, target_table, target_column ORDER BY r) = 1""",
)
def _(spark, sf_dir):
    _, fk, _, names = _metadata(spark, sf_dir)
    keyed = keyed_of(spark, sf_dir)
    return relationships.combine({"metadata": relationships.declared(fk, names, keyed), "name": relationships.by_name(keyed), "self": relationships.self_references(keyed)})


@query("table_group", "SELECT event_id, CASE WHEN strpos(event_type || '_' || CAST(user_id AS VARCHAR), '_') > 0 THEN split_part(event_type || '_' || CAST(user_id AS VARCHAR), '_', 1) ELSE '' END AS table_group FROM events")
def _(spark, sf_dir):
    return given(spark, sf_dir, "events").select("event_id", readers.table_group(F.concat_ws("_", "event_type", F.col("user_id").cast("string"))).alias("table_group"))


@query("preview", f"SELECT CAST(c.customer_id AS VARCHAR) AS customer_id, c.name, coalesce(c.note, '') AS note, coalesce(c.fax, '') AS fax FROM {sql('customers')} c ORDER BY c.customer_id LIMIT 500")
def _(spark, sf_dir):
    return readers.preview(view(spark, sf_dir, "customers").select("customer_id", "name", "note", "fax"), ["customer_id"])


def _first_row(t):
    shown = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c, _ in columns(t))
    return f"coalesce((SELECT array_to_string([{shown}], '|') FROM {sql(t)} ORDER BY {', '.join(f'{c} NULLS FIRST' for c, _ in columns(t))} LIMIT 1), '')"


@query("table_shape", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS row_count, {len(columns(t))} AS column_count, true AS columns_match, {_first_row(t)} AS first_row FROM {sql(t)}" for t in SHOP))
def _(spark, sf_dir):
    return prof.union([readers.table_shape(df, t, [c for c, _ in columns(t)]) for t, df in shop(spark, sf_dir).items()])


@query("sink_facts", f"""WITH {BY_NAME} SELECT 'column' AS kind, "table", "column", key_type AS detail, total_count FROM keyed UNION ALL SELECT 'relationship', source_table, source_column, target_table || '.' || target_column || ' ' || type, NULL FROM by_name""")
def _(spark, sf_dir):
    keyed = keyed_of(spark, sf_dir)
    facts = readers.sink_facts(keyed, scratch(spark, "facts"))
    rels = readers.sink_facts(relationships.by_name(keyed), scratch(spark, "relationships"))
    own = facts.select(F.lit("column").alias("kind"), "table", "column", F.col("key_type").alias("detail"), "total_count")
    other = rels.select(F.lit("relationship").alias("kind"), F.col("source_table").alias("table"), F.col("source_column").alias("column"), F.concat_ws(" ", F.concat_ws(".", "target_table", "target_column"), "type").alias("detail"), F.lit(None).cast("long").alias("total_count"))
    return own.unionByName(other)


@query("sink_partitioned", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    return readers.sink_partitioned(given(spark, sf_dir, "events"), scratch(spark, "days"), "ts").groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("sink_partitioned_list", "SELECT event_type AS part, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY 1")
def _(spark, sf_dir):
    return readers.sink_partitioned(given(spark, sf_dir, "events"), scratch(spark, "kinds"), "event_type", "list").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("sink_partitioned_hash", "SELECT user_id, 1 AS parts, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    back = readers.sink_partitioned(given(spark, sf_dir, "events"), scratch(spark, "users"), "user_id", "hash")
    return back.groupBy("user_id").agg(F.count_distinct("part").alias("parts"), F.count(F.lit(1)).alias("n"))


@query(
    "sink_bucketed",
    f"SELECT c.customer_id, c.name, count(*) AS n_orders, sum(o.order_id) AS order_ids FROM {sql('orders')} o JOIN {sql('customers')} c ON o.customer_id = c.customer_id GROUP BY ALL",
)
def _(spark, sf_dir):
    orders, customers = (readers.sink_bucketed(view(spark, sf_dir, n), scratch(spark, n), ["customer_id"]) for n in ("orders", "customers"))
    return orders.join(customers.select("customer_id", "name"), "customer_id").groupBy("customer_id", "name").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("order_id").alias("order_ids"))


@query("partition_candidates", f"SELECT 'log' AS \"table\", count(*) AS row_count FROM {sql('log')} HAVING count(*) >= 1000 AND count(DISTINCT id) = count(*)")
def _(spark, sf_dir):
    tables = {"log": view(spark, sf_dir, "log"), "typed": view(spark, sf_dir, "typed")}
    facts = prof.settled(prof.profile(tables))
    return readers.partition_candidates(keys.detect_keys(facts), prof.suggest_type(facts, prof.pattern_fit(tables)))


# 2.5 search and trace

SEARCHED = {"nations": (["nation_id", "name", "region_id"], "nation_id"), "customers": (["customer_id", "name", "nation_id", "segment", "note"], "customer_id"), "parts": (["part_id", "name", "brand", "size"], "part_id"), "orders": (["order_id", "customer_id", "status"], "order_id")}


def _tables(spark, sf_dir):
    return {t: (view(spark, sf_dir, t).select(*c), [k]) for t, (c, k) in SEARCHED.items()}


def _hits(test, names=tuple(SEARCHED)):
    parts = []
    for rank, t in enumerate(names):
        cells = " UNION ALL ".join(f"SELECT {rank} AS rank, {i} AS ordinal, '{t}' AS \"table\", '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, {SEARCHED[t][1]} AS k FROM {sql(t)}" for i, c in enumerate(SEARCHED[t][0]))
        parts.append(f"(SELECT * FROM ({cells}) WHERE {test} QUALIFY row_number() OVER (ORDER BY ordinal, k) <= 100)")
    return f"SELECT \"table\", \"column\", value, CAST(k AS VARCHAR) AS row_key FROM ({' UNION ALL '.join(parts)}) ORDER BY rank, ordinal, k LIMIT 500"


for _name, (_query, _mode, _scope, _test) in {
    "search_exact": ("12", "exact", "all", "value = '12'"),
    "search_contains": ("BUILD", "contains", "all", "contains(lower(value), 'build')"),
    "search_starts_with": ("customer#00000000", "starts_with", "all", "starts_with(lower(value), 'customer#00000000')"),
    "search_regex": ("^1[0-4]+$", "regex", "all", "regexp_matches(value, '(?i)^1[0-4]+$')"),
    "search_scope": ("1", "contains", "customers", "contains(value, '1')"),
}.items():

    def _f(spark, sf_dir, args=(_query, _mode, _scope)):
        return search.search(_tables(spark, sf_dir), *args)

    query(_name, _hits(_test, tuple(SEARCHED) if _scope == "all" else (_scope,)))(_f)


for _name, (_query, _mode, _test) in {
    "search_indexed": ("#00000001", "contains", "contains(lower(value), '#00000001')"),
    "search_indexed_regex": ("^customer#.*77$", "regex", "regexp_matches(value, '(?i)^customer#.*77$')"),
}.items():

    def _f(spark, sf_dir, args=(_query, _mode)):
        """Tables stored in files by ranges of their keys, and searched through an index of those files."""
        stored, key = {t: scratch(spark, f"stored-{t}") for t in SEARCHED}, {t: [k] for t, (_, k) in SEARCHED.items()}
        for t, (df, k) in _tables(spark, sf_dir).items():
            df.repartitionByRange(8, *k).write.parquet(stored[t])
        return search.search_stored(spark, stored, key, search.gram_index(spark, stored, scratch(spark, "grams")), *args)

    query(_name, _hits(_test))(_f)


@query("search_by_table", f"SELECT *, count(*) OVER (PARTITION BY \"table\") AS n_hits FROM ({_hits(chr(39) + '1' + chr(39) + ' = value')}) QUALIFY row_number() OVER (PARTITION BY \"table\" ORDER BY \"column\", row_key) <= 10")
def _(spark, sf_dir):
    return search.by_table(search.search(_tables(spark, sf_dir), "1", "exact"))


@query("search_fields", f"SELECT part_id, name, brand FROM {sql('parts')} WHERE contains(lower(name), '3') OR contains(lower(brand), '3') ORDER BY part_id LIMIT 50")
def _(spark, sf_dir):
    return search.search_fields(view(spark, sf_dir, "parts"), ["name", "brand"], "3", "part_id").select("part_id", "name", "brand")


RELS = [
    ("orders", "customer_id", "customers", "customer_id"), ("customers", "nation_id", "nations", "nation_id"), ("suppliers", "nation_id", "nations", "nation_id"), ("lineitems", "order_id", "orders", "order_id"),
    ("supply", "part_id", "parts", "part_id"), ("supply", "supplier_id", "suppliers", "supplier_id"), ("nations", "region_id", "regions", "region_id"), ("lineitems", "part_id", "parts", "part_id"),
]
ENDS = sorted({(a, b) for a, b, _, _ in RELS} | {(c, d) for _, _, c, d in RELS})
STEPS = " UNION ALL ".join(f"SELECT {i} AS rank, '{a}' AS ft, '{b}' AS fc, '{c}' AS tt, '{d}' AS tc UNION ALL SELECT {i}, '{c}', '{d}', '{a}', '{b}'" for i, (a, b, c, d) in enumerate(RELS))
ONE = "SELECT CAST(1 AS BIGINT) AS seed_id, 'lineitems' AS t, 'part_id' AS c, '7' AS v"
MANY = f"SELECT customer_id AS seed_id, 'orders' AS t, 'customer_id' AS c, CAST(customer_id AS VARCHAR) AS v FROM {sql('customers')}"


def _trace_sql(seeds, depth=5):
    cells = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {sql(t)}" for t, c in ENDS)
    return f"""seeds AS ({seeds}), there AS (SELECT * FROM ({cells}) WHERE v IN (SELECT v FROM seeds)), steps AS ({STEPS}),
      r AS (SELECT seed_id, t, c, v, 0 AS depth FROM seeds UNION SELECT r.seed_id, s.tt, s.tc, r.v, r.depth + 1 FROM r JOIN steps s ON s.ft = r.t AND s.fc = r.c JOIN there h ON h.t = s.tt AND h.c = s.tc AND h.v = r.v WHERE r.depth < {depth}),
      nodes AS (SELECT seed_id, t, c, v, min(depth) AS depth FROM r GROUP BY ALL),
      links AS (SELECT b.seed_id, a.t AS from_table, a.c AS from_column, b.t AS to_table, b.c AS to_column FROM nodes a JOIN steps s ON s.ft = a.t AND s.fc = a.c JOIN nodes b ON b.seed_id = a.seed_id AND b.t = s.tt AND b.c = s.tc AND b.depth = a.depth + 1
        QUALIFY row_number() OVER (PARTITION BY b.seed_id, b.t, b.c ORDER BY s.rank, a.t, a.c) = 1)"""


def _trace(spark, sf_dir, seeds, indexed=False):
    rels = spark.createDataFrame([(i, *r) for i, r in enumerate(RELS)], "rank int, source_table string, source_column string, target_table string, target_column string")
    tables = shop(spark, sf_dir, sorted({t for t, _ in ENDS}))
    return search.trace(tables, rels, seeds, index=search.value_index(tables, rels, scratch(spark, "index")) if indexed else None)


def _one(spark):
    return spark.createDataFrame([(1, "lineitems", "part_id", "7")], "seed_id long, table string, column string, value string")


def _many(spark, sf_dir):
    c = view(spark, sf_dir, "customers")
    return c.select(F.col("customer_id").alias("seed_id"), F.lit("orders").alias("table"), F.lit("customer_id").alias("column"), F.col("customer_id").cast("string").alias("value"))


NODES = 'SELECT seed_id, t AS "table", c AS "column", v AS value, depth FROM nodes'


@query("trace_value", f"WITH RECURSIVE {_trace_sql(ONE)} {NODES}")
def _(spark, sf_dir):
    return _trace(spark, sf_dir, _one(spark))[0].select("seed_id", "table", "column", F.element_at("values", 1).alias("value"), "depth")


@query("trace_batch", f"WITH RECURSIVE {_trace_sql(MANY)} {NODES}")
def _(spark, sf_dir):
    return _trace(spark, sf_dir, _many(spark, sf_dir))[0].select("seed_id", "table", "column", F.element_at("values", 1).alias("value"), "depth")


@query("trace_indexed", f"WITH RECURSIVE {_trace_sql(MANY)} {NODES}")
def _(spark, sf_dir):
    return _trace(spark, sf_dir, _many(spark, sf_dir), indexed=True)[0].select("seed_id", "table", "column", F.element_at("values", 1).alias("value"), "depth")


@query("trace_edges", f"WITH RECURSIVE {_trace_sql(MANY)} SELECT * FROM links")
def _(spark, sf_dir):
    return _trace(spark, sf_dir, _many(spark, sf_dir))[1]


# 2.9 edges and intervals


@query("edge_degree", f"SELECT node, count(*) FILTER (i = 1) AS in_degree, count(*) FILTER (i = 0) AS out_degree, count(*) FILTER (i = 1 AND type = 'places') AS in_places, count(*) FILTER (i = 1 AND type = 'lives') AS in_lives FROM (SELECT dst AS node, 1 AS i, type FROM {sql('row_edges')} UNION ALL SELECT src, 0, type FROM {sql('row_edges')}) GROUP BY node")
def _(spark, sf_dir):
    return edges.degree(view(spark, sf_dir, "row_edges"), ["places", "lives"])


@query("edge_component", f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {sql('row_edges')}), b AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT 'r1' AS node UNION SELECT b.dst FROM r JOIN b ON b.src = r.node) SELECT src, dst, type FROM e WHERE src IN (SELECT node FROM r)")
def _(spark, sf_dir):
    return edges.component(view(spark, sf_dir, "row_edges"), "r1")


@query("edge_levels", f"WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {sql('boss_edges')}), r AS (SELECT DISTINCT src AS node, 0 AS level FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.node) SELECT node, max(level) AS level FROM r GROUP BY 1")
def _(spark, sf_dir):
    return edges.levels(view(spark, sf_dir, "boss_edges"))


@query("edge_cycles", f"WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {sql('ring_edges')} WHERE src <> dst), r AS (SELECT src AS start, dst AS node FROM e UNION SELECT r.start, e.dst FROM r JOIN e ON e.src = r.node) SELECT DISTINCT node FROM r WHERE node = start")
def _(spark, sf_dir):
    return edges.cycle_nodes(view(spark, sf_dir, "ring_edges"))


@query("edge_reach", f"WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {sql('row_edges')}), r AS (SELECT 'n3' AS node, 0 AS depth UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 2) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def _(spark, sf_dir):
    return edges.reach(view(spark, sf_dir, "row_edges"), spark.createDataFrame([("n3",)], "node string"), 2, "in")


@query("edge_resolve", f"SELECT DISTINCT a.order_id AS caller, b.supplier_id AS target FROM {sql('lineitems')} a JOIN {sql('supply')} b ON a.part_id = b.part_id WHERE b.supplier_id IN (SELECT supplier_id FROM {sql('suppliers')} WHERE balance > 0)")
def _(spark, sf_dir):
    calls = view(spark, sf_dir, "lineitems").select(F.col("order_id").alias("caller"), F.col("part_id").alias("field"))
    assigned = view(spark, sf_dir, "supply").select(F.col("part_id").alias("field"), F.col("supplier_id").alias("target"))
    return edges.resolve(calls, assigned, view(spark, sf_dir, "suppliers").where("balance > 0").select(F.col("supplier_id").alias("target")))


@query("entity_filter", f"SELECT part_id AS id, brand AS kind, CAST(size AS VARCHAR) AS file FROM {sql('parts')} WHERE brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') AND CAST(size AS VARCHAR) NOT IN ('1', '2') AND part_id % 7 <> 0")
def _(spark, sf_dir):
    parts = view(spark, sf_dir, "parts").select(F.col("part_id").alias("id"), F.col("brand").alias("kind"), F.col("size").cast("string").alias("file"))
    return edges.entity_filter(parts, ["Brand#11", "Brand#12", "Brand#13", "Brand#21"], None, parts.where("id % 7 = 0"), ["1", "2"])


REACHED = "coalesce(max(start + size) OVER (PARTITION BY owner ORDER BY start, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query("interval_gaps", f"WITH i AS (SELECT * FROM {sql('intervals')}), g AS (SELECT owner, {REACHED} AS gap_start, start - {REACHED} AS gap_size FROM i UNION ALL SELECT owner, max(start + size), 72 - max(start + size) FROM i GROUP BY owner) SELECT * FROM g WHERE gap_size > 0")
def _(spark, sf_dir):
    rows = view(spark, sf_dir, "intervals")
    return edges.interval_gaps(rows, rows.select("owner").distinct().withColumn("total", F.lit(72)))
