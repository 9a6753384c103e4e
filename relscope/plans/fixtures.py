"""Views over the given tables that exercise the operators: one SQL text each, for Spark and for the oracle alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.loops import cut_round

GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Each table of the shop: its SQL, and its columns with their display types before lengths are known.
SHOP = {
    "regions": ("SELECT r_regionkey AS region_id, r_name AS name FROM {region}", "region_id:INT name:VARCHAR"),
    "nations": ("SELECT n_nationkey AS nation_id, n_name AS name, n_regionkey AS region_id FROM {nation}", "nation_id:INT name:VARCHAR region_id:INT"),
    "customers": (
        "SELECT c_custkey AS customer_id, c_name AS name, c_nationkey AS nation_id, c_acctbal AS balance, c_mktsegment AS segment, "
        "CASE WHEN c_custkey % 4 = 0 THEN 'note ' || CAST(c_custkey AS STRING) END AS note, CAST(c_custkey % 2 AS INT) AS active, "
        "'fixed' AS origin, CAST(NULL AS STRING) AS fax FROM {customer}",
        "customer_id:INT name:VARCHAR nation_id:INT balance:FLOAT segment:VARCHAR note:VARCHAR active:INT origin:VARCHAR fax:VARCHAR",
    ),
    "suppliers": ("SELECT s_suppkey AS supplier_id, s_name AS name, s_nationkey AS nation_id, s_acctbal AS balance FROM {supplier}", "supplier_id:INT name:VARCHAR nation_id:INT balance:FLOAT"),
    "parts": ("SELECT p_partkey AS part_id, p_name AS name, p_brand AS brand, p_size AS size, p_retailprice AS price FROM {part}", "part_id:INT name:VARCHAR brand:VARCHAR size:INT price:FLOAT"),
    "orders": (
        "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status, o_totalprice AS total, o_orderdate AS ordered_at, "
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS agent_ref FROM {orders}",
        "order_id:INT customer_id:INT status:VARCHAR total:FLOAT ordered_at:TIMESTAMP agent_ref:INT",
    ),
    "lineitems": (
        "SELECT l_orderkey AS order_id, l_partkey AS part_id, l_suppkey AS supplier_id, l_linenumber AS line_number, l_quantity AS quantity, l_returnflag AS returnflag FROM {lineitem}",
        "order_id:INT part_id:INT supplier_id:INT line_number:INT quantity:FLOAT returnflag:VARCHAR",
    ),
    "employees": (
        "SELECT c_custkey AS employee_id, CASE WHEN c_custkey >= 10 THEN CAST(FLOOR(c_custkey / 10) AS BIGINT) END AS employees_ref, c_name AS name FROM {customer}",
        "employee_id:INT employees_ref:INT name:VARCHAR",
    ),
    "articles": ("SELECT doc_id AS id, text AS body, lang FROM {documents}", "id:INT body:VARCHAR lang:VARCHAR"),
    "accounts": ("SELECT CAST(c_custkey AS STRING) AS customer_ref, CAST(c_custkey % 100 AS INT) AS points FROM {customer}", "customer_ref:VARCHAR points:INT"),
    "supply": ("SELECT DISTINCT l_partkey AS part_id, l_suppkey AS supplier_id FROM {lineitem}", "part_id:INT supplier_id:INT"),
}

#: Views with the flaws that the checks look for.
FLAWED = {
    "orders_dangling": "SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS customer_id FROM {orders}",
    "orders_nulls": "SELECT NULLIF(o_orderkey % 1000, 7) AS order_id, NULLIF(o_custkey % 3, 0) AS customer_id, o_totalprice AS total, o_orderstatus AS status FROM {orders}",
    "soft": "SELECT c_custkey AS customer_id, 'c' || CAST(CASE WHEN c_custkey % 10 = 0 THEN c_custkey - 1 ELSE c_custkey END AS STRING) || '@example.com' AS email, "
    "CASE WHEN c_custkey % 7 = 0 THEN '2024-01-01' END AS deleted_at FROM {customer}",
    "patterns": "SELECT c_custkey AS id, substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12) AS token, "
    "'u' || CAST(c_custkey AS STRING) || '@mail.example.com' AS email, '{{\"k\": ' || CAST(c_custkey AS STRING) || '}}' AS payload, "
    "'10.0.' || CAST(c_custkey % 256 AS STRING) || '.7' AS address, CAST(c_custkey AS STRING) || '.50' AS price, c_name AS label FROM {customer}",
    "typed": "SELECT c_custkey AS id, CAST(c_nationkey AS INT) AS small, c_custkey + 40000 AS middle, c_custkey + 3000000000 AS large, c_acctbal + 0.125 AS ratio, CAST(c_nationkey AS DOUBLE) + 0.25 AS money, "
    "c_acctbal > 0 AS flag, TIMESTAMP '2024-01-02 03:04:05' AS seen, c_mktsegment AS few, repeat(c_name, 5) AS longer, repeat(c_name, 20) AS body, NULLIF(c_name, c_name) AS none FROM {customer}",
    "log": "SELECT event_id AS id, ts AS created_at, event_type AS kind FROM {events}",
    "entities": "SELECT event_id AS id, ts AS seen FROM {events}",
    "raw_codes": "SELECT e.event_id, CASE WHEN e.event_id % 5 = 0 THEN 'x' || CAST(e.event_id AS STRING) WHEN e.event_id % 7 = 0 THEN '' ELSE CAST(e.event_id AS STRING) END AS code, e.event_type FROM {events} e",
    "segments": "SELECT DISTINCT c_mktsegment AS segment_id, 'Segment ' || c_mktsegment AS label FROM {customer}",
    "segmented": "SELECT c_custkey AS customer_id, c_mktsegment AS segment_id, c_name AS name FROM {customer}",
    "details": "SELECT c_custkey AS customer_id, c_acctbal AS balance FROM {customer}",
    "persons": "SELECT c_custkey AS customer_id, c_name AS name FROM {customer}",
    "one_supplier": "SELECT l_partkey AS part_id, MIN(l_suppkey) AS supplier_id FROM {lineitem} GROUP BY l_partkey",
    "eav": "SELECT event_id AS entity_id, 'kind' AS attribute_name, event_type AS attribute_value FROM {events} UNION ALL SELECT event_id, 'user', CAST(user_id AS STRING) FROM {events}",
    "row_edges": "SELECT 'o' || CAST(o_orderkey AS STRING) AS src, 'c' || CAST(o_custkey AS STRING) AS dst, 'places' AS type FROM {orders} UNION ALL "
    "SELECT 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING), 'lives' FROM {customer} UNION ALL "
    "SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING), 'lies' FROM {nation}",
    "boss_edges": "SELECT 'e' || CAST(c_custkey AS STRING) AS src, 'e' || CAST(CAST(FLOOR(c_custkey / 10) AS BIGINT) AS STRING) AS dst, 'reports' AS type FROM {customer} WHERE c_custkey >= 10",
    "ring_edges": "SELECT 'p' || CAST(p_partkey AS STRING) AS src, 'p' || CAST(CASE WHEN p_partkey % 5 = 4 THEN p_partkey - 4 ELSE p_partkey + 1 END AS STRING) AS dst, 'next' AS type FROM {part} WHERE p_partkey % 10 < 5 UNION ALL "
    "SELECT 'p' || CAST(p_partkey AS STRING), 'p' || CAST(p_partkey - 5 AS STRING), 'tail' FROM {part} WHERE p_partkey % 10 >= 5",
    "intervals": "SELECT l_orderkey AS owner, l_linenumber * 8 AS start, CAST(l_quantity AS INT) % 8 AS size FROM {lineitem}",
}


def _fill(text: str, form) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: form(m[1]), text.replace("{{", "\x01").replace("}}", "\x02")).replace("\x01", "{").replace("\x02", "}")


def text_of(name: str) -> str:
    return SHOP[name][0] if name in SHOP else FLAWED[name]


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over given tables, named in braces, as a Spark DataFrame."""
    for t in (t for t in GIVEN if "{" + t + "}" in text):
        given(spark, sf_dir, t).createOrReplaceTempView(f"given_{t}")
    return spark.sql(_fill(text, lambda t: f"given_{t}"))


def filled_sql(text: str) -> str:
    """The same SQL for the oracle."""
    return _fill(text, str)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a Spark DataFrame."""
    return filled(spark, sf_dir, text_of(name))


def shop(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    return {n: view(spark, sf_dir, n) for n in (names or SHOP)}


def stored(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The shop's tables for work that reads them more than once: those that take a shuffle to make are made once."""
    return {n: cut_round(df) if "DISTINCT" in text_of(n) else df for n, df in tables.items()}


def sql(name: str) -> str:
    """The fixture as a subquery of the oracle."""
    return f"({_fill(text_of(name), str)})"


def columns(name: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in (SHOP[name][1] if name in SHOP else OTHERS[name]).split()]


#: Columns of the typed view with their display types before lengths are known.
TYPED = "id:INT small:INT middle:INT large:INT ratio:FLOAT money:FLOAT flag:BOOLEAN seen:TIMESTAMP few:VARCHAR longer:VARCHAR body:VARCHAR none:VARCHAR"
#: Columns of other views that are profiled.
OTHERS = {
    "typed": TYPED,
    "patterns": "id:INT token:VARCHAR email:VARCHAR payload:VARCHAR address:VARCHAR price:VARCHAR label:VARCHAR",
    "segments": "segment_id:VARCHAR label:VARCHAR",
    "segmented": "customer_id:INT segment_id:VARCHAR name:VARCHAR",
    "entities": "id:INT seen:TIMESTAMP",
    "eav": "entity_id:INT attribute_name:VARCHAR attribute_value:VARCHAR",
    "log": "id:INT created_at:TIMESTAMP kind:VARCHAR",
    "one_supplier": "part_id:INT supplier_id:INT",
}


def profile_sql(names=None) -> str:
    """The profile of the shop tables as one SELECT."""
    parts = []
    for t in names or SHOP:
        for i, (c, kind) in enumerate(columns(t)):
            text, number = kind == "VARCHAR", kind in ("INT", "FLOAT")
            shown = f"CASE WHEN avg(length({c})) > 255 THEN 'TEXT' ELSE 'VARCHAR' END" if text else f"'{kind}'"
            parts.append(
                f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {i} AS ordinal, {shown} AS type, count({c}) < count(*) AS nullable, "
                f"count(DISTINCT {c}) AS unique_count, count({c}) AS total_count, count(*) AS row_count, "
                f"round(CASE WHEN count(*) = 0 THEN 0 ELSE (count(*) - count({c})) / count(*) END, 3) AS null_ratio, "
                f"{f'avg(length({c}))' if text else 'CAST(NULL AS DOUBLE)'} AS avg_len, {f'max(length({c}))' if text else 'CAST(NULL AS BIGINT)'} AS max_len, "
                f"{f'CAST(min({c}) AS DOUBLE)' if number else 'CAST(NULL AS DOUBLE)'} AS min_num, {f'CAST(max({c}) AS DOUBLE)' if number else 'CAST(NULL AS DOUBLE)'} AS max_num FROM {sql(t)}"
            )
    return " UNION ALL ".join(parts)
