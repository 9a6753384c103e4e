"""Queries over profiles, keys, relationships and advisories, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advisories as adv
from ..operators import keys, relationships
from ..operators import profile as prof
from ..operators.loops import scratch
from . import fixtures
from .fixtures import profile_sql, shop, sql, stored, view

QUERIES: dict = {}
ORACLE: dict = {}


def query(name, oracle=None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


P = profile_sql()
BASE = """coalesce(nullif(regexp_extract(lower("column"), '^(.+)_(id|ref|key)$', 1), ''), nullif(regexp_extract(lower(regexp_replace(regexp_replace("column", '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')), '^(.+)_(id|ref|key)$', 1), ''))"""
CANDIDATES = f"""CASE WHEN {BASE} LIKE '%s' THEN [{BASE}, rtrim({BASE}, 's')] WHEN {BASE} LIKE '%y' THEN [{BASE}, {BASE} || 's', {BASE}[:-2] || 'ie', {BASE}[:-2] || 'ies'] WHEN {BASE} IS NOT NULL THEN [{BASE}, {BASE} || 's'] END"""
TABLE_PK = """replace(lower("column"), '_', '') IN (rtrim(lower("table"), 's') || 'id', lower("table") || 'id')"""
KEYED_OF = f"""keyed AS (SELECT *, CASE
    WHEN (lower("column") = 'id' OR {TABLE_PK}) AND unique_count = total_count AND total_count > 0 AND NOT nullable THEN 'PK'
    WHEN lower("column") IN ('uuid', 'guid') AND unique_count = total_count AND total_count > 0 THEN 'PK'
    WHEN {BASE} IS NOT NULL THEN 'FK'
    WHEN unique_count = total_count AND total_count > 0 AND NOT nullable THEN 'UQ' END AS key_type FROM p)"""
KEYED = f"p AS ({P}), {KEYED_OF}"
FIRST_PK = """first_pk AS (SELECT * FROM keyed WHERE key_type = 'PK' QUALIFY row_number() OVER (PARTITION BY "table" ORDER BY ordinal) = 1)"""
CARD = "CASE WHEN s.unique_count = s.total_count AND t.unique_count = t.total_count THEN 'one-to-one' WHEN t.unique_count = t.total_count THEN 'one-to-many' ELSE 'many-to-many' END"
SCORE = "(CASE WHEN list_contains(s.cand, lower(t.\"table\")) THEN 2 ELSE 0 END + CASE WHEN lower(t.\"column\") = 'id' THEN 1 ELSE 0 END + CASE WHEN s.type = t.type THEN 1 ELSE 0 END)"
NAMED = f"""{FIRST_PK}, fk AS (SELECT *, {CANDIDATES} AS cand FROM keyed WHERE key_type = 'FK'),
  by_name AS (SELECT s."table" AS source_table, s."column" AS source_column, t."table" AS target_table, t."column" AS target_column, {CARD} AS type,
    CASE WHEN {SCORE} >= 3 THEN 'high' WHEN {SCORE} >= 2 THEN 'medium' ELSE 'low' END AS confidence
  FROM fk s JOIN first_pk t ON list_contains(s.cand, lower(t."table")) AND s."table" <> t."table"),
  selfs AS (SELECT "table" AS source_table, "column" AS source_column, "table" AS target_table, 'id' AS target_column, 'one-to-many' AS type, 'medium' AS confidence
    FROM fk WHERE list_contains(cand, lower("table")) OR list_contains(cand, rtrim(lower("table"), 's')))"""
BY_NAME = f"{KEYED}, {NAMED}"


def by_name_sql(names):
    """The relationships by name, and what they stand on, of other tables than the shop's."""
    return f"p AS ({profile_sql(names)}), {KEYED_OF}, {NAMED}"


def keyed_of(spark, sf_dir, names=None):
    return keys.detect_keys(prof.settled(prof.profile(shop(spark, sf_dir, names))))


@query("src_tables", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS row_count FROM {t}" for t in fixtures.GIVEN))
def _(spark, sf_dir):
    from ..sources import readers

    tables = readers.load_tables(spark, sf_dir, fixtures.GIVEN)
    return prof.union([df.agg(F.lit(t).alias("table"), F.count(F.lit(1)).alias("row_count")) for t, df in tables.items()])


@query("profile", P)
def _(spark, sf_dir):
    return prof.profile(shop(spark, sf_dir))


@query("profile_approx")
def _(spark, sf_dir):
    return prof.profile(shop(spark, sf_dir), approx=True)


_MERGED = profile_sql(["orders", "lineitems"])


@query(
    "profile_merged",
    f'SELECT "table", "column", type, total_count, row_count, null_ratio, max_len, min_num, max_num, true AS near FROM ({_MERGED})',
)
def _(spark, sf_dir):
    """Sketches of two halves of each table, stored, read and merged: exact but for the distinct values, which are near."""
    tables, stored = shop(spark, sf_dir, ["orders", "lineitems"]), []
    for half in (0, 1):
        stored.append(scratch(spark, "sketches"))
        prof.sketches({n: df.where(f"order_id % 2 = {half}") for n, df in tables.items()}).write.parquet(stored[-1])
    merged = prof.from_sketches(prof.merge_sketches(*[spark.read.parquet(p) for p in stored]))
    exact = prof.profile(tables).select("table", "column", F.col("unique_count").alias("exact"))
    near = F.abs(F.col("unique_count") - F.col("exact")) <= 0.1 * F.col("exact")
    return merged.join(exact, ["table", "column"]).select("table", "column", "type", "total_count", "row_count", "null_ratio", "max_len", "min_num", "max_num", near.alias("near"))


for _name, _columns in {"display_type": "type", "null_ratio": "null_ratio", "avg_len": "avg_len", "value_range": "min_num, max_num, max_len"}.items():

    def _f(spark, sf_dir, columns=_columns):
        return prof.profile(shop(spark, sf_dir)).select("table", "column", *columns.split(", "))

    query(_name, f'SELECT "table", "column", {_columns} FROM ({P})')(_f)


@query("sample_values", f"SELECT CAST(v AS VARCHAR) AS value FROM (SELECT DISTINCT segment AS v FROM {sql('customers')} WHERE segment IS NOT NULL ORDER BY v LIMIT 3)")
def _(spark, sf_dir):
    return prof.sample_values(view(spark, sf_dir, "customers"), "segment", 3)


@query("column_values", f"SELECT DISTINCT CAST(nation_id AS VARCHAR) AS value FROM (SELECT DISTINCT nation_id FROM {sql('customers')} WHERE nation_id IS NOT NULL ORDER BY nation_id LIMIT 100)")
def _(spark, sf_dir):
    return prof.sample_values(view(spark, sf_dir, "customers"), "nation_id", 100)


ENUM_COLUMNS = [(t, c) for t in fixtures.SHOP for c, k in fixtures.columns(t) if k == "VARCHAR"]
VALUES = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)) AS vals FROM {sql(t)} HAVING count(DISTINCT {c}) BETWEEN 1 AND 15" for t, c in ENUM_COLUMNS)


@query("enum_values", f"SELECT v.\"table\", v.\"column\", array_to_string(vals, '|') AS vals FROM ({VALUES}) v")
def _(spark, sf_dir):
    tables = shop(spark, sf_dir)
    chosen = prof.settled(prof.profile(tables)).where("type in ('VARCHAR', 'TEXT') and unique_count between 1 and 15")
    return prof.enum_values(tables, chosen).select("table", "column", F.array_join("values", "|").alias("vals"))


def fit_sql(table, names):
    """The patterns, written out for the oracle."""
    parts = []
    for c in names:
        v = f"nullif(trim(CAST({c} AS VARCHAR)), '')"
        parts.append(
            f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", "
            f"coalesce(bool_and(regexp_full_match({v}, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}')), false) AS uuid, "
            f"coalesce(bool_and(regexp_full_match({v}, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')), false) AS email, coalesce(bool_and(left(ltrim({v}), 1) IN ('{{', '[')), false) AS json, "
            f"coalesce(bool_and(regexp_matches({v}, '^[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}')), false) AS ip, coalesce(bool_and(regexp_full_match({v}, '-?[0-9]+\\.[0-9][0-9]')), false) AS money, "
            f"max(length({v})) AS longest FROM {sql(table)}"
        )
    return " UNION ALL ".join(parts)


FIT_SQL = fit_sql("patterns", ["token", "email", "payload", "address", "price", "label"])


@query("pattern_fit", FIT_SQL)
def _(spark, sf_dir):
    return prof.pattern_fit({"patterns": view(spark, sf_dir, "patterns")})


def types_sql(enums=True):
    """The suggested types over p and f, as CASE."""
    key = """(type = 'INT' AND (lower(p."column") = 'id' OR ends_with(lower(p."column"), '_id')) AND unique_count = total_count AND total_count > 0 AND NOT nullable)"""
    few = "unique_count <= 20 AND total_count > 10" if enums else "false"
    rules = [
        (key, "bigint", "high", "unique non-null key"), ("type = 'INT' AND (max_num > 2147483647 OR min_num < -2147483648)", "bigint", "medium", "beyond the integer range"),
        ("type = 'INT' AND max_num < 32768 AND min_num > -32768", "smallint", "medium", "within the smallint range"), ("type = 'INT'", "integer", "medium", "integer"),
        ("type = 'FLOAT' AND money", "numeric(15,2)", "high", "two decimals throughout"), ("type = 'FLOAT'", "double precision", "medium", "floating point"), ("type = 'TEXT'", "text", "medium", "long text"),
        ("type = 'VARCHAR' AND uuid", "uuid", "high", "uuid pattern"), ("type = 'VARCHAR' AND email", "varchar(320)", "high", "email pattern"), ("type = 'VARCHAR' AND json", "jsonb", "medium", "json pattern"),
        ("type = 'VARCHAR' AND ip", "inet", "medium", "address pattern"), (f"type = 'VARCHAR' AND {few}", "enum", "medium", "few distinct values"),
        ("type = 'VARCHAR' AND longest BETWEEN 1 AND 50", "varchar(50)", "medium", "length"), ("type = 'VARCHAR' AND longest BETWEEN 51 AND 255", "varchar(255)", "medium", "length"),
        ("type = 'BOOLEAN'", "boolean", "high", "direct"), ("type = 'TIMESTAMP'", "timestamptz", "high", "direct"),
    ]
    last = ["text", "medium", "no values to go by"]
    case = lambda i: "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[i + 1]}'" for r in rules) + f" ELSE '{last[i]}' END"
    return f"""SELECT p."table", p."column", {case(0)} AS target_type, nullable, CASE WHEN {key} THEN 'ALWAYS' END AS identity, {case(1)} AS confidence, {case(2)} AS reason
      FROM p LEFT JOIN f ON p."table" = f."table" AND p."column" = f."column" """


def fits_sql(names):
    return " UNION ALL ".join(fit_sql(t, own) for t in names if (own := [c for c, k in fixtures.columns(t) if k in ("VARCHAR", "FLOAT")]))


@query("suggest_type", f"WITH p AS ({profile_sql(['patterns', 'typed'])}), f AS ({fits_sql(['patterns', 'typed'])}) {types_sql()}")
def _(spark, sf_dir):
    tables = {n: view(spark, sf_dir, n) for n in ("patterns", "typed")}
    return prof.suggest_type(prof.profile(tables, dealt=True), prof.pattern_fit(tables))


@query("detect_keys", f'WITH {KEYED} SELECT "table", "column", key_type, nullable FROM keyed')
def _(spark, sf_dir):
    return keyed_of(spark, sf_dir).select("table", "column", "key_type", "nullable")


@query("table_pk_name", f'SELECT "table", "column", {TABLE_PK} AS is_table_pk FROM ({P})')
def _(spark, sf_dir):
    p = prof.columns(shop(spark, sf_dir))
    return p.select("table", "column", keys.is_table_pk(F.col("table"), F.col("column")).alias("is_table_pk"))


@query("fk_name_candidates", f"SELECT \"table\", \"column\", array_to_string({CANDIDATES}, '|') AS candidates FROM ({P}) WHERE {BASE} IS NOT NULL")
def _(spark, sf_dir):
    p = prof.columns(shop(spark, sf_dir))
    return p.select("table", "column", F.array_join(keys.fk_candidates(F.col("column")), "|").alias("candidates")).where("candidates is not null")


@query("pk_surrogate", f"SELECT row_number() OVER (ORDER BY order_id, part_id, supplier_id, line_number, quantity, returnflag) AS lineitem_id, order_id, part_id, supplier_id FROM {sql('lineitems')}")
def _(spark, sf_dir):
    made = keys.pk_surrogate(view(spark, sf_dir, "lineitems"), "lineitem_id", ["order_id", "part_id", "supplier_id", "line_number", "quantity", "returnflag"])
    return made.select("lineitem_id", "order_id", "part_id", "supplier_id")


@query("rel_by_name", f"WITH {BY_NAME} SELECT * FROM by_name")
def _(spark, sf_dir):
    return relationships.by_name(keyed_of(spark, sf_dir))


@query("rel_self", f"WITH {BY_NAME} SELECT * FROM selfs")
def _(spark, sf_dir):
    return relationships.self_references(keyed_of(spark, sf_dir))


@query("rel_cardinality", f"WITH {BY_NAME} SELECT source_table, source_column, target_table, target_column, type FROM by_name")
def _(spark, sf_dir):
    return relationships.by_name(keyed_of(spark, sf_dir)).drop("confidence")


@query("rel_confidence", f"WITH {BY_NAME} SELECT source_table, source_column, target_table, target_column, confidence FROM by_name")
def _(spark, sf_dir):
    return relationships.by_name(keyed_of(spark, sf_dir)).drop("type")


_PAIRS = [(t, c) for t in fixtures.SHOP for c, _ in fixtures.columns(t)]
CELLS = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {sql(t)} WHERE {c} IS NOT NULL" for t, c in _PAIRS)
BY_VALUE = f"""{KEYED}, cells AS MATERIALIZED ({CELLS}),
  srcs AS (SELECT * FROM keyed WHERE coalesce(key_type, '') NOT IN ('PK', 'UQ') AND type <> 'TEXT' AND unique_count >= 2),
  tgts AS (SELECT * FROM keyed WHERE unique_count = total_count AND type <> 'TEXT' AND unique_count >= 2),
  common AS (SELECT a.t AS s_t, a.c AS s_c, b.t AS t_t, b.c AS t_c, count(*) AS n FROM cells a JOIN cells b ON a.v = b.v AND a.t <> b.t
     SEMI JOIN srcs ON srcs."table" = a.t AND srcs."column" = a.c SEMI JOIN tgts ON tgts."table" = b.t AND tgts."column" = b.c GROUP BY ALL),
  found AS (SELECT s_t AS source_table, s_c AS source_column, t_t AS target_table, t_c AS target_column, {CARD} AS type,
     CASE WHEN n / s.unique_count >= 0.9 THEN 'high' WHEN n / s.unique_count >= 0.7 THEN 'medium' ELSE 'low' END AS confidence, round(n / s.unique_count, 6) AS overlap
     FROM common JOIN keyed s ON s."table" = s_t AND s."column" = s_c JOIN keyed t ON t."table" = t_t AND t."column" = t_c WHERE n / s.unique_count >= 0.5),
  by_value AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY list_sort([source_table || '.' || source_column, target_table || '.' || target_column]) ORDER BY source_table, source_column) = 1)"""


@query("rel_by_value", f"WITH {BY_VALUE} SELECT * FROM by_value")
def _(spark, sf_dir):
    tables = stored(shop(spark, sf_dir))
    return relationships.by_value(tables, keys.detect_keys(prof.settled(prof.profile(tables))))


@query(
    "rel_combine",
    f"WITH {BY_VALUE.replace(KEYED, BY_NAME)}, every AS (SELECT *, 'name' AS origin, 0 AS r FROM by_name UNION ALL SELECT *, 'self', 1 FROM selfs UNION ALL SELECT * EXCLUDE (overlap), 'value', 2 FROM by_value) "
    "SELECT * EXCLUDE (r) FROM every QUALIFY row_number() OVER (PARTITION BY source_table, source_column, target_table, target_column ORDER BY r) = 1",
)
def _(spark, sf_dir):
    tables = stored(shop(spark, sf_dir))
    keyed = keys.detect_keys(prof.settled(prof.profile(tables)))
    value = relationships.by_value(tables, keyed)
    return relationships.combine({"name": relationships.by_name(keyed), "self": relationships.self_references(keyed), "value": value})


@query(
    "junction_tables",
    f"""WITH {KEYED} SELECT "table", count(*) FILTER (key_type = 'FK') AS fk_columns, count(*) FILTER (coalesce(key_type, '') NOT IN ('FK', 'PK') AND lower("column") NOT IN ('id', 'created_at', 'updated_at', 'deleted_at')) AS other_columns
    FROM keyed GROUP BY 1 HAVING fk_columns >= 2 AND other_columns <= 1""",
)
def _(spark, sf_dir):
    return relationships.junction_tables(keyed_of(spark, sf_dir))


@query("rel_filter", f"WITH {BY_NAME} SELECT * FROM by_name WHERE type = 'one-to-many' AND (source_table IN ('orders', 'nations') OR target_table IN ('orders', 'nations'))")
def _(spark, sf_dir):
    keyed = keyed_of(spark, sf_dir)
    return relationships.filter_relationships(relationships.by_name(keyed), keyed, ["FK"], ["one-to-many"], ["orders", "nations"])


@query(
    "implicit_fk",
    f"""WITH {BY_NAME}, cells AS MATERIALIZED ({CELLS}), child AS (SELECT * FROM keyed WHERE regexp_matches(lower("column"), '_(id|ref|key)$') AND coalesce(key_type, '') <> 'PK' AND unique_count > 0
       AND NOT EXISTS (SELECT 1 FROM by_name b WHERE b.source_table = "table" AND b.source_column = "column")),
    pairs AS (SELECT a.t AS source_table, a.c AS source_column, b.t AS target_table, b.c AS target_column, count(*) AS n FROM cells a JOIN cells b ON a.v = b.v AND a.t <> b.t
       SEMI JOIN child ON child."table" = a.t AND child."column" = a.c SEMI JOIN first_pk f ON f."table" = b.t AND f."column" = b.c GROUP BY ALL)
    SELECT source_table, source_column, target_table, target_column, round(n / k.unique_count, 6) AS overlap FROM pairs JOIN keyed k ON k."table" = source_table AND k."column" = source_column
    WHERE n / k.unique_count >= 0.9 QUALIFY row_number() OVER (PARTITION BY source_table, source_column ORDER BY n / k.unique_count DESC, target_table, target_column) = 1""",
)
def _(spark, sf_dir):
    tables = shop(spark, sf_dir)
    keyed = keys.detect_keys(prof.settled(prof.profile(tables)))
    return relationships.implicit_fks(tables, keyed, prof.settled(relationships.by_name(keyed)))


# Advisories: the evidence map is spread to columns, as maps have no order to compare by.
ADV = {
    "adv_missing_pk": (lambda t, k, r: adv.missing_pk(k), """SELECT 'missing_primary_key' AS rule, 'warning' AS severity, "table", CAST(NULL AS VARCHAR) AS "column" FROM keyed GROUP BY "table" HAVING count(*) FILTER (key_type = 'PK') = 0"""),
    "adv_unmarked_unique": (lambda t, k, r: adv.unmarked_unique(k), """SELECT 'unmarked_unique' AS rule, 'info' AS severity, "table", "column" FROM keyed WHERE unique_count = total_count AND NOT nullable AND total_count >= 10 AND coalesce(key_type, '') NOT IN ('PK', 'UQ')"""),
    "adv_high_null": (lambda t, k, r: adv.high_null(k), """SELECT 'high_null_ratio' AS rule, 'info' AS severity, "table", "column" FROM keyed WHERE null_ratio >= 0.5"""),
    "adv_enum": (lambda t, k, r: adv.enum_candidates(t, k), """SELECT 'enum_candidate' AS rule, 'info' AS severity, "table", "column" FROM keyed WHERE type IN ('VARCHAR', 'TEXT') AND unique_count BETWEEN 1 AND 15 AND total_count >= 10 AND coalesce(key_type, '') NOT IN ('PK', 'UQ')"""),
    "adv_wide_text": (lambda t, k, r: adv.wide_text(k), """SELECT 'wide_varchar' AS rule, 'info' AS severity, "table", "column" FROM keyed WHERE avg_len >= 500"""),
    "adv_bool": (lambda t, k, r: adv.boolean_like(t, k), """SELECT 'boolean_masquerading' AS rule, 'info' AS severity, "table", "column" FROM keyed WHERE type IN ('INT', 'FLOAT') AND key_type IS NULL AND unique_count BETWEEN 1 AND 2 AND min_num IN (0, 1) AND max_num IN (0, 1)"""),
    "adv_orphan_fk": (lambda t, k, r: adv.orphan_fk(k, r), """SELECT 'orphan_fk' AS rule, 'warning' AS severity, "table", "column" FROM keyed k WHERE key_type = 'FK' AND NOT EXISTS (SELECT 1 FROM by_name b WHERE b.source_table = k."table" AND b.source_column = k."column")"""),
    "adv_low_conf": (lambda t, k, r: adv.low_confidence(r), """SELECT 'low_confidence_fk' AS rule, 'info' AS severity, source_table AS "table", source_column AS "column" FROM by_name WHERE confidence IN ('low', 'medium')"""),
}
ALL_ADV = f"{BY_NAME}, adv AS ({' UNION ALL '.join(s for _, s in ADV.values())})"


def _parts(spark, sf_dir):
    tables = shop(spark, sf_dir)
    keyed = keys.detect_keys(prof.settled(prof.profile(tables)))
    return tables, keyed, prof.settled(relationships.by_name(keyed))


for _name, (_rule, _sql) in ADV.items():

    def _f(spark, sf_dir, rule=_rule):
        return rule(*_parts(spark, sf_dir)).select("rule", "severity", "table", "column")

    query(_name, f"WITH {BY_NAME} {_sql}")(_f)


@query("adv_counts", f"WITH {ALL_ADV} SELECT s.severity, count(adv.rule) AS n FROM (VALUES ('error'), ('warning'), ('info')) s(severity) LEFT JOIN adv ON adv.severity = s.severity GROUP BY 1")
def _(spark, sf_dir):
    return adv.counts(adv.all_advisories(*_parts(spark, sf_dir)))


def _score(bad, total):
    return f"round(greatest(0, 1 - {bad} / greatest({total}, 1)), 2)"


@query(
    "adv_scores",
    f"""WITH {ALL_ADV}, a AS (SELECT count(*) FILTER (rule = 'missing_primary_key') AS no_pk, count(*) FILTER (rule IN ('wide_varchar', 'enum_candidate', 'boolean_masquerading')) AS loose, count(*) FILTER (rule IN ('orphan_fk', 'low_confidence_fk')) AS doubt FROM adv),
    k AS (SELECT count(DISTINCT "table") AS tabs, count(*) AS cols FROM keyed), r AS (SELECT count(*) AS rels FROM by_name)
    SELECT {_score('no_pk', 'tabs')} AS structure, {_score('loose', 'cols')} AS type_precision, {_score('doubt', '(rels + doubt)')} AS relationships FROM a, k, r""",
)
def _(spark, sf_dir):
    tables, keyed, rels = _parts(spark, sf_dir)
    return adv.scores(adv.all_advisories(tables, keyed, rels), keyed, rels)


@query("adv_stats", f'WITH {BY_NAME} SELECT (SELECT count(DISTINCT "table") FROM keyed) AS tables, (SELECT count(*) FROM keyed) AS columns, (SELECT count(*) FROM by_name) AS relationships')
def _(spark, sf_dir):
    _, keyed, rels = _parts(spark, sf_dir)
    return adv.stats(keyed, rels)
