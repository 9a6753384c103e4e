"""Migrations as selects: column transforms, mapped tables, conformed tables, and what differs between datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import union

UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
#: Transform names and the type each casts to.
CASTS = {"CAST_INT": "int", "CAST_BIGINT": "bigint", "CAST_BOOLEAN": "boolean", "CAST_TIMESTAMP": "timestamp", "CAST_NUMERIC": "decimal(15,2)"}


def transform(column: Column, name: str | None) -> Column:
    """A column transform by name; values that a cast cannot take become null; unknown names pass the column through.
    JSON stays text, as null where it is none, and so does UUID."""
    name = (name or "").upper()
    if name in CASTS:
        return column.try_cast(CASTS[name])
    if name == "CAST_UUID":
        return F.when(column.rlike(UUID), F.lower(column))
    if name == "CAST_JSONB":
        return F.when(F.try_parse_json(column).isNotNull(), column)
    simple = {"LOWER": F.lower, "UPPER": F.upper, "TRIM": F.trim, "NULLIF_EMPTY": lambda c: F.nullif(F.trim(c), F.lit(""))}
    return simple[name](column) if name in simple else column


def migrate_select(tables: dict[str, DataFrame], mapping: dict[str, dict]) -> dict[str, DataFrame]:
    """Target tables from a mapping "table.column" -> {sourceTable, sourceColumn, transform}: one select for each source of
    a target, put together by name. Entries without a source, or with one that is not loaded, are skipped."""
    plan: dict[tuple[str, str], list[Column]] = {}
    for target, spec in mapping.items():
        table, _, column = target.partition(".")
        source, name = spec.get("sourceTable"), spec.get("sourceColumn")
        if table and column and source in tables and name in tables[source].columns:
            plan.setdefault((table, source), []).append(transform(F.col(f"`{name}`"), spec.get("transform")).alias(column))
    out: dict[str, DataFrame] = {}
    for (table, source), columns in plan.items():
        rows = tables[source].select(*columns)
        out[table] = rows if table not in out else out[table].unionByName(rows, allowMissingColumns=True)
    return out


def conform_table(df: DataFrame, changes: list[dict]) -> DataFrame:
    """df after the changes, in one select. Each change is {"op": add | drop | type | default | not_null | rename |
    generated, "column": ..., and "type", "value", "to" or "expr"}; a default fills nulls, not_null keeps rows that have a
    value."""
    columns = {c: F.col(f"`{c}`") for c in df.columns}
    required = []
    for change in changes:
        op, name = change["op"], change["column"]
        if op == "add":
            columns[name] = F.lit(change.get("value")).cast(change["type"])
        elif op == "generated":
            columns[name] = F.expr(change["expr"])
        elif op == "drop":
            columns.pop(name)
        elif op == "type":
            columns[name] = columns[name].try_cast(change["type"])
        elif op == "default":
            columns[name] = F.coalesce(columns[name], F.lit(change["value"]))
        elif op == "rename":
            columns = {change["to"] if k == name else k: v for k, v in columns.items()}
        elif op == "not_null":
            required.append(name)
    out = df.select(*[v.alias(k) for k, v in columns.items()])
    return out.dropna(subset=required) if required else out


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table, column, change, old_type, new_type) from two profiles: added, dropped, or changed type or nullability."""
    a = old.select("table", "column", F.col("type").alias("old_type"), F.col("nullable").alias("old_null"), F.lit(True).alias("in_old"))
    b = new.select("table", "column", F.col("type").alias("new_type"), F.col("nullable").alias("new_null"), F.lit(True).alias("in_new"))
    met = a.join(b, ["table", "column"], "full")
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "dropped").when(F.col("old_type") != F.col("new_type"), "type").when(F.col("old_null") != F.col("new_null"), "nullable")
    return met.select("table", "column", kind.alias("change"), "old_type", "new_type").where("change is not null")


def domain_diff(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """(value, change): values of a column that are in one dataset only."""
    a, b = (df.select(F.col(column).cast("string").alias("value")).dropna().distinct() for df in (old, new))
    return union([b.subtract(a).withColumn("change", F.lit("added")), a.subtract(b).withColumn("change", F.lit("removed"))])
