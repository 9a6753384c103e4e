"""Constraint checks: which rows would make a constraint fail. Each returns rows or counts, never raises on bad data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types a key may refer to, by base name; every type may refer to itself.
COMPATIBLE = {
    "smallint": ["integer", "bigint"],
    "integer": ["bigint", "serial"],
    "bigint": ["bigserial"],
    "serial": ["integer", "bigint"],
    "bigserial": ["bigint"],
    "numeric": ["decimal"],
    "decimal": ["numeric"],
    "text": ["varchar"],
    "varchar": ["text"],
    "timestamp": ["timestamptz"],
    "timestamptz": ["timestamp"],
}
#: Changes of type that every value survives.
WIDENING = {("integer", "bigint"), ("smallint", "integer"), ("smallint", "bigint"), ("varchar", "text"), ("char", "text"), ("char", "varchar"), ("real", "double precision")}
SPARK_TYPE = {"smallint": "smallint", "integer": "int", "bigint": "bigint", "real": "float", "double precision": "double", "boolean": "boolean", "timestamp": "timestamp", "timestamptz": "timestamp", "date": "date", "text": "string", "varchar": "string"}


def not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, violating_rows) for each column, in one scan."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violating_rows")) for c in columns])).alias("r")).select("r.*")


def primary_key(df: DataFrame, key: list[str]) -> DataFrame:
    """Key values that occur more than once or hold a null, with their number of rows."""
    some_null = F.lit(False)
    for c in key:
        some_null = some_null | F.col(c).isNull()
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(some_null | (F.col("n") > 1))


def unique(df: DataFrame, key: list[str], nulls_distinct: bool = True) -> DataFrame:
    """Key values that occur more than once; with nulls_distinct, rows with a null are unlike all others."""
    rows = df.dropna(subset=key) if nulls_distinct else df
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def foreign_key(df: DataFrame, columns: list[str], parent: DataFrame, referenced: list[str]) -> DataFrame:
    """Child rows whose key, without nulls, is no parent's."""
    keys = parent.select(*[F.col(r).alias(c) for r, c in zip(referenced, columns)]).distinct()
    return df.dropna(subset=columns).join(keys, columns, "left_anti")


def expression(df: DataFrame, check: str) -> DataFrame:
    """Rows for which the SQL expression is false; null passes."""
    return df.where(~F.coalesce(F.expr(check), F.lit(True)))


def domain(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """(value, n): values outside the list."""
    c = F.col(column)
    return df.where(c.isNotNull() & ~c.isin(*allowed)).groupBy(c.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _arguments(kind: str) -> list[int]:
    return [int(x) for x in re.findall(r"\d+", kind.partition("(")[2])]


def cast(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Rows whose value would be lost by the change of type; none for changes that only widen. A change within one type
    is checked where its length, or its digits before or behind the point, become fewer."""
    base = tuple(x.lower().split("(")[0].strip() for x in (old, new))
    had, has = _arguments(old), _arguments(new)
    value = F.col(column)
    if base[1] in ("varchar", "char") and has:
        narrower = base[0] not in ("varchar", "char") or not had or has[0] < had[0]
        return df.where(F.length(value.cast("string")) > has[0]) if narrower else df.limit(0)
    if base[0] == base[1]:
        whole = lambda x: x[0] - (x[1] if len(x) > 1 else 0)
        if not has or had and whole(has) >= whole(had) and (has[1:] or [0]) >= (had[1:] or [0]):
            return df.limit(0)
    elif base in WIDENING:
        return df.limit(0)
    target = SPARK_TYPE.get(base[1]) or (f"decimal({has[0]},{(has[1:] or [0])[0]})" if base[1] in ("numeric", "decimal") and has else new)
    became = value.try_cast(target)
    # within numbers of fixed point, rounding is a loss, too
    lost = became.isNull() | (became != value) if base[0] == base[1] and base[1] in ("numeric", "decimal") else became.isNull()
    return df.where(value.isNotNull() & lost)


def length(df: DataFrame, column: str, most: int) -> DataFrame:
    return df.where(F.length(column) > most)


def base_type(name: Column) -> Column:
    return F.lower(F.trim(F.substring_index(name, "(", 1)))


def fk_types(ends: DataFrame) -> DataFrame:
    """Ends (..., source_type, target_type) whose types do not go together."""
    s, t = base_type(F.col("source_type")), base_type(F.col("target_type"))
    ok = s == t
    for k, v in COMPATIBLE.items():
        ok = ok | ((s == k) & t.isin(*v))
    return ends.where(~ok)
