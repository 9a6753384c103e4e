"""Column profiles: one scan of each table, one aggregation of distinct (column, value) pairs for all tables.

Every cell becomes a narrow row of its column, a key and its measure (a length or a number), which is grouped by key, table
by table and before anything is shuffled, and then by column. Whole numbers, dates, times and flags share the key of all values that differ in
their last SHIFT bits alone, and are bits of a long there: dense numbers, as keys of tables are, make a row for 64 of them and
scattered ones a row each. Others, of any width, have two 64-bit hashes. Two such values of a column are taken for one if both hashes are equal (a chance of n * n / 2^129
for n distinct values). The built-in count of several distinct columns would multiply rows of all columns' width instead.

Sketches stand for the distinct values where a profile may be approximate. They are kept with the sums that the other facts
are made of, so those of new rows can be merged with those of old ones.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .loops import shuffle_partitions

TEXT_LENGTH = 255
#: Last bits of a whole number that are a place in a long instead of a part of the key.
SHIFT = 6
#: Patterns that all non-blank values of a column may fit.
PATTERNS = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "json": r"^\s*[\{\[]",
    "ip": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "money": r"^-?\d+\.\d{2}$",
}
#: Patterns that the text of a float or decimal may fit (digits, a sign, one dot, an exponent, NaN, Infinity).
NUMERIC = ("money",)
#: What a text that fits the pattern holds for certain; null for null.
HELD = {
    "uuid": lambda v: F.length(v) == 36,
    "email": lambda v: v.contains("@"),
    "json": lambda v: v.contains("{") | v.contains("["),
    "ip": lambda v: v.contains("."),
    "money": lambda v: v.contains("."),
}


def display_type(data_type: T.DataType) -> str:
    """The display type of a Spark type; strings may become TEXT once their mean length is known."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INT"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "FLOAT"
    if isinstance(data_type, T.BooleanType):
        return "BOOLEAN"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    if isinstance(data_type, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "INTERVAL"
    return "BINARY" if isinstance(data_type, T.BinaryType) else "VARCHAR"


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def stacked(df: DataFrame, cells: list[dict[str, Column]]) -> DataFrame:
    """A row for every row of df and each of cells, which give the same names a value each. UNPIVOT writes such rows as they
    are; to explode an array of structs makes an object of every value first."""
    names = list(cells[0])
    wide = df.select(*[value.alias(f"{n}_{i}") for i, c in enumerate(cells) for n, value in c.items()])
    sets = ", ".join("(" + ", ".join(f"{n}_{i}" for n in names) + ")" for i in range(len(cells)))
    return df.sparkSession.sql(f"SELECT {', '.join(names)} FROM {{wide}} UNPIVOT INCLUDE NULLS (({', '.join(names)}) FOR cell IN ({sets}))", wide=wide)


def unpivoted(df: DataFrame, names: list[str]) -> DataFrame:
    """(ordinal, value): every cell of the named columns as a string, nulls left out."""
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(names)])
    return df.select(F.explode(cells).alias("c")).select("c.ordinal", "c.value").where("value is not null")


def columns(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, ordinal) of every column, from the schemas alone: nothing is scanned."""
    rows = [(t, c, i) for t, df in tables.items() for i, c in enumerate(df.columns)]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table string, column string, ordinal int")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def _key(name: str, kind: T.DataType) -> tuple[Column, Column | None]:
    """(k1, k2): a cell's value as a long and no k2, or two hashes of it; k1 is null for nulls alone. Maps, which have no
    hash, count by their text."""
    value = F.col(f"`{name}`")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return value.cast("long"), None
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long"), None
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value), None
    shown = value.cast("string") if _has_map(kind) else value
    return F.when(value.isNotNull(), F.xxhash64(shown)), F.xxhash64(F.lit("salt"), shown)


def _measures(field: T.StructField) -> tuple[Column, Column]:
    """(length of a string, value of a number) of a cell, null for cells that have none."""
    value, none = F.col(f"`{field.name}`"), F.lit(None)
    length = F.length(value).cast("long") if isinstance(field.dataType, T.StringType) else none.cast("long")
    return length, value.cast("double") if display_type(field.dataType) in ("INT", "FLOAT") else none.cast("double")


def _cells(place: int, df: DataFrame) -> DataFrame:
    """(place, ordinal, k1, k2, bits, measure): a row for every cell; bits are the values it has under its key."""
    cells, one, last = [], F.lit(1).cast("long"), F.lit((1 << SHIFT) - 1).cast("long")
    for i, f in enumerate(df.schema.fields):
        (k1, k2), (length, number) = _key(f.name, f.dataType), _measures(f)
        bits = one if k2 is not None else F.call_function("shiftleft", one, k1.bitwiseAND(last).cast("int"))
        k1, k2 = (k1, k2) if k2 is not None else (F.shiftright(k1, SHIFT), F.lit(0).cast("long"))
        measure = length.cast("double") if isinstance(f.dataType, T.StringType) else number
        cells.append({"ordinal": F.lit(i), "k1": k1, "k2": k2, "bits": bits, "measure": measure})
    return stacked(df, cells).select(F.lit(place).alias("place"), "*")


def _keys(place: int, df: DataFrame) -> DataFrame:
    """(place, ordinal, k1, held, bits, len, low, high): a row for every key of a column, held by so many rows; len is the
    length of a string, low and high are the least and largest number."""
    texts = [isinstance(f.dataType, T.StringType) for f in df.schema.fields]
    is_text = F.element_at(F.array(*map(F.lit, texts)), F.col("ordinal") + 1)
    keys = _cells(place, df).groupBy("ordinal", "k1", "k2").agg(F.count(F.lit(1)).alias("held"), F.bit_or("bits").alias("bits"), F.min("measure").alias("low"), F.max("measure").alias("high"))
    return keys.select(
        F.lit(place).alias("place"), "ordinal", "k1", "held", "bits", F.when(is_text, F.col("high").cast("long")).alias("len"), F.when(~is_text, F.col("low")).alias("low"), F.when(~is_text, F.col("high")).alias("high")
    )


def _names(tables: dict[str, DataFrame]) -> DataFrame:
    """(place, ordinal, table, column, kind, text): what the schemas say of every column."""
    rows = [(i, j, name, f.name, display_type(f.dataType), isinstance(f.dataType, T.StringType)) for i, (name, df) in enumerate(tables.items()) for j, f in enumerate(df.schema.fields)]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "place int, ordinal int, table string, column string, kind string, text boolean")


def _facts(sums: DataFrame) -> DataFrame:
    """The profile from (table, column, ordinal, kind, text, n, total_count, chars, max_len, min_num, max_num, unique_count),
    a row a column."""
    zero = F.lit(0).cast("long")
    n, total = F.coalesce("n", zero), F.coalesce("total_count", zero)
    avg = F.when(F.col("text") & (total > 0), F.col("chars").cast("double") / total)
    kind = F.when(F.col("text"), F.when(avg > TEXT_LENGTH, "TEXT").otherwise("VARCHAR")).otherwise(F.col("kind"))
    return sums.select(
        "table", "column", "ordinal", kind.alias("type"), (total < n).alias("nullable"), F.coalesce("unique_count", zero).alias("unique_count"), total.alias("total_count"), n.alias("row_count"),
        F.round(F.when(n == 0, 0.0).otherwise((n - total) / n), 3).alias("null_ratio"), avg.alias("avg_len"), "max_len", "min_num", "max_num",
    )


def profile(tables: dict[str, DataFrame], approx: bool = False, rsd: float = 0.02, dealt: bool = False) -> DataFrame:
    """One row per column of every table, from one scan of each table; approx counts distinct values by sketches. With
    dealt, rows are dealt to all shuffle partitions before they become cells: for tables of many columns in few files, of
    which a task would else hold the distinct values of all rows of a file.

    Columns of empty tables have zeros, and nulls where there is nothing to measure.
    """
    if approx:
        return from_sketches(sketches(tables, rsd))
    rows = {n: df.repartition(shuffle_partitions(df.sparkSession)) if dealt else df for n, df in tables.items()}
    keys = union([_keys(i, df) for i, df in enumerate(rows.values()) if df.columns])
    known = F.col("k1").isNotNull()
    sums = keys.groupBy("place", "ordinal").agg(
        F.sum("held").alias("n"), F.sum(F.when(known, F.col("held"))).alias("total_count"), F.sum(F.when(known, F.bit_count("bits").cast("long"))).alias("unique_count"), F.sum(F.col("held") * F.col("len")).alias("chars"),
        F.max("len").alias("max_len"), F.min("low").alias("min_num"), F.max("high").alias("max_num"),
    )
    return _facts(_names(tables).join(sums, ["place", "ordinal"], "left"))


SUMS = {"n": F.sum, "total_count": F.sum, "chars": F.sum, "max_len": F.max, "min_num": F.min, "max_num": F.max}


def sketches(tables: dict[str, DataFrame], rsd: float = 0.02) -> DataFrame:
    """(table, column, ordinal, kind, text, n, total_count, chars, max_len, min_num, max_num, sketch): a row a column, to be
    stored and merged with those of other rows of the table. rsd: the standard error that merged sketches keep."""
    size = min(21, max(4, math.ceil(2 * math.log2(1.04 / rsd))))
    parts = []
    for place, df in enumerate(tables.values()):
        aggregates, rows = [F.count(F.lit(1)).alias("n")], []
        for i, f in enumerate(df.schema.fields):
            value, (length, number), key = F.col(f"`{f.name}`"), _measures(f), _key(f.name, f.dataType)[0]
            made = {"total_count": F.count(value), "chars": F.sum(length), "max_len": F.max(length), "min_num": F.min(number), "max_num": F.max(number), "sketch": F.hll_sketch_agg(key, F.lit(size))}
            aggregates += [v.alias(f"{k}{i}") for k, v in made.items()]
            rows.append(F.struct(F.lit(i).alias("ordinal"), *[F.col(f"{k}{i}").alias(k) for k in made]))
        if rows:
            parts.append(df.agg(*aggregates).select(F.lit(place).alias("place"), "n", F.explode(F.array(*rows)).alias("r")).select("place", "n", "r.*"))
    return _names(tables).join(union(parts), ["place", "ordinal"]).drop("place")


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """Sketches of tables' rows as a whole from sketches of parts of the rows, whatever their number."""
    whole = [f(k).alias(k) for k, f in SUMS.items()]
    return union(list(parts)).groupBy("table", "column", "ordinal", "kind", "text").agg(*whole, F.hll_union_agg("sketch").alias("sketch"))


def from_sketches(parts: DataFrame) -> DataFrame:
    """The profile that sketches stand for; the number of distinct values is an estimate, at most that of values."""
    return _facts(parts.withColumn("unique_count", F.least(F.hll_sketch_estimate("sketch"), "total_count")))


def settled(facts: DataFrame) -> DataFrame:
    """Facts with one row a column, computed now and held by the driver, so that what is derived from them (keys, names,
    advisories) neither scans the tables again nor drags their plans along. Never for rows of data."""
    return facts.sparkSession.createDataFrame(facts.collect(), facts.schema)


def sample_values(df: DataFrame, name: str, n: int) -> DataFrame:
    """(value): the first n distinct non-null values of a column in their own order, as strings."""
    column = F.col(f"`{name}`")
    return df.where(column.isNotNull()).select(column.alias("v")).distinct().orderBy("v").limit(n).select(F.col("v").cast("string").alias("value"))


def enum_values(tables: dict[str, DataFrame], chosen: DataFrame, most: int = 15) -> DataFrame:
    """(table, column, values): the sorted distinct values of the chosen (table, column) rows of a profile, which are
    few (one row a column) and have at most `most` values each."""
    wanted: dict[str, list[str]] = {}
    for r in chosen.select("table", "column").collect():
        wanted.setdefault(r["table"], []).append(r["column"])
    parts = []
    for name, columns in wanted.items():
        columns = sorted(columns)
        labels = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("ordinal") + 1)
        distinct = stacked(tables[name], [{"ordinal": F.lit(i), "value": F.col(f"`{c}`").cast("string")} for i, c in enumerate(columns)]).distinct().where("value is not null")
        # a list of what is distinct: under a set the optimizer drops the distinct, and every row would reach the set
        parts.append(distinct.groupBy("ordinal").agg(F.array_sort(F.collect_list("value")).alias("values")).where(F.size("values") <= most).select(F.lit(name).alias("table"), labels.alias("column"), "values"))
    return union(parts) if parts else chosen.select("table", "column", F.array().cast("array<string>").alias("values")).limit(0)


def _may_be_money(value: Column, kind: T.DataType) -> Column:
    """What a number whose text has two decimals holds for certain. A double's text ends in no 0 behind a first decimal, so
    ten times the number is not whole; a decimal's has as many decimals as its type."""
    if isinstance(kind, T.DecimalType):
        return F.lit(kind.scale == 2)
    tenfold = value.cast("double") * 10
    return tenfold != F.rint(tenfold)


def pattern_fit(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, one boolean a pattern, longest): whether all non-blank values fit it, for string and float columns, and
    the length of the longest string without blanks around. What every hit of a pattern holds is looked for first: a number
    becomes text only where it may be a hit."""
    parts = []
    for name, df in tables.items():
        fields = [f for f in df.schema.fields if display_type(f.dataType) in ("VARCHAR", "FLOAT") and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        if not fields:
            continue
        aggregates, rows = [], []
        for i, f in enumerate(fields):
            value, number = F.col(f"`{f.name}`"), display_type(f.dataType) == "FLOAT"
            if number:
                fits, longest = {k: F.when(value.isNotNull(), _may_be_money(value, f.dataType) & value.cast("string").rlike(PATTERNS[k])) for k in NUMERIC}, F.lit(None)
            else:
                value = F.trim(value.cast("string"))
                value = F.when(value != "", value)
                fits, longest = {k: HELD[k](value) & value.rlike(p) for k, p in PATTERNS.items()}, F.max(F.length(value))
            aggregates += [(F.coalesce(F.every(fits[k]), F.lit(False)) if k in fits else F.lit(False)).alias(f"{k}{i}") for k in PATTERNS]
            aggregates.append(longest.cast("long").alias(f"longest{i}"))
            rows.append(F.struct(F.lit(f.name).alias("column"), *[F.col(f"{k}{i}").alias(k) for k in PATTERNS], F.col(f"longest{i}").alias("longest")))
        parts.append(df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select(F.lit(name).alias("table"), "r.*"))
    return union(parts)


def suggest_type(facts: DataFrame, fit: DataFrame, enums: bool = True) -> DataFrame:
    """(table, column, target_type, nullable, identity, confidence, reason) from a profile and its pattern fit, over all
    rows. Without `enums`, strings with few values get a type by their length as others do."""
    p = facts.join(fit, ["table", "column"], "left")
    name, kind, longest = F.lower("column"), F.col("type"), F.coalesce("longest", F.lit(0))
    unique = (F.col("unique_count") == F.col("total_count")) & (F.col("total_count") > 0)
    key = (kind == "INT") & ((name == "id") | name.endswith("_id")) & unique & ~F.col("nullable")
    few = F.lit(enums) & (F.col("unique_count") <= 20) & (F.col("total_count") > 10)
    big = (F.col("max_num") > 2147483647) | (F.col("min_num") < -2147483648)
    rules = [
        (key, "bigint", "high", "unique non-null key"),
        ((kind == "INT") & big, "bigint", "medium", "beyond the integer range"),
        ((kind == "INT") & (F.col("max_num") < 32768) & (F.col("min_num") > -32768), "smallint", "medium", "within the smallint range"),
        (kind == "INT", "integer", "medium", "integer"),
        ((kind == "FLOAT") & F.col("money"), "numeric(15,2)", "high", "two decimals throughout"),
        (kind == "FLOAT", "double precision", "medium", "floating point"),
        (kind == "TEXT", "text", "medium", "long text"),
        ((kind == "VARCHAR") & F.col("uuid"), "uuid", "high", "uuid pattern"),
        ((kind == "VARCHAR") & F.col("email"), "varchar(320)", "high", "email pattern"),
        ((kind == "VARCHAR") & F.col("json"), "jsonb", "medium", "json pattern"),
        ((kind == "VARCHAR") & F.col("ip"), "inet", "medium", "address pattern"),
        ((kind == "VARCHAR") & few, "enum", "medium", "few distinct values"),
        ((kind == "VARCHAR") & longest.between(1, 50), "varchar(50)", "medium", "length"),
        ((kind == "VARCHAR") & longest.between(51, 255), "varchar(255)", "medium", "length"),
        (kind == "BOOLEAN", "boolean", "high", "direct"),
        (kind == "TIMESTAMP", "timestamptz", "high", "direct"),
        (kind == "UUID", "uuid", "high", "direct"),
        (kind == "BINARY", "bytea", "high", "direct"),
    ]
    chosen = F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.struct(*map(F.lit, out))) for test, *out in rules], F.struct(F.lit("text"), F.lit("medium"), F.lit("no values to go by")))
    return p.withColumn("chosen", chosen).select(
        "table", "column", F.col("chosen.col1").alias("target_type"), "nullable", F.when(key, "ALWAYS").alias("identity"), F.col("chosen.col2").alias("confidence"), F.col("chosen.col3").alias("reason")
    )
