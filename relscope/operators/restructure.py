"""Restructurings driven by the data: flags as rows, and rewritten tables."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constraints
from .keys import pk_surrogate
from .profile import union

#: The names of label columns.
LABELS = ["name", "label", "title", "value", "description"]
#: Names of attribute and value columns.
ATTRIBUTES = ["attribute_name", "attr_name", "key", "attribute", "property"]
VALUES = ["attribute_value", "attr_value", "value", "val"]
#: Endings of plurals in -es, and endings whose s is the noun's own.
ES_PLURALS = ("ses", "xes", "zes", "ches", "shes")
OWN_S = ("ss", "us", "is")
CASTS = {"smallint": "smallint", "integer": "int", "bigint": "bigint", "double precision": "double", "numeric(15,2)": "decimal(15,2)", "boolean": "boolean", "timestamptz": "timestamp", "bytea": "binary"}


def orphan_tables(profile: DataFrame, rels: DataFrame) -> DataFrame:
    """(table, row_count, column_count) of tables that no relationship touches."""
    ends = rels.select(F.col("source_table").alias("table")).union(rels.select("target_table")).distinct()
    sizes = profile.groupBy("table").agg(F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count"))
    return sizes.join(ends, "table", "left_anti")


def type_downsize(profile: DataFrame, declared: DataFrame | None = None, integers: tuple[str, ...] = ("smallint", "integer")) -> DataFrame:
    """(table, column, old_type, new_type): integers that fit one of the smaller types `integers`, and texts that a shorter
    varchar holds. The old types are declared (table, column, target_type); without them integers are bigint and strings
    text."""
    own = F.when(F.col("type") == "INT", "bigint").when(F.col("type").isin("VARCHAR", "TEXT"), "text")
    p = profile.withColumn("old_type", own) if declared is None else profile.join(declared.select("table", "column", F.col("target_type").alias("old_type")), ["table", "column"])
    old = F.col("old_type")
    small = (F.col("min_num") >= -32768) & (F.col("max_num") <= 32767)
    middle = (F.col("min_num") >= -2147483648) & (F.col("max_num") <= 2147483647)
    number = F.when(old.isin("bigint", "integer") & small, "smallint").when((old == "bigint") & middle, "integer")
    number = F.when(number.isin(*integers), number)
    size = F.greatest(F.lit(4), F.floor(F.col("max_len") * 1.5).cast("int"))
    had = F.when(old == "text", 10000).otherwise(F.regexp_extract(old, r"^varchar\((\d+)\)$", 1).try_cast("int"))
    text = F.when((F.col("max_len") > 0) & (size < had), F.concat(F.lit("varchar("), size.cast("string"), F.lit(")")))
    return p.select("table", "column", "old_type", F.coalesce(number, text).alias("new_type")).where("new_type is not null")


def apply_downsize(df: DataFrame, changes: dict[str, str]) -> DataFrame:
    """df with the columns of changes (column -> new type) cast; a varchar stays a string, as its length is a check."""
    return df.select(*[F.col(f"`{c}`").cast(CASTS[changes[c]]).alias(c) if changes.get(c) in CASTS else F.col(f"`{c}`") for c in df.columns])


def strict_nulls(keyed: DataFrame) -> DataFrame:
    """(table, column): columns besides primary keys in which no null was seen, of tables with rows."""
    return keyed.where("not nullable and row_count > 0 and coalesce(key_type, '') <> 'PK'").select("table", "column")


def apply_strict(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the named columns not nullable in its schema; a null in one of them is an error when rows are read."""
    filler = {"string": "", "binary": b"", "boolean": False, "date": date(1970, 1, 1)}

    def strict(field):
        kind = field.dataType.simpleString()
        simple = not isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
        value = F.coalesce(F.col(f"`{field.name}`"), F.raise_error(F.lit(f"null in {field.name}")).cast(field.dataType))
        last = F.lit(filler.get(kind, datetime(1970, 1, 1) if kind.startswith("timestamp") else 0)).cast(field.dataType) if simple else None
        return (F.coalesce(value, last) if simple else value).alias(field.name)

    return df.select(*[strict(f) if f.name in names else F.col(f"`{f.name}`") for f in df.schema.fields])


def enum_discovery(keyed: DataFrame) -> DataFrame:
    """(table, column, unique_count) of text columns with few values."""
    return keyed.where("type in ('VARCHAR', 'TEXT') and total_count >= 10 and unique_count between 1 and 15 and unique_count < total_count and coalesce(key_type, '') <> 'PK'").select("table", "column", "unique_count")


def encode_enum(df: DataFrame, column: str) -> DataFrame:
    """df with `<column>_code`, the place of the value among the sorted distinct values. Distinct values are counted
    first: a few, as discovered enums have, are ranked at once and broadcast; others are ranked by ranges and met in a
    shuffle."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{column}`").alias("v"))
    values = rows.select("v").dropna().distinct()
    if values.count() <= 1000:
        codes = F.broadcast(values.withColumn("code", F.row_number().over(Window.orderBy("v"))))
    else:
        codes = pk_surrogate(values, "code", ["v"])
    return rows.join(codes, "v", "left").select("row.*", F.col("code").alias(f"{column}_code"))


def dead_columns(keyed: DataFrame) -> DataFrame:
    """(table, column, kind): all null, or one constant without nulls, in tables of five rows or more."""
    kind = F.when(F.col("total_count") == 0, "all_null").when((F.col("unique_count") == 1) & ~F.col("nullable"), "constant")
    return keyed.where("row_count >= 5 and coalesce(key_type, '') <> 'PK'").select("table", "column", kind.alias("kind")).where("kind is not null")


def junction_unique_side(junction: DataFrame, left: str, right: str) -> DataFrame:
    """(left_unique, right_unique, row_count) of a junction table with two keys."""
    sides = [junction.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias(f"{s}_unique"), F.coalesce(F.sum("n"), F.lit(0)).alias("row_count")) for s, c in (("left", left), ("right", right))]
    return sides[0].join(sides[1].drop("row_count"))


def mn_candidates(tables: dict[str, DataFrame], keyed: DataFrame) -> DataFrame:
    """(table, left_column, right_column, left_unique, right_unique, row_count): junction tables of exactly two foreign keys
    and at most one other column; one that is unique on a side is no many-to-many relationship."""
    kind = F.coalesce("key_type", F.lit(""))
    shapes = keyed.groupBy("table").agg(F.sort_array(F.collect_list(F.when(kind == "FK", F.struct("ordinal", "column")))).alias("fks"), F.count_if(~kind.isin("FK", "PK")).alias("others"))
    parts = []
    for r in shapes.where("size(fks) = 2 and others <= 1").collect():
        left, right = (x["column"] for x in r["fks"])
        sides = junction_unique_side(tables[r["table"]], left, right)
        parts.append(sides.select(F.lit(r["table"]).alias("table"), F.lit(left).alias("left_column"), F.lit(right).alias("right_column"), "left_unique", "right_unique", "row_count"))
    none = "table string, left_column string, right_column string, left_unique boolean, right_unique boolean, row_count long"
    return union(parts) if parts else keyed.sparkSession.createDataFrame([], none)


def mn_downgrade(parent: DataFrame, parent_key: str, junction: DataFrame, own: str, other: str) -> DataFrame:
    """The parent with the other side's key, from a junction in which own is unique."""
    one = junction.groupBy(F.col(own).alias("own__")).agg(F.first(other).alias(other))
    return parent.join(one, F.col(parent_key) == F.col("own__"), "left").drop("own__")


def lookup_candidates(keyed: DataFrame, rels: DataFrame) -> DataFrame:
    """(table, key, label, consumer, consumer_column): tables of a key and a label column that one column of one other
    table refers to and that refer to none."""
    is_pk = F.coalesce("key_type", F.lit("")) == "PK"
    shapes = keyed.groupBy("table").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_pk).alias("keys"), F.max(F.when(is_pk, F.col("column"))).alias("key"), F.max(F.when(~is_pk, F.col("column"))).alias("label")
    )
    thin = shapes.where("n = 2 and keys = 1").where(F.lower("label").isin(*LABELS))
    inbound = rels.groupBy(F.col("target_table").alias("table")).agg(F.count(F.lit(1)).alias("n_in"), F.first("source_table").alias("consumer"), F.first("source_column").alias("consumer_column")).where("n_in = 1")
    return thin.join(inbound, "table").join(rels.select(F.col("source_table").alias("table")).distinct(), "table", "left_anti").select("table", "key", "label", "consumer", "consumer_column")


def inline_lookup(consumer: DataFrame, column: str, lookup: DataFrame, key: str, label: str, name: str) -> DataFrame:
    """The consumer with `<name>_<label>` in place of its key into a two-column lookup table."""
    pairs = lookup.select(F.col(key).alias("key__"), F.col(label).alias(f"{name}_{label}"))
    small = pairs.count() <= 100_000
    return consumer.join(F.broadcast(pairs) if small else pairs, F.col(column) == F.col("key__"), "left").drop("key__", column)


def same_keys(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(child_unique, sets_equal): whether a child merges one to one with its parent."""
    a = child.groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("k is not null")
    b = parent.select(F.col(key).alias("k")).where("k is not null").distinct().withColumn("there", F.lit(1))
    return a.join(b, "k", "full").agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias("child_unique"), F.every(F.col("n").isNotNull() & F.col("there").isNotNull()).alias("sets_equal"))


def merge_one_to_one(parent: DataFrame, key: str, child: DataFrame, column: str) -> DataFrame:
    """The parent with the child's other columns."""
    extra = child.select(F.col(column).alias("key__"), *[c for c in child.columns if c != column])
    return parent.join(extra, F.col(key) == F.col("key__")).drop("key__")


def eav_candidates(keyed: DataFrame, rels: DataFrame) -> DataFrame:
    """(table, entity, attribute, value): tables with an attribute and a value column and a foreign key to the entity."""
    low = F.lower("column")
    attribute, value = F.when(low.isin(*ATTRIBUTES), F.col("column")), F.when(low.isin(*VALUES), F.col("column"))
    shapes = keyed.groupBy("table").agg(F.min(attribute).alias("attribute"), F.min(value).alias("value")).where("attribute is not null and value is not null")
    fks = rels.groupBy(F.col("source_table").alias("table")).agg(F.min("source_column").alias("entity"))
    return shapes.join(fks, "table").select("table", "entity", "attribute", "value")


def eav_collapse(df: DataFrame, entity: str, attribute: str, value: str, wanted: list[str]) -> DataFrame:
    """One row an entity, a column for each wanted attribute. Of several values of one attribute the largest stays and the
    others are dropped; eav_maps() keeps all."""
    return df.groupBy(entity).agg(*[F.max(F.when(F.col(attribute) == a, F.col(value))).alias(a) for a in wanted])


def eav_maps(df: DataFrame, entity: str, attribute: str, value: str) -> DataFrame:
    """(entity, attributes): one map an entity from each attribute found in its rows to its distinct values in order, as
    text. Null values leave their attribute with an empty array; rows without an attribute are left out."""
    rows = df.where(F.col(f"`{attribute}`").isNotNull()).select(F.col(f"`{entity}`").alias("e"), F.col(f"`{attribute}`").cast("string").alias("a"), F.col(f"`{value}`").cast("string").alias("v"))
    each = rows.groupBy("e", "a").agg(F.array_sort(F.collect_set("v")).alias("v"))
    made = each.groupBy("e").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("a", "v")))).alias("attributes"))
    return made.select(F.col("e").alias(entity), "attributes")


def vertical_split(df: DataFrame, key: list[str], profile: DataFrame, least: int = 50, sparse: int = 40, ratio: float = 0.9) -> tuple[DataFrame, DataFrame | None]:
    """(dense, side): sparse columns of a wide table move to a side table of the rows that have any of them."""
    names = [r["column"] for r in profile.where(F.col("null_ratio") > ratio).select("column").collect()]
    names = [c for c in df.columns if c in names and c not in key]
    if len(df.columns) < least or len(names) < sparse:
        return df, None
    return df.drop(*names), df.select(*key, *names).dropna(how="all", subset=names)


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str, shown: int = 5) -> DataFrame:
    """(dangling, samples): distinct values of a key that no parent has, their number and the first ones."""
    lost = child.select(F.col(column).alias("v")).dropna().distinct().join(parent.select(F.col(key).alias("v")).distinct(), "v", "left_anti")
    first = lost.orderBy("v").limit(shown).agg(F.array_join(F.array_sort(F.collect_list("v")).cast("array<string>"), "|").alias("samples"))
    return lost.agg(F.count(F.lit(1)).alias("dangling")).join(first)


def soft_delete(df: DataFrame, key: list[str], column: str = "deleted_at") -> DataFrame:
    """(deleted_rows, surplus_rows): rows marked deleted, and rows beyond the first of each key, deleted ones included."""
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("d"))
    return per.agg(F.sum("d").alias("deleted_rows"), F.sum(F.col("n") - 1).alias("surplus_rows"))


def purge(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.where(F.col(column).isNull())


def snake_case(name: str) -> str:
    """A name in lower case with underscores between its words."""
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)
    return re.sub(r"[\s\-._]+", "_", words).strip("_").lower()


def singular_word(word: str) -> str:
    """A noun's singular: -ies becomes -y, the plurals in ES_PLURALS lose -es, other words lose their s unless it is part
    of the noun. Words of up to three letters stay."""
    if len(word) <= 3 or not word.endswith("s"):
        return word
    if word.endswith("ies") and len(word) > 4:
        return word[: -len("ies")] + "y"
    if word.endswith(ES_PLURALS):
        return word[: -len("es")]
    return word if word.endswith(OWN_S) else word[: -len("s")]


def table_name(name: str) -> str:
    head, _, last = snake_case(name).rpartition("_")
    return f"{head}_{singular_word(last)}" if head else singular_word(last)


def distinct_names(names: list[str]) -> list[str]:
    """The names in order, repeats numbered _2, _3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def normalize_names(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables with singular snake-case names and snake-case columns."""
    names = distinct_names([table_name(t) for t in tables])
    return {n: df.toDF(*distinct_names([snake_case(c) for c in df.columns])) for n, df in zip(names, tables.values())}


def rebuild_columns(tables: dict[str, DataFrame], keyed: DataFrame, types: DataFrame) -> DataFrame:
    """(table, column, new_table, new_column, target_type, not_null, is_pk, is_unique, confidence, reason) of every column.
    Text columns with few values become enums named after table and column; other types are the suggested ones."""
    renamed = normalize_names(tables)
    names = [(t, c, n, m) for (t, df), (n, new) in zip(tables.items(), renamed.items()) for c, m in zip(df.columns, new.columns)]
    named = keyed.sparkSession.createDataFrame(names, "table string, column string, new_table string, new_column string")
    kind = F.coalesce("key_type", F.lit(""))
    enum = ~kind.isin("PK", "FK") & F.col("type").isin("VARCHAR", "TEXT", "ENUM") & (F.col("total_count") >= 10) & F.col("unique_count").between(1, 15) & (F.col("unique_count") < F.col("total_count"))
    met = keyed.join(types.drop("nullable"), ["table", "column"], "left").join(named, ["table", "column"])
    return met.select(
        "table", "column", "ordinal", "new_table", "new_column", F.when(enum, F.substring(F.concat_ws("_", "new_table", "new_column", F.lit("enum")), 1, 63)).otherwise(F.coalesce("target_type", F.lit("text"))).alias("target_type"),
        ((F.col("total_count") == F.col("row_count")) & (F.col("row_count") > 0)).alias("not_null"), (kind == "PK").alias("is_pk"), (kind == "UQ").alias("is_unique"), enum.alias("is_enum"),
        F.when(enum, "high").otherwise(F.col("confidence")).alias("confidence"), F.when(enum, "few distinct values").otherwise(F.col("reason")).alias("reason"),
    )


def _surrogate(table: str, names: list[str]) -> str:
    return f"{table}_id" if f"{table}_id" not in names else f"{table}_pk"


def _foreign_keys(rels: DataFrame) -> DataFrame:
    """Relationships once for each source column and target table, the first by target column."""
    first = F.row_number().over(Window.partitionBy("source_table", "source_column", "target_table").orderBy("target_column"))
    return rels.withColumn("rank", first).where("rank = 1").drop("rank")


def rebuild_tables(tables: dict[str, DataFrame], plan: DataFrame, rels: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rebuilt tables, and their constraints (table, kind, column, ref_table, ref_column).

    plan is rebuild_columns. Tables get normalised names, the planned types, columns that are not nullable where no null
    was seen, and a surrogate key where none was found. Constraints are pk, unique, not_null, enum and fk. Texts and
    enums stay strings; lengths and domains are for the checks (see rebuild_violations).
    """
    rows = {}
    for r in plan.orderBy("table", "ordinal").collect():  # one row a column
        rows.setdefault(r["table"], []).append(r)
    out, found = {}, []
    for old, df in tables.items():
        own = rows[old]
        new = own[0]["new_table"]
        typed = df.select(*[F.col(f"`{r['column']}`").cast(CASTS.get(r["target_type"], "string")).alias(r["new_column"]) for r in own])
        strict, keys = [r["new_column"] for r in own if r["not_null"]], [r["new_column"] for r in own if r["is_pk"]]
        if not keys:
            keys = [_surrogate(new, typed.columns)]
            typed, strict = pk_surrogate(typed, keys[0]), [*keys, *strict]
        out[new] = apply_strict(typed, strict)
        found.append((new, "pk", ",".join(keys), None, None))
        for kind, test in (("not_null", "not_null"), ("unique", "is_unique"), ("enum", "is_enum")):
            found += [(new, kind, r["new_column"], None, None) for r in own if r[test]]
    place = {(r["table"], r["column"]): (r["new_table"], r["new_column"]) for own in rows.values() for r in own}
    for r in _foreign_keys(rels).collect():  # one row a relationship
        source, target = place.get((r["source_table"], r["source_column"])), place.get((r["target_table"], r["target_column"]))
        if source and target:
            found.append((source[0], "fk", source[1], *target))
    return out, plan.sparkSession.createDataFrame(found, "table string, kind string, column string, ref_table string, ref_column string")


def rebuild_violations(tables: dict[str, DataFrame], rules: DataFrame, domains: dict[tuple[str, str], list[str]] | None = None) -> DataFrame:
    """(table, kind, column, violating_rows) for every constraint of rebuild_tables: keys and rows that break it. Enums are
    held against domains (table, column) -> values; one without a domain has nothing to break. Keys of two tables are
    compared as text, as a rebuild may give them two types."""
    parts = []
    for r in rules.collect():
        df, names = tables[r["table"]], r["column"].split(",")
        if r["kind"] == "pk":
            bad = constraints.primary_key(df, names)
        elif r["kind"] == "unique":
            bad = constraints.unique(df, names)
        elif r["kind"] == "not_null":
            bad = df.where(F.col(names[0]).isNull())
        elif r["kind"] == "enum":
            allowed = (domains or {}).get((r["table"], names[0]))
            bad = constraints.domain(df, names[0], allowed) if allowed is not None else df.limit(0)
        else:
            child, parent = df.select(F.col(names[0]).cast("string").alias("k")), tables[r["ref_table"]].select(F.col(r["ref_column"]).cast("string").alias("k"))
            bad = constraints.foreign_key(child, ["k"], parent, ["k"])
        parts.append(bad.agg(F.lit(r["table"]).alias("table"), F.lit(r["kind"]).alias("kind"), F.lit(r["column"]).alias("column"), F.count(F.lit(1)).alias("violating_rows")))
    return union(parts)


def rebuild_decisions(tables: dict[str, DataFrame], plan: DataFrame, rels: DataFrame, values: DataFrame) -> DataFrame:
    """(kind, table, column, detail) of a rebuild, by new names: rename, rename_column, type (with not null), enum (its
    values, from values (table, column, values)), pk (the surrogate) and fk."""
    none, t, c = F.lit(None).cast("string"), F.col("new_table").alias("table"), F.col("new_column").alias("column")
    renamed = plan.where("table <> new_table").select(F.lit("rename").alias("kind"), t, none.alias("column"), F.col("table").alias("detail")).distinct()
    columns = plan.where("column <> new_column").select(F.lit("rename_column").alias("kind"), t, c, F.col("column").alias("detail"))
    typed = plan.select(F.lit("type").alias("kind"), t, c, F.concat("target_type", F.when(F.col("not_null"), " not null").otherwise("")).alias("detail"))
    enums = plan.where("is_enum").join(values, ["table", "column"]).select(F.lit("enum").alias("kind"), t, c, F.array_join("values", "|").alias("detail"))
    keyless = plan.groupBy("new_table").agg(F.count_if("is_pk").alias("n"), F.collect_list("new_column").alias("names")).where("n = 0")
    own = F.concat("new_table", F.lit("_id"))
    surrogate = F.when(F.array_contains("names", own), F.concat("new_table", F.lit("_pk"))).otherwise(own)
    pks = keyless.select(F.lit("pk").alias("kind"), t, surrogate.alias("column"), F.lit("surrogate").alias("detail"))
    ends = plan.select(F.col("table").alias("o_t"), F.col("column").alias("o_c"), "new_table", "new_column")
    s, d = ends.alias("s"), ends.alias("d")
    met = _foreign_keys(rels).join(s, (F.col("source_table") == F.col("s.o_t")) & (F.col("source_column") == F.col("s.o_c"))).join(d, (F.col("target_table") == F.col("d.o_t")) & (F.col("target_column") == F.col("d.o_c")))
    fks = met.select(F.lit("fk").alias("kind"), F.col("s.new_table").alias("table"), F.col("s.new_column").alias("column"), F.concat_ws(".", "d.new_table", "d.new_column").alias("detail"))
    return union([renamed, columns, typed, enums, pks, fks])
