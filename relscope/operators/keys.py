"""Primary, foreign and unique keys from a profile, and surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .loops import cut, cut_round

SUFFIX = "^(.+)_(id|ref|key)$"


def singular(table: Column) -> Column:
    """The table name in lower case without any s at its end."""
    return F.regexp_replace(F.lower(table), "s+$", "")


def is_table_pk(table: Column, column: Column) -> Column:
    base = F.regexp_replace(F.lower(column), "_", "")
    return (base == F.concat(singular(table), F.lit("id"))) | (base == F.concat(F.lower(table), F.lit("id")))


def fk_base(column: Column) -> Column:
    """The name before an _id, _ref or _key, else before a last camel-case part Id, Ref or Key; null without one."""
    parts = F.regexp_replace(F.regexp_replace(column, "([a-z])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    plain, camel = F.regexp_extract(F.lower(column), SUFFIX, 1), F.regexp_extract(F.lower(parts), SUFFIX, 1)
    return F.when(plain != "", plain).when(camel != "", camel)


def fk_candidates(column: Column) -> Column:
    """Table names that a column's name may refer to; null if it does not look like a foreign key."""
    base = fk_base(column)
    stem = F.regexp_replace(base, ".$", "")
    return (
        F.when(base.endswith("s"), F.array(base, F.regexp_replace(base, "s+$", "")))
        .when(base.endswith("y"), F.array(base, F.concat(base, F.lit("s")), F.concat(stem, F.lit("ie")), F.concat(stem, F.lit("ies"))))
        .when(base.isNotNull(), F.array(base, F.concat(base, F.lit("s"))))
    )


def detect_keys(profile: DataFrame) -> DataFrame:
    """The profile with key_type: PK, FK, UQ or null."""
    unique = (F.col("unique_count") == F.col("total_count")) & (F.col("total_count") > 0)
    name, strict = F.lower("column"), unique & ~F.col("nullable")
    kind = (
        F.when(((name == "id") | is_table_pk(F.col("table"), F.col("column"))) & strict, "PK")
        .when(name.isin("uuid", "guid") & unique, "PK")
        .when(fk_base(F.col("column")).isNotNull(), "FK")
        .when(strict, "UQ")
    )
    return profile.withColumn("key_type", kind)


def pk_surrogate(df: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """df with a bigint key `name` in front. With `order`, ids are 1..n in that order, which is total if the columns are
    unique: the rows are sorted once by ranges of the whole order, so a hot first value is split by the columns after it
    and the number of ranges follows the data; a row's place in its range is stored with it, and the sizes of the ranges
    are summed. Without it ids are unique only. Either way the rows are stored once, so an id does not change from one read
    to the next; without an order as a table by columns, in whose schema all of them may be null."""
    if order is None:
        return cut_round(df.select((F.monotonically_increasing_id() + 1).alias(name), *[F.col(f"`{c}`") for c in df.columns]))
    # a range's number and a row's place in it; stored, as they must not change between the two uses
    ranged = df.orderBy(*[F.col(f"`{c}`") for c in order]).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("place"))
    stored = cut(ranged).select("row", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("inside"))
    sizes = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("part", before.alias("base"))  # one row a range
    met = stored.join(F.broadcast(base), "part")
    return met.select((F.col("base") + F.col("inside") + 1).alias(name), "row.*")
