"""Data-quality advisories: filters over the keyed profile and the relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import enum_values, unpivoted, union

#: The severities; the rule names and thresholds below are fixed as well.
SEVERITIES = ["error", "warning", "info"]


def _rows(df: DataFrame, rule: str, severity: str, column: Column, reason: Column, **evidence: Column) -> DataFrame:
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    notes = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "table", column.alias("column"), reason.alias("reason"), notes.alias("evidence"))


def missing_pk(keyed: DataFrame) -> DataFrame:
    none = keyed.groupBy("table").agg(F.count_if(F.col("key_type") == "PK").alias("n"), F.max("row_count").alias("rows")).where("n = 0")
    return _rows(none, "missing_primary_key", "warning", F.lit(None).cast("string"), F.lit("no primary key column"), row_count=F.col("rows"))


def unmarked_unique(keyed: DataFrame) -> DataFrame:
    hit = keyed.where("unique_count = total_count and not nullable and total_count >= 10 and coalesce(key_type, '') not in ('PK', 'UQ')")
    return _rows(hit, "unmarked_unique", "info", F.col("column"), F.lit("all values are unique"), unique_count=F.col("unique_count"))


def high_null(keyed: DataFrame) -> DataFrame:
    return _rows(keyed.where("null_ratio >= 0.5"), "high_null_ratio", "info", F.col("column"), F.lit("half of the values or more are null"), null_count=F.col("row_count") - F.col("total_count"))


def enum_candidates(tables: dict[str, DataFrame], keyed: DataFrame) -> DataFrame:
    hit = keyed.where("type in ('VARCHAR', 'TEXT') and unique_count between 1 and 15 and total_count >= 10 and coalesce(key_type, '') not in ('PK', 'UQ')")
    hit = hit.join(enum_values(tables, hit), ["table", "column"])
    return _rows(hit, "enum_candidate", "info", F.col("column"), F.lit("few distinct values"), unique_count=F.col("unique_count"), values=F.array_join("values", "|"))


def wide_text(keyed: DataFrame) -> DataFrame:
    return _rows(keyed.where("avg_len >= 500"), "wide_varchar", "info", F.col("column"), F.lit("long text"), max_length=F.col("max_len"))


def boolean_like(tables: dict[str, DataFrame], keyed: DataFrame) -> DataFrame:
    hit = keyed.where("type in ('INT', 'FLOAT') and key_type is null and unique_count between 1 and 2 and min_num between 0 and 1 and max_num between 0 and 1")
    wanted: dict[str, list[str]] = {}
    for r in hit.select("table", "column").collect():
        wanted.setdefault(r["table"], []).append(r["column"])
    parts = [
        unpivoted(tables[t].select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]), cols)
        .groupBy("ordinal").agg(F.every(F.col("value").isin("0.0", "1.0", "0", "1")).alias("ok")).where("ok")
        .select(F.lit(t).alias("table"), F.element_at(F.array(*map(F.lit, cols)), F.col("ordinal") + 1).alias("column"))
        for t, cols in wanted.items()
    ]
    hit = hit.join(union(parts), ["table", "column"]) if parts else hit
    return _rows(hit, "boolean_masquerading", "info", F.col("column"), F.lit("only 0 and 1"), unique_count=F.col("unique_count"))


def orphan_fk(keyed: DataFrame, rels: DataFrame) -> DataFrame:
    known = rels.select(F.col("source_table").alias("table"), F.col("source_column").alias("column")).distinct()
    hit = keyed.where("key_type = 'FK'").join(known, ["table", "column"], "left_anti")
    return _rows(hit, "orphan_fk", "warning", F.col("column"), F.lit("no target found"), detected_fk_name=F.col("column"))


def low_confidence(rels: DataFrame) -> DataFrame:
    hit = rels.where("confidence in ('low', 'medium')").withColumn("table", F.col("source_table"))
    return _rows(hit, "low_confidence_fk", "info", F.col("source_column"), F.lit("check before use"), target=F.concat_ws(".", "target_table", "target_column"), confidence=F.col("confidence"))


def all_advisories(tables: dict[str, DataFrame], keyed: DataFrame, rels: DataFrame) -> DataFrame:
    return union([missing_pk(keyed), unmarked_unique(keyed), high_null(keyed), enum_candidates(tables, keyed), wide_text(keyed), boolean_like(tables, keyed), orphan_fk(keyed, rels), low_confidence(rels)])


def counts(found: DataFrame) -> DataFrame:
    """Rows per severity, also of those without any."""
    every = found.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    n = found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "severity", "left").select("severity", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def scores(found: DataFrame, keyed: DataFrame, rels: DataFrame) -> DataFrame:
    """structure, type_precision and relationships, each from 0 to 1 with two digits."""
    a = found.agg(
        F.count_if(F.col("rule") == "missing_primary_key").alias("no_pk"),
        F.count_if(F.col("rule").isin("wide_varchar", "enum_candidate", "boolean_masquerading")).alias("loose"),
        F.count_if(F.col("rule").isin("orphan_fk", "low_confidence_fk")).alias("doubt"),
    )
    k = keyed.agg(F.count_distinct("table").alias("tables"), F.count(F.lit(1)).alias("columns"))
    r = rels.agg(F.count(F.lit(1)).alias("rels"))
    one = F.lit(1)
    all_ = a.withColumn("j", one).join(k.withColumn("j", one), "j").join(r.withColumn("j", one), "j")

    def score(bad, total):
        return F.round(F.greatest(F.lit(0.0), 1.0 - F.col(bad) / F.greatest(total, one)), 2)

    return all_.select(score("no_pk", F.col("tables")).alias("structure"), score("loose", F.col("columns")).alias("type_precision"), score("doubt", F.col("rels") + F.col("doubt")).alias("relationships"))


def stats(keyed: DataFrame, rels: DataFrame) -> DataFrame:
    k = keyed.agg(F.count_distinct("table").alias("tables"), F.count(F.lit(1)).alias("columns")).withColumn("j", F.lit(1))
    return k.join(rels.agg(F.count(F.lit(1)).alias("relationships")).withColumn("j", F.lit(1)), "j").drop("j")
