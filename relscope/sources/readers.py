"""Sources and sinks: CSV and parquet tables, declared metadata, facts as JSON, partitioned targets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DELIMITERS = [",", ";", "\t", "|"]


def sniff_delimiter(spark: SparkSession, path: str, lines: int = 20) -> str:
    """The delimiter that splits the first lines into the most, equally many, fields."""
    head = [r["value"] for r in spark.read.text(path).limit(lines).collect() if r["value"].strip()]

    def merit(d: str) -> tuple[bool, int]:
        counts = {line.count(d) for line in head}
        return len(counts) == 1, min(counts, default=0)

    return max(DELIMITERS, key=merit)


def text_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line of the files is valid UTF-8 (with a byte order mark or without), else ISO-8859-1, which takes
    any bytes."""
    bad = spark.read.text(path).where(~F.is_valid_utf8("value"))
    return "UTF-8" if bad.isEmpty() else "ISO-8859-1"


def read_csv_table(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """A CSV table: header, types inferred, names trimmed (a byte order mark too), unnamed columns dropped. Delimiter and
    encoding are found out where they are not given."""
    df = spark.read.csv(path, header=True, inferSchema=True, sep=sep or sniff_delimiter(spark, path), encoding=encoding or text_encoding(spark, path))
    names = [c.lstrip("\ufeff").strip() for c in df.columns]
    keep = [n for n in names if n and not n.startswith(("Unnamed:", "_c"))]
    return df.toDF(*names).select(*[F.col(f"`{n}`") for n in keep])


def read_metadata(spark: SparkSession, keys: str, foreign: str, columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Declared primary keys, foreign keys and columns from their three CSV exports."""
    return primary_keys(read_csv_table(spark, keys)), foreign_keys(read_csv_table(spark, foreign)), declared_columns(read_csv_table(spark, columns))


def load_tables(spark: SparkSession, folder: str, names: list[str], loaded: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Parquet tables by name, over those already loaded; a table of the same name is replaced."""
    return (loaded or {}) | {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def _declared(df: DataFrame, wanted: dict[str, str], needed: list[str]) -> DataFrame:
    """The wanted columns trimmed and renamed; no rows if a needed column is missing."""
    have = {c.strip().lower(): c for c in df.columns}
    ok = all(n.lower() in have for n in needed)
    columns = [(F.trim(F.col(f"`{have[k.lower()]}`").cast("string")) if k.lower() in have else F.lit(None).cast("string")).alias(v) for k, v in wanted.items()]
    out = df.select(*columns)
    return out if ok else out.limit(0)


def primary_keys(df: DataFrame) -> DataFrame:
    return _declared(df, {"TableName": "table_name", "ColumnName": "column_name"}, ["TableName", "ColumnName"])


def foreign_keys(df: DataFrame) -> DataFrame:
    names = {"ParentTable": "parent_table", "ParentColumn": "parent_column", "ReferencedTable": "referenced_table", "ReferencedColumn": "referenced_column"}
    return _declared(df, names, list(names))


def declared_columns(df: DataFrame) -> DataFrame:
    """(table_name, column_name, declared_type, is_nullable); nullable is true unless the export denies it."""
    out = _declared(df, {"TableName": "table_name", "ColumnName": "column_name", "DataType": "data_type", "IsNullable": "nullable_text"}, ["TableName", "ColumnName", "DataType"])
    denied = F.coalesce(F.lower("nullable_text").isin("no", "false", "0", "n"), F.lit(False))
    return out.select("table_name", "column_name", norm_declared_type(F.col("data_type")).alias("declared_type"), (~denied).alias("is_nullable"))


def norm_declared_type(name):
    """The display type of each declared type name; other names pass in upper case."""
    up = F.upper(F.trim(name))
    return (
        F.when(up.isin("INT", "BIGINT", "SMALLINT", "TINYINT"), "INT")
        .when(up.isin("FLOAT", "REAL", "DECIMAL", "NUMERIC", "MONEY", "SMALLMONEY"), "FLOAT")
        .when(up == "BIT", "BOOLEAN")
        .when(up.isin("TEXT", "NTEXT", "XML"), "TEXT")
        .when(up.isin("VARCHAR", "NVARCHAR", "CHAR", "NCHAR", "SYSNAME"), "VARCHAR")
        .when(up.isin("DATETIME", "DATETIME2", "SMALLDATETIME", "DATE", "TIME", "DATETIMEOFFSET", "TIMESTAMP"), "TIMESTAMP")
        .when(up == "UNIQUEIDENTIFIER", "UUID")
        .when(up.isin("BINARY", "VARBINARY", "IMAGE"), "BINARY")
        .otherwise(up)
    )


def map_meta_names(meta: DataFrame, loaded: DataFrame) -> DataFrame:
    """(meta_name, loaded_name): the loaded table of a declared name; equal but for case, else ending in _name; the first
    loaded one wins. Both sides are lists of table names; loaded has (loaded_name, position). A loaded name stands for
    itself and for what follows each of its underscores, so names meet by equality."""
    low = F.lower("loaded_name")
    parts = F.split(low, "_")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "_").alias("name"), (i > 1).cast("int").alias("cut")))
    known = loaded.select("loaded_name", "position", F.explode(endings).alias("e")).select("loaded_name", "position", "e.*")
    met = meta.withColumn("name", F.lower("meta_name")).join(known, "name")
    best = F.row_number().over(Window.partitionBy("meta_name").orderBy("cut", "position"))
    return met.withColumn("rank", best).where("rank = 1").select("meta_name", "loaded_name")


def apply_metadata(keyed: DataFrame, pks: DataFrame, columns: DataFrame, name_map: DataFrame) -> DataFrame:
    """The keyed profile with declared primary keys, types and nullability; a guessed primary key stays."""
    n = name_map.select(F.col("meta_name").alias("table_name"), F.col("loaded_name").alias("table"))
    pk = pks.join(n, "table_name").select("table", F.col("column_name").alias("column"), F.lit(True).alias("is_pk")).distinct()
    col = columns.join(n, "table_name").select("table", F.col("column_name").alias("column"), "declared_type", "is_nullable")
    met = keyed.join(pk, ["table", "column"], "left").join(col, ["table", "column"], "left")
    return met.withColumns({"key_type": F.when(F.col("is_pk"), "PK").otherwise(F.col("key_type")), "type": F.coalesce("declared_type", "type"), "nullable": F.coalesce("is_nullable", "nullable")}).drop("is_pk", "declared_type", "is_nullable")


def table_group(name):
    """The part of a table's name before its first underscore, empty without one."""
    return F.when(F.instr(name, "_") > 0, F.substring_index(name, "_", 1)).otherwise("")


def preview(df: DataFrame, order: list[str], rows: int = 500) -> DataFrame:
    """The first rows in the given order, every cell a string and nulls empty."""
    return df.orderBy(*order).limit(rows).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def table_shape(df: DataFrame, name: str, declared: list[str]) -> DataFrame:
    """(table, row_count, column_count, columns_match, first_row): whether the columns are the declared ones in order, and
    the smallest row (column by column, nulls first) as text, empty without rows."""
    cells = F.min(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    found = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("row_count"), cells.alias("r"))
    shown = F.when(F.col("r").isNotNull(), F.concat_ws("|", *[F.coalesce(F.col(f"r.`{c}`").cast("string"), F.lit("")) for c in df.columns]))
    return found.select("table", "row_count", F.lit(len(df.columns)).alias("column_count"), F.lit(df.columns == declared).alias("columns_match"), F.coalesce(shown, F.lit("")).alias("first_row"))


def sink_facts(facts: DataFrame, path: str, kind: str = "json") -> DataFrame:
    """Write facts (profile rows or relationships) as JSON or parquet and read them back."""
    facts.write.mode("overwrite").format(kind).save(path)
    return facts.sparkSession.read.schema(facts.schema).format(kind).load(path)


def partition_candidates(keyed: DataFrame, types: DataFrame, least: int = 1000) -> DataFrame:
    """(table, row_count): tables that only grow, to be partitioned by created_at: no updated_at, `least` rows or more and
    a primary key that counts up (an identity)."""
    key = types.where("identity is not null").select("table", "column", F.lit(True).alias("counts"))
    met = keyed.join(key, ["table", "column"], "left")
    name = F.lower("column")
    per = met.groupBy("table").agg(F.max("row_count").alias("row_count"), F.max(name == "created_at").alias("made"), F.max(name == "updated_at").alias("kept"), F.max((F.col("key_type") == "PK") & F.coalesce("counts", F.lit(False))).alias("key"))
    return per.where(F.col("made") & ~F.col("kept") & F.col("key") & (F.col("row_count") >= least)).select("table", "row_count")


def sink_partitioned(df: DataFrame, path: str, column: str, by: str = "range", parts: int = 16) -> DataFrame:
    """Write df in partitions and read it back. range: by the day of a time column, as `day`; list: by the values of a
    column, as `part`; hash: by a hash of a column in `parts` partitions, as `part`. Rows are dealt to writers by ranges
    of the partition and a hash of the row, so a hot one is split and none gets a file from every task."""
    if by not in ("range", "list", "hash"):
        raise ValueError(f"no such partitioning: {by}")
    value = F.col(f"`{column}`")
    name, part = ("day", F.to_date(value)) if by == "range" else ("part", value if by == "list" else F.pmod(F.xxhash64(value), F.lit(parts)))
    made = df.withColumn(name, part)
    spread = value if by == "range" else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    made.repartitionByRange(name, spread).write.mode("overwrite").partitionBy(name).parquet(path)
    return df.sparkSession.read.parquet(path)


def sink_bucketed(df: DataFrame, path: str, columns: list[str], buckets: int = 16) -> DataFrame:
    """Write df as a table in buckets of the columns, sorted by them in each file, and give it back. Joins and groups on the
    columns of tables with as many buckets need no shuffle. Rows are dealt to writers by ranges of the bucket and a hash of
    the row, so a hot bucket has several files, and none gets a file from every task. The table has a name of its own in
    the session's catalog."""
    name = f"bucketed_{uuid.uuid4().hex}"
    bucket = F.pmod(F.hash(*[F.col(f"`{c}`") for c in columns]), F.lit(buckets))  # as Spark deals them
    dealt = df.repartitionByRange(bucket, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    dealt.write.format("parquet").bucketBy(buckets, *columns).sortBy(*columns).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
