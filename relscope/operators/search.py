"""Search over all cells of a set of tables, and tracing of values over relationships."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .loops import cut, search_frontier
from ..sources.readers import sink_bucketed
from .profile import union, unpivoted

PER_TABLE, TOTAL = 100, 500


def predicate(value: Column, query: str, mode: str) -> Column:
    """exact is case-sensitive; starts_with, regex and contains (also for unknown modes) are not."""
    if mode == "exact":
        return value == query
    if mode == "starts_with":
        return F.lower(value).startswith(query.lower())
    if mode == "regex":
        return value.rlike(f"(?i){query}")
    return F.lower(value).contains(query.lower())


def search(tables: dict[str, tuple[DataFrame, list[str]]], query: str, mode: str = "contains", scope: str = "all") -> DataFrame:
    """(table, column, value, row_key): the first PER_TABLE hits of each table by column, then key; TOTAL in all, in the
    order of the tables. tables: name -> (rows, key columns). row_key is the key as text, as rows have no position. An
    empty query finds nothing; a bad pattern raises ValueError."""
    if mode == "regex" and tables:
        spark = next(iter(tables.values()))[0].sparkSession
        try:  # by the dialect that the tasks will use
            spark.range(1).select(predicate(F.col("id").cast("string"), query, mode)).collect()
        except Exception as e:
            raise ValueError(f"bad pattern: {query}") from e
    parts = []
    for rank, (name, (df, key)) in enumerate(tables.items()):
        if scope not in ("all", name):
            continue
        keys = [F.col(f"`{k}`") for k in key]
        cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(df.columns)])
        hit = df.select(F.struct(*keys).alias("k"), F.concat_ws("|", *[k.cast("string") for k in keys]).alias("row_key"), F.explode(F.filter(cells, lambda x: predicate(x["value"], query, mode))).alias("c"))
        first = hit.orderBy("c.ordinal", "k").limit(PER_TABLE if query else 0)
        order = F.row_number().over(Window.orderBy("c.ordinal", "k"))  # over PER_TABLE rows at most
        parts.append(first.select(F.lit(rank).alias("rank"), order.alias("n"), F.lit(name).alias("table"), F.col("c.column").alias("column"), F.col("c.value").alias("value"), "row_key"))
    return union(parts).orderBy("rank", "n").limit(TOTAL).select("table", "column", "value", "row_key")


#: Characters of the pieces of text that an index holds.
GRAM = 3


def gram_index(spark: SparkSession, stored: dict[str, str], path: str) -> DataFrame:
    """(table, file, gram): the pieces of GRAM characters, in small letters, of the cells in each file of stored tables (name
    -> folder), sorted by piece and stored at path. It has a row a file and piece, whatever the number of rows."""
    parts = []
    for name, folder in stored.items():
        df = spark.read.parquet(folder)
        texts = df.select(F.col("_metadata.file_path").alias("file"), F.explode(F.array(*[F.lower(F.col(f"`{c}`").cast("string")) for c in df.columns])).alias("text")).distinct()
        places = F.sequence(F.lit(1), F.length("text") - (GRAM - 1))
        grams = texts.where(F.length("text") >= GRAM).select("file", F.explode(F.array_distinct(F.transform(places, lambda i: F.substr("text", i, F.lit(GRAM))))).alias("gram"))
        parts.append(grams.distinct().select(F.lit(name).alias("table"), "file", "gram"))
    union(parts).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(path)
    return spark.read.parquet(path)


def needed(query: str, mode: str) -> str:
    """The longest piece of text that every hit holds, in small letters; empty where a pattern does not tell."""
    if mode != "regex":
        return query.lower()
    if set(query) & set("|()[]{}\\"):
        return ""
    runs = [run[:-1] if after in ("*", "?") else run for run, after in re.findall(r"([^\^$.+*?]+)([+*?]?)", query)]
    return max(runs, key=len, default="").lower()


def files_with(index: DataFrame, table: str, query: str, mode: str) -> list[str] | None:
    """The files of a table that may have hits, which are those with all pieces of what every hit holds; None where that is
    too short to tell, and all files have to be read."""
    text = needed(query, mode)
    grams = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
    if not grams:
        return None
    held = index.where((F.col("table") == table) & F.col("gram").isin(grams)).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["file"] for r in held.where(F.col("n") == len(grams)).collect())  # names of files


def search_stored(spark: SparkSession, stored: dict[str, str], keys: dict[str, list[str]], index: DataFrame, query: str, mode: str = "contains", scope: str = "all") -> DataFrame:
    """search() on stored tables (name -> folder) with their key columns, reading only files that a gram_index of the same
    files leaves."""
    tables = {}
    for name, folder in stored.items():
        whole = spark.read.parquet(folder)
        files = files_with(index, name, query, mode) if scope in ("all", name) else []
        tables[name] = (whole if files is None else spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0), keys[name])
    return search(tables, query, mode, scope)


def by_table(hits: DataFrame, shown: int = 10) -> DataFrame:
    """Hits of each table with their number, `shown` of them."""
    w = Window.partitionBy("table")
    rank = F.row_number().over(w.orderBy("column", "row_key"))
    return hits.withColumns({"n_hits": F.count(F.lit(1)).over(w), "rank": rank}).where(F.col("rank") <= shown).drop("rank")


def search_fields(df: DataFrame, fields: list[str], query: str, key: str, most: int = 50) -> DataFrame:
    """Rows with the query in any of the fields, whatever the case; the first `most` by key."""
    any_ = F.lit(False)
    for f in fields:
        any_ = any_ | F.coalesce(F.lower(F.col(f)).contains(query.lower()), F.lit(False))
    return df.where(any_).orderBy(key).limit(most)


#: Seeds up to this number are looked up in the buckets of their values alone.
FEW_SEEDS = 100


def _there(parts: list[tuple[str, list[str], DataFrame]], wanted: DataFrame) -> DataFrame:
    """(table, column, value), once each, of the cells of the ends that have a wanted value."""
    names = [(table, column) for table, columns, _ in parts for column in columns]
    first = {table: i for i, (table, column) in reversed(list(enumerate(names)))}
    cells = union([rows.select((F.col("ordinal") + first[table]).cast("short").alias("end"), "value") for table, _, rows in parts])
    met = cells.join(wanted, "value", "left_semi").distinct()
    label = [F.element_at(F.array(*[F.lit(n[k]) for n in names]), F.col("end") + 1) for k in (0, 1)]
    return met.select(label[0].alias("table"), label[1].alias("column"), "value")


def value_index(tables: dict[str, DataFrame], rels: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """(value, table, column): where each value of the columns at the ends of the relationships occurs, stored in buckets of
    the value. Traces that are given it neither scan nor shuffle the tables."""
    parts = []
    for name, columns, rows in _ends(tables, rels):
        labels = F.element_at(F.array(*map(F.lit, columns)), F.col("ordinal") + 1)
        parts.append(rows.select(F.lit(name).alias("table"), labels.alias("column"), "value"))
    return sink_bucketed(union(parts).distinct(), path, ["value"], buckets)


def _ends(tables: dict[str, DataFrame], rels: DataFrame) -> list[tuple[str, list[str], DataFrame]]:
    """(table, columns, cells (ordinal, value)) of each table's columns that stand at an end of a relationship."""
    ends = [tuple(r) for r in rels.select("source_table", "source_column").union(rels.select("target_table", "target_column")).distinct().collect()]
    parts = []
    for name in sorted({t for t, _ in ends}):
        columns = sorted(c for t, c in ends if t == name)
        parts.append((name, columns, unpivoted(tables[name], columns)))
    return parts


def looked_up(index: DataFrame, seeds: DataFrame) -> DataFrame:
    """(table, column, value) of an index for the seeds' values: from the buckets of a few values, or by a join in which the
    index stays where it is."""
    wanted = seeds.where("value is not null").select("value").distinct()
    some = [r["value"] for r in wanted.limit(FEW_SEEDS + 1).collect()]
    found = index.where(F.col("value").isin(some)) if len(some) <= FEW_SEEDS else index.join(wanted, "value", "left_semi")
    return found.select("table", "column", "value")


def trace(tables: dict[str, DataFrame], rels: DataFrame, seeds: DataFrame, max_depth: int = 5, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (seed_id, table, column, values, depth) and edges (seed_id, from_table, from_column, to_table, to_column).

    seeds: (seed_id, table, column, value). rels: (rank, source_table, source_column, target_table, target_column),
    followed both ways. A node is a column that the seed's value occurs in; the start is a node even if it does not.
    Each reached node has one edge: of the lowest rank among the relationships that reach it first. Only cells with a
    seed's value are kept, by a semi-join, before the search begins; with an index of value_index() on the same
    relationships they are read from it, and tables are not used.
    """
    if index is not None:
        there = cut(looked_up(index, seeds))
    else:
        # rows of a number and a value: names would make most of the memory of the sorts of this join
        there = cut(_there(_ends(tables, rels), seeds.select("value").distinct()))
    back = rels.select("rank", F.col("target_table").alias("from_table"), F.col("target_column").alias("from_column"), F.col("source_table").alias("to_table"), F.col("source_column").alias("to_column"))
    steps = rels.select("rank", F.col("source_table").alias("from_table"), F.col("source_column").alias("from_column"), F.col("target_table").alias("to_table"), F.col("target_column").alias("to_column")).unionByName(back)
    steps = F.broadcast(steps)  # one row a relationship
    start = seeds.select("seed_id", "table", "column", "value", F.lit(0).alias("depth"), *[F.lit(None).cast("string").alias(c) for c in ("from_table", "from_column")])

    def hop(frontier: DataFrame, depth: int) -> DataFrame:
        f = frontier.select("seed_id", "value", F.col("table").alias("from_table"), F.col("column").alias("from_column"))
        met = f.join(steps, ["from_table", "from_column"]).withColumnsRenamed({"to_table": "table", "to_column": "column"})
        met = met.join(there, ["table", "column", "value"], "left_semi")
        first = F.row_number().over(Window.partitionBy("seed_id", "table", "column").orderBy("rank", "from_table", "from_column"))
        return met.withColumn("first", first).where("first = 1").select("seed_id", "table", "column", "value", F.lit(depth).alias("depth"), "from_table", "from_column")

    seen = search_frontier(start, hop, ["seed_id", "table", "column"], max_depth)
    nodes = seen.select("seed_id", "table", "column", F.array("value").alias("values"), "depth")
    edges = seen.where("depth > 0").select("seed_id", "from_table", "from_column", F.col("table").alias("to_table"), F.col("column").alias("to_column"))
    return nodes, edges
