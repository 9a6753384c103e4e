"""WARC archives: written in parts by many tasks, indexed first, then read by coalesced byte ranges.

Every task writes archives of its own under names no other attempt uses, and gives one index row for each record. The
index is stored through Spark's commit protocol, so it names the files of successful tasks only; files that a lost or
repeated task left are in no index row and are never read. Records are gzip members of their own, as the format asks.

Reading starts from the index: the wanted records are sorted by file and offset, neighbours whose gap is small are
joined into ranges of bounded size, and each range is one read.

The files are reached through pyarrow's file systems, from the URI of the folder, on any store that all executors share.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, join_groups, lean, scratch

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 1 << 29
SIEVE = 1 << 20
INDEX = "file string, offset long, length long, page_id long, url string, record_type string, payload_digest string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages (page_id, url, html) with payload, payload_bytes, payload_digest, refers_to (null: a response).

    Of records with equal payloads of `least` bytes or more the one with the largest page_id is the response; rows
    that repeat its id are responses as well. Rows without page_id are always responses.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    narrow = cut(rows.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest"))
    groups = cut(narrow.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1"))
    revisits = join_groups(narrow, groups, "payload_digest", "copies", narrow.count())
    revisits = cut(revisits.where("page_id <> refers_to").select("page_id", "payload_digest", "refers_to").distinct())
    # payloads that a sieve of the revisits, of a bounded number of buckets, lets through are not shuffled
    bucket = F.pmod(F.xxhash64("page_id", "payload_digest"), F.lit(SIEVE)).alias("bucket")
    sieve = revisits.select(bucket).distinct().withColumn("hit", F.lit(True))
    marked = rows.withColumn("bucket", bucket).join(F.broadcast(sieve), "bucket", "left").drop("bucket")
    met = marked.where("hit").drop("hit").join(revisits, ["page_id", "payload_digest"], "left")
    return met.unionByName(marked.where("hit is null").drop("hit"), allowMissingColumns=True)


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _whole(value):
    return None if value is None or value != value else int(value)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the records of plan_records under folder; the index as a stored DataFrame."""
    spark = records.sparkSession
    bound_batches(spark)

    def run(batches):
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{top}/archives", recursive=True)
        out, name, at = None, "", 0
        for pdf in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["payload_digest"], pdf["refers_to"]):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{top}/archives/{name}", compression=None)
                page_id, refers_to = _whole(page_id), _whole(refers_to)
                member = gzip.compress(_record(page_id, url, payload, digest, refers_to), 5, mtime=0)
                out.write(member)
                rows.append((name, at, len(member), page_id, url, "response" if refers_to is None else "revisit", digest))
                at += len(member)
            if rows:
                frame = pd.DataFrame(rows, columns=["file", "offset", "length", "page_id", "url", "record_type", "payload_digest"])
                yield frame.astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    records.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInPandas(lean(run), INDEX).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def parse_record(raw: bytes) -> dict:
    """Fields of one uncompressed record; payload is None for a revisit."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sent = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "response":
        fields["payload"] = payload
        fields["digest"] = hashlib.sha1(payload).hexdigest()
        if fields["WARC-Payload-Digest"] != f"sha1:{fields['digest']}" or len(payload) != int(sent["Content-Length"]):
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    else:
        fields["payload"] = None
        fields["digest"] = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    fields["bytes"] = int(sent["Content-Length"])
    return fields


def byte_ranges(wanted: DataFrame, gap: int = 1 << 16, most: int = 1 << 22) -> DataFrame:
    """Ranges (file, first, size, parts) that cover the wanted index rows: neighbours with at most `gap` bytes between
    them share a range, which is cut where it passes a multiple of `most` bytes. A file has FILE_BYTES at most."""
    order = Window.partitionBy("file").orderBy("offset")
    apart = F.col("offset") - F.lag(F.col("offset") + F.col("length"), 1).over(order) > gap
    crosses = F.floor(F.col("offset") / most) != F.lag(F.floor(F.col("offset") / most), 1).over(order)
    starts = F.coalesce((apart | crosses).cast("int"), F.lit(1))
    numbered = wanted.select("file", "offset", "length", starts.alias("starts")).withColumn("run", F.sum("starts").over(order))
    parts = F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts")
    end = F.max(F.col("offset") + F.col("length"))
    return numbered.groupBy("file", "run").agg(F.min("offset").alias("first"), (end - F.min("offset")).alias("size"), parts).drop("run")


def read_archives(index: DataFrame, folder: str, gap: int = 1 << 16, most: int = 1 << 22) -> DataFrame:
    """The records that the index rows name: page_id, url, record_type, refers_to, payload (null for a revisit),
    payload_bytes and payload_digest, both of the full payload. Damaged records raise. No index rows, no records."""
    spark = index.sparkSession
    bound_batches(spark)

    def run(batches):
        store, top = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for file, first, size, parts in zip(pdf["file"], pdf["first"], pdf["size"], pdf["parts"]):
                with store.open_input_file(f"{top}/archives/{file}") as source:
                    source.seek(int(first))
                    held = source.read(int(size))
                found = [parse_record(gzip.decompress(held[p["offset"] - first : p["offset"] - first + p["length"]])) for p in parts]
                yield pd.DataFrame(
                    {
                        "page_id": pd.array([f.get("X-Page-Id") and int(f["X-Page-Id"]) for f in found], "Int64"),
                        "url": [f.get("WARC-Target-URI") for f in found],
                        "record_type": [f["WARC-Type"] for f in found],
                        "refers_to": pd.array([f.get("X-Refers-To-Page-Id") and int(f["X-Refers-To-Page-Id"]) for f in found], "Int64"),
                        "payload": [f["payload"] for f in found],
                        "payload_bytes": [f["bytes"] for f in found],
                        "payload_digest": [f["digest"] for f in found],
                    }
                )

    ranges = byte_ranges(index, gap, most)
    return ranges.mapInPandas(lean(run), RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every row of pages (page_id, url, html) as a record in the shared folder and read all of them back.

    Null html is an empty payload; a null url or page_id is left out of the record and null again when read. Other
    columns are left out. An empty table writes no archive and gives no rows.
    """
    folder = scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(plan_records(pages), folder), folder)
