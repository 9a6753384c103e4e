"""Best-fit packing planned over the histogram of lengths.

Texts are tokenised once into pieces of at most `capacity` tokens; the narrow pieces are checkpointed. The driver sees
only how many pieces each length has (at most `capacity` numbers) and runs best fit, longest first, over those counts:
equal bins are handled as one run, so the plan's size depends on the capacity and not on the pieces. A plan row says:
pieces of this length with ranks from..from+n go to sequences first..first+n at this offset. Pieces then find
their slot by their rank within their length.

Ranks are made in two steps, so a length that a third of all pieces share is no single task's work: pieces of a
length are dealt over hash buckets of about `BUCKET` pieces, ranked within their bucket, and bucket sizes are summed.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, insort
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, lean
from .words import gather, per_text, split_words

BUCKET = 500
CACHE_PARTS = 400_000
_cache: dict[str, WordIds] = {}

#: The only normaliser and pre-tokenizer that texts are split for word by word; any other tokenizer gets whole texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Words of these characters have nothing to compose, and their letters and digits are those of PARTS.
SIMPLE = "^[!-~À-ÖØ-öø-ÿ]*$"
LETTERS = "a-zß-öø-ÿ"
PARTS = f"('s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+)"


class WordIds:
    """Ids of the white-space-separated words of a batch, where the tokenizer's file shows that it never looks across
    white space.

    Distinct words are lower-cased and cut into the parts that the file's pattern gives, by Arrow; each distinct part
    goes through the tokenizer's model once while it is remembered. Words with other characters, or with what may be a
    special token, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        made = json.loads(self.tok.to_str())
        self.apart = (
            made["normalizer"] == NORMALIZER
            and made["pre_tokenizer"] == PRE_TOKENIZER
            and all("<|" in t["content"] for t in made["added_tokens"])
            and made["model"].get("type") == "BPE"
            and not made["model"].get("dropout")
        )
        self.parts: dict[str, bytes] = {}
        if self.apart:
            self.shown = {ord(c): self.tok.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c != "÷"}

    def part(self, part: str) -> bytes:
        plain = part if part.isascii() else part.translate(self.shown)
        return array("I", [t.id for t in self.tok.model.tokenize(plain)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words joined, number of ids of each)."""
        words = pa.array(distinct, pa.large_string())
        simple = pc.and_not(pc.match_substring_regex(words, SIMPLE), pc.match_substring(words, "<|")).to_numpy(zero_copy_only=False).astype(bool)
        lowered = pc.utf8_lower(words)
        one = pc.and_(pc.match_substring_regex(lowered, f"^[{LETTERS}]+$"), pa.array(simple)).to_numpy(zero_copy_only=False).astype(bool)
        # a part's end is marked by a character that no simple word has
        marked = pc.replace_substring_regex(lowered.filter(pa.array(simple & ~one)), PARTS, "\\1\n")
        codes, parts, counts = split_words(marked)
        letters = lowered.filter(pa.array(one)).to_numpy(zero_copy_only=False).tolist()
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        known, ids = self.parts, []
        for p in chain(parts, letters):
            if (got := known.get(p)) is None:
                known[p] = got = self.part(p)
            ids.append(got)
        ids += [self.whole(distinct[i]) for i in np.flatnonzero(~simple)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(lengths) - lengths
        # words in order: the parts of a simple one, the one entry of another
        each = np.ones(len(distinct), np.int64)
        several = simple & ~one
        each[several] = counts
        place = np.empty(each.sum(), np.int64)
        place[np.repeat(several, each)] = codes
        place[np.repeat(one, each)] = np.arange(len(parts), len(parts) + len(letters))
        place[np.repeat(~simple, each)] = np.arange(len(parts) + len(letters), len(ids))
        out, size = gather(flat, starts, lengths, place)
        return out, per_text(size, each)


def token_ids(path: str, texts) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts joined, number of ids of each text)."""
    if path not in _cache:
        _cache[path] = WordIds(path)
    known = _cache[path]
    if not known.apart:
        whole = [known.whole(t) for t in texts]
        return np.frombuffer(b"".join(whole), np.uint32), np.fromiter(map(len, whole), np.int64, len(whole)) // 4
    codes, distinct, counts = split_words(texts, at_spaces=True)
    flat, lengths = known.of(distinct)
    ids, size = gather(flat, np.cumsum(lengths) - lengths, lengths, codes)
    return ids, per_text(size, counts)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): each text's ids and end_id, cut after every `capacity`; ids are
    packed as little-endian unsigned 32-bit, and null unless keep_ids is set."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            ids, size = token_ids(tokenizer, pdf["text"].tolist())
            ends = np.cumsum(size + 1)
            closed = np.full(ends[-1], end_id, "<u4")
            inside = np.ones(len(closed), bool)
            inside[ends - 1] = False
            closed[inside] = ids
            raw = memoryview(closed).cast("B")
            n = -(-(size + 1) // capacity)
            first = np.cumsum(n) - n
            piece = np.arange(n.sum()) - np.repeat(first, n)
            start = piece * capacity
            length = np.minimum(capacity, np.repeat(size + 1, n) - start)
            at = (np.repeat(ends - size - 1, n) + start) * 4
            parts = [raw[a : a + m] for a, m in zip(at.tolist(), (length * 4).tolist())]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].repeat(n).reset_index(drop=True),
                    "piece": piece,
                    "start": start,
                    "length": length,
                    "ids_crc32": [zlib.crc32(x) for x in parts],
                    "ids": [bytes(x) for x in parts] if keep_ids else None,
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.mapInPandas(lean(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, n, first sequence, offset) for runs of n pieces."""
    slots, opened = [], 0
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, number) of bins with that room
    rooms: list[int] = []

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # no bin has room: open as many as this length fills
                room = capacity
                each = min(left, room // length)
                first, n = opened, left // each
                opened += n
            else:
                room = rooms[at]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
                each = min(left, room // length)
                use = min(n, left // each)
                give(room, first + use, n - use)
                n = use
            for j in range(each):
                slots.append((length, rank + j * n, n, first, capacity - room + j * length))
            rank, left = rank + each * n, left - each * n
            give(room - each * length, first, n)
    return slots


def rank_within(rows: DataFrame, group: str, histogram: dict[int, int], order: list[str]) -> DataFrame:
    """rows with `rank`, from 0 without gaps within each value of `group`, whose sizes histogram has."""
    spark = rows.sparkSession
    spread = spark.createDataFrame([(k, -(-n // BUCKET)) for k, n in histogram.items()], f"{group} long, buckets long")
    dealt = rows.join(F.broadcast(spread), group).withColumn("bucket", F.pmod(F.xxhash64(*order), "buckets"))
    sizes = dealt.groupBy(group, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy(group, "bucket").orderBy(*order)) - 1
    return dealt.withColumn("inside", inside).join(base, [group, "bucket"]).withColumn("rank", F.col("base") + F.col("inside")).drop("bucket", "buckets", "base", "inside")


def pack(cut_pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """The pieces with sequence_id and offset. cut_pieces needs doc_id, piece and length; it is read several times, so
    hand in a checkpointed or stored table. Repeated rows are packed as often as they occur; null ids are packed too.
    An empty table gives an empty result."""
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan_slots(histogram, capacity)
    spark = cut_pieces.sparkSession
    plan = spark.createDataFrame(slots, "length long, first_rank long, n long, first_sequence long, offset long")
    ranked = rank_within(cut_pieces, "length", histogram, ["doc_id", "piece"]).alias("r")
    inside = (F.col("r.rank") >= F.col("p.first_rank")) & (F.col("r.rank") < F.col("p.first_rank") + F.col("p.n"))
    placed = ranked.join(F.broadcast(plan.alias("p")), (F.col("r.length") == F.col("p.length")) & inside)
    sequence = F.col("p.first_sequence") + F.col("r.rank") - F.col("p.first_rank")
    return placed.select("r.*", sequence.alias("sequence_id"), F.col("p.offset").alias("offset")).drop("rank")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, **names) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty and has the end id alone. Every row is packed, repeated ids too; other columns are left
    out. The pieces' checkpoint holds their checksum in place of the ids, which the documents give again.
    """

    made = pieces(docs, tokenizer, capacity, end_id, keep_ids=False, **names).drop("ids")
    return pack(cut(made), capacity)
