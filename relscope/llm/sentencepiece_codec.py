"""SentencePiece encoding and decoding through a distinct-chunk table.

With a model whose pieces hold the white-space mark only at their start, no piece crosses from a word into the mark
that follows it. A text, with spaces turned into marks and one mark put before it, then splits into chunks (marks and
the word after them) that are segmented apart from each other. The corpus is counted into a table of distinct chunks;
each chunk of the table is segmented once; texts are rebuilt by looking their chunks up in order of position.

The table is sent to every task, so its size is bounded: a chunk enters when it makes up at least 1/`table_rows` of
the occurrences counted, so at most `table_rows` chunks of at most `MAX_CHUNK` characters can enter whatever the
corpus holds. The rare rest is segmented where it stands, once a task for each distinct chunk (the task's own table is
emptied at `LOCAL_ROWS`, which costs time only). Joining the rare occurrences to a sharded table instead would shuffle
more bytes than the corpus has.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, lean, slices

MARK = "▁"
#: A line feed is in no piece but its own byte piece, so it ends a chunk as well.
CHUNK = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
MAX_CHUNK = 64
LOCAL_ROWS = 300_000
#: Texts whose chunks are held as strings at once.
TEXTS = 500
_loaded: dict = {}


def _processor(model: str):
    """The model, once it is known that chunks can be segmented apart."""
    if model not in _loaded:
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}|.\n|\n.", p) for p in pieces):
            raise ValueError("pieces of this model cross white-space marks or line feeds")
        _loaded[model] = sp
    return _loaded[model]


def segment(model: str, some: list[str], together: int = 500) -> list[bytes]:
    """The packed ids of each chunk. The library marks the start of a text, which only the first chunk of a text has
    and carries itself; behind a line feed chunks stand without another mark. So many chunks are segmented in one
    call, each behind a line feed, and the ids are cut at the line feeds again."""
    encode_ids = _processor(model).encode
    lead = encode_ids("\n")
    feed, out = lead[-1], []
    for at in range(0, len(some), together):
        part = some[at : at + together]
        ids = np.array(encode_ids("\n".join(["", *[c if c != "\n" else "" for c in part]])), "<u4")
        ends = np.append(np.flatnonzero(ids == feed)[1:], len(ids))
        starts = np.append(len(lead), ends[:-1] + 1)
        whole = ids.tobytes()
        out += [whole[4 * i : 4 * j] if c != "\n" else whole[4 * i - 4 : 4 * i] for i, j, c in zip(starts.tolist(), ends.tolist(), part)]
    return out


def _piece_bytes(model: str) -> list[bytes]:
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    out = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_control(i):
            out.append(b"")
        elif sp.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_unknown(i):
            out.append(" ⁇ ".encode())
        else:
            out.append(piece.replace(MARK, " ").encode())
    return out


def chunks(text: str) -> list[str]:
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


class ChunkTable:
    """Chunk -> its packed ids: the shared table, and what this task met beside it."""

    def __init__(self, model: str, shared: dict):
        self.model, self.shared, self.known = model, shared, dict(shared)

    def ids(self, texts) -> list[bytes]:
        """The packed ids of each text, without begin and end."""
        split = [chunks(t) for t in texts]
        new = set().union(*split) - self.known.keys()
        if len(self.known) + len(new) > len(self.shared) + LOCAL_ROWS:
            self.known = dict(self.shared)
            new = set().union(*split) - self.known.keys()
        new = list(new)
        self.known.update(zip(new, segment(self.model, new)))
        return [b"".join(map(self.known.__getitem__, x)) for x in split]


def chunk_table(docs: DataFrame, model: str, text_col: str = "text", table_rows: int = 1 << 21, min_count: int = 16) -> DataFrame:
    """(chunk, n, ids): the frequent chunks of all texts, each segmented once; at most table_rows of them. A chunk enters
    when it makes up 1/table_rows of the occurrences and occurs min_count times: for rarer ones a place in the table
    costs more than segmenting them where they stand."""

    def counted(seen):
        short = {c: n for c, n in seen.items() if len(c) <= MAX_CHUNK}
        return pd.DataFrame({"chunk": list(short), "n": list(short.values())})

    def count(batches):
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                seen.update(chunks(text))
            if len(seen) > LOCAL_ROWS:
                yield counted(seen)
                seen = Counter()
        if seen:
            yield counted(seen)

    def segmented(batches):
        for pdf in batches:
            yield pdf.assign(ids=segment(model, pdf["chunk"].tolist()))

    texts = docs.select(F.col(f"`{text_col}`").alias("text")).where("length(text) > 0")
    counts = texts.mapInPandas(lean(count), "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    often = cut(counts.where(F.col("n") >= min_count))
    total = often.agg(F.sum("n")).first()[0] or 0
    return often.where(F.col("n") >= total / table_rows).mapInPandas(lean(segmented), "chunk string, n long, ids binary")


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", table_rows: int = 1 << 21) -> DataFrame:
    """(doc_id, ids): the ids of each text between the begin and end ids, packed as little-endian unsigned 32-bit.

    Null and empty texts have the begin and end ids alone. Every row is encoded, whatever its id; rows that repeat an
    id stay apart. Further columns of docs are left out.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = chunk_table(docs, model, text_col, table_rows).select("chunk", "ids").toPandas()
    sent = spark.sparkContext.broadcast((rows["chunk"].tolist(), [bytes(x) for x in rows["ids"]]))

    def run(batches):
        table, sp = ChunkTable(model, dict(zip(*sent.value))), _processor(model)
        first, last = array("I", [sp.bos_id()]).tobytes(), array("I", [sp.eos_id()]).tobytes()
        for pdf in batches:
            for part in slices(pdf, TEXTS):
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [first + x + last for x in table.ids(part["text"])]})

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.mapInPandas(lean(run), f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, text): the text of each packed id sequence; control ids give nothing, null ids give null."""

    def text_of(ids: bytes, pieces: list[bytes]) -> str:
        raw = b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")

    def run(batches):
        pieces = _piece_bytes(model)
        for pdf in batches:
            yield pdf.assign(text=[None if x is None else text_of(x, pieces) for x in pdf["ids"]])

    return encoded.mapInPandas(lean(run), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, text string")
