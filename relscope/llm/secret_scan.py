"""Secrets in texts: fixed patterns, and strings in a sensitive place that zstandard cannot compress.

A candidate is a string that begins shortly behind a sensitive word, or holds one. Its novelty is what it adds, in bytes, to
the compressed text around it, divided by its length. The compressor is primed with a dictionary trained on identifiers, so
names made of known parts, words whose letters are frequent and what stands elsewhere around cost little, and random keys
cost their whole length. A candidate's own repetitions nearby are taken out of the text around it, so a key that is written
twice is found twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean, text_or_empty

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "novel"]
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
#: No match begins inside a run of its own characters that another has taken, so runs are tried at their first character.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

#: What makes a place sensitive. All names that ASSIGN takes hold one of these words.
SENSITIVE = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|(?:access|private|signing|master|account|encryption)[ _-]?key|credential|bearer|authorization|client[ _-]?id", re.A | re.I)
STRING = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{10,}={0,2}")
PART = re.compile(r"[A-Za-z0-9+/_.-]")
#: A candidate begins at most NEAR characters behind the sensitive word, has SHORTEST characters and TURNS changes between
#: digits, small and capital letters within its parts, and NOVEL bytes a character; AROUND characters on each side count.
NEAR, SHORTEST, TURNS, NOVEL, AROUND = 48, 10, 3, 0.85, 256
TURN = re.compile(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")

#: Parts of identifiers, of which the dictionary's training lines are made by rule.
VERBS = "get set read write open close load save parse build make send receive find update delete create check init start stop run test add remove".split()
NOUNS = "user name key value file path config request response header token password secret client server session data table column index count size list map error message state cache buffer stream".split()
TAILS = ["id", "url", "type", "info"]
DICTIONARY_BYTES = 16384


def identifier_lines(verbs: Iterable[str] = VERBS, nouns: Iterable[str] = NOUNS) -> list[str]:
    """Identifiers of two and three parts in both spellings, and lines of code that use them."""
    out = []
    for v in verbs:
        for n in nouns:
            out += [f"{v}_{n}", v + n.capitalize()]
            for t in TAILS:
                out += [v + n.capitalize() + t.capitalize(), f"{v}_{n}_{t} = {n}.{t}()\n"]
    return out


class Novelty:
    """Marginal compressed bytes beside a text, by a compressor primed with the dictionary trained on `lines`."""

    def __init__(self, lines: Iterable[str] | None = None, size: int = DICTIONARY_BYTES) -> None:
        samples = [x.encode() for x in (identifier_lines() if lines is None else lines)]
        self.trained = zstandard.train_dictionary(size, samples).as_bytes()
        self.packer = None

    def __getstate__(self):
        return {"trained": self.trained, "packer": None}

    def _size(self, text: str) -> int:
        if self.packer is None:
            given = zstandard.ZstdCompressionDict(self.trained)
            self.packer = zstandard.ZstdCompressor(level=3, dict_data=given, write_checksum=False, write_content_size=False, write_dict_id=False)
        return len(self.packer.compress(text.encode("utf-8", "replace")))

    def of(self, text: str, start: int, end: int) -> float:
        """Bytes a character that text[start:end] adds to what stands around it."""
        own = text[start:end]
        around = text[max(0, start - AROUND) : start].replace(own, " ") + text[end : end + AROUND].replace(own, " ")
        return (self._size(around + own) - self._size(around)) / (end - start)


def base_spans(text: str, sensitive: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns in code points, by start, then kind; sensitive: whether SENSITIVE matches."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if sensitive else []
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _strings(text: str, words: list[re.Match]) -> Iterator[tuple[int, int]]:
    """(start, end) of the strings that hold one of the sensitive words or begin shortly behind one, once each."""
    done = 0
    for word in words:
        at = word.start()
        while at > done and PART.match(text[at - 1]):
            at -= 1
        at, limit = max(at, done), word.end() + NEAR
        while m := STRING.search(text, at, limit + SHORTEST):
            m = STRING.match(text, m.start())
            if m.start() > limit:
                break
            at = done = m.end()
            core = m[0].strip("./-_+")
            if len(core) >= SHORTEST:
                start = m.start() + m[0].index(core)
                yield start, start + len(core)


def find(text: str, novelty: Novelty) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then kind in the order of KINDS. Added ones overlap none of the patterns'."""
    words = list(SENSITIVE.finditer(text))
    spans = base_spans(text, bool(words))
    added, i = [], 0
    for start, end in _strings(text, words):
        while i < len(spans) and spans[i][2] <= start:
            i += 1
        if any(a < end and start < b for _, a, b in spans[max(0, i - len(BASE)) : i + len(BASE)]):
            continue
        if len(TURN.findall(text, start, end)) >= TURNS and novelty.of(text, start, end) >= NOVEL:
            added.append(("novel", start, end))
    return sorted(spans + added, key=lambda s: (s[1], KINDS.index(s[0])))


def secrets(docs: DataFrame, novelty: Novelty | None = None) -> DataFrame:
    """(doc_id, spans) for every row of docs (doc_id, text): spans are an array of (kind, start, finish), code points, end
    exclusive, by start, then kind.

    Null and empty texts have none. Rows are independent: ids may be null or repeated, and what is found in a text does not
    depend on its copies; an empty table gives an empty result. Whole texts are searched; other columns are left out.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(novelty or Novelty())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("finish", pa.int32())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "finish": b} for k, a, b in find(t, sent.value)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty("text").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, spans array<struct<kind:string,start:int,finish:int>>")
