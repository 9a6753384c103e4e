"""Language identification of whole and of mixed-language texts.

Training counts hashed character n-grams (one to three, with word ends) and letters of each script for every language
value, by map-side and shuffled sums; the model has at most BUCKETS numbers for each language whatever the corpus.
For a text, every distinct word is scored once a batch: its script's range narrows the languages to those seen in that
script, and the n-grams' log probabilities give a score for each. Viterbi over the words, with a penalty for switching,
labels the spans of the text; the language with the most letters is the text's language.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean
from .viterbi import viterbi
from .words import per_text, split_words

BUCKETS = 1 << 16
#: First code point of each script block, and the script.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
]
_FIRST = [x for x, _ in SCRIPTS]
NAMES = sorted({x for _, x in SCRIPTS})
_SCRIPT = [NAMES.index(x) for _, x in SCRIPTS]
CLIP = 8.0


def letters_of(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def script_of(letters: str) -> int:
    return _SCRIPT[bisect_right(_FIRST, ord(letters[0])) - 1]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its word) of every hashed n-gram of the words, none of which is empty."""
    text = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), "<u4").astype(np.uint64)
    end = text == 32
    word = np.cumsum(end) - 1
    with np.errstate(over="ignore"):
        one = text * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ np.uint64(0xABCD)) * np.uint64(0xC2B2AE3D27D4EB4F) + text[1:] * np.uint64(0x165667B19E3779F9)
        three = two[:-1] * np.uint64(0x27D4EB2F165667C5) + text[2:] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)
    keep1 = ~end
    keep2 = ~(end[:-1] & end[1:])
    keep3 = ~end[1:-1]
    hashed = np.concatenate([one[keep1], two[keep2], three[keep3]])
    owner = np.concatenate([word[keep1], np.where(end[1:], word[:-1], word[1:])[keep2], word[1:-1][keep3]])
    return (hashed >> np.uint64(40)).astype(np.int64) % BUCKETS, owner


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 100) -> pd.DataFrame:
    """(lang, slot, n): counts of hashed n-grams, and behind them of letters of each script. Nulls teach nothing.

    The model is held whole, half a megabyte a language in every worker, and its counts pass through the driver; so the
    values of lang are counted before anything else, and more than `most` of them raise ValueError.
    """
    bound_batches(docs.sparkSession)
    names = docs.select(F.col(f"`{lang_col}`").alias("lang")).where("lang is not null").distinct().limit(most + 1).count()
    if names > most:
        raise ValueError(f"more than {most} languages to learn; a model of so many is not held whole")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang", sort=False):
                codes, distinct, _ = split_words(part["text"].tolist())
                n = np.bincount(codes, minlength=len(distinct))
                own = [letters_of(w) for w in distinct]
                n = n[[bool(w) for w in own]] if own else n
                own = [w for w in own if w]
                if own:
                    bucket, word = grams(own)
                    held = sums.setdefault(lang, np.zeros(BUCKETS + len(NAMES)))
                    held[:BUCKETS] += np.bincount(bucket, n[word], BUCKETS)
                    held[BUCKETS:] += np.bincount([script_of(w) for w in own], n * np.array(list(map(len, own))), len(NAMES))
        for lang, held in sums.items():
            slot = np.flatnonzero(held)
            yield pd.DataFrame({"lang": lang, "slot": slot, "n": held[slot].astype(np.int64)})

    texts = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text is not null and lang is not null")
    return texts.mapInPandas(lean(run), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()


class Model:
    """Log probabilities of n-gram buckets for each language, and the scripts each language is written in."""

    def __init__(self, counts: pd.DataFrame, share: float = 0.001):
        self.langs = sorted(counts["lang"].unique())
        table = np.zeros((len(self.langs), BUCKETS + len(NAMES)))
        np.add.at(table, (pd.Index(self.langs).get_indexer(counts["lang"]), counts["slot"].to_numpy(np.int64)), counts["n"].to_numpy())
        grams_, scripts = table[:, :BUCKETS] + 0.5, table[:, BUCKETS:]
        self.log = np.ascontiguousarray(np.log(grams_ / grams_.sum(1, keepdims=True)).T) if self.langs else np.zeros((BUCKETS, 0))
        self.written = (scripts > share * scripts.sum(1, keepdims=True)).T

    def scores(self, letters: list[str]) -> np.ndarray:
        """For each word's letters a row of scores, the best 0; words without letters score 0 for all languages."""
        out = np.zeros((len(letters), len(self.langs)))
        have = [i for i, w in enumerate(letters) if w]
        if not have or not self.langs:
            return out
        bucket, word = grams([letters[i] for i in have])
        size = np.bincount(word, minlength=len(have))
        sums = np.stack([np.bincount(word, self.log[bucket, k], len(have)) for k in range(len(self.langs))], 1) / 3
        fits = self.written[[script_of(letters[i]) for i in have]]
        sums = np.where(fits | ~fits.any(1, keepdims=True), sums, -np.inf)
        best = sums.max(1, keepdims=True)
        rows = np.maximum(sums - best, -CLIP)
        rows[(size == 0)] = 0
        out[have] = rows
        return out


OUT = "doc_id {kind}, lang_pred string, score double, spans array<struct<first:int,words:int,lang:string>>"


def predict(docs: DataFrame, model: Model, penalty: float = 6.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans): spans are runs of words of one language, in order and without gaps.

    score is the share of the text's letters in words labelled lang_pred; of equal shares the smaller name wins. Null
    texts and texts without a letter are `und` with score 0 and no spans, as is every text if nothing was learned.
    Every row is predicted, repeated ids too; other columns are left out.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        names = [*model.langs]
        for pdf in batches:
            codes, distinct, counts = split_words(pdf["text"].tolist())
            letters = [letters_of(w) for w in distinct]
            weight = np.array(list(map(len, letters)), np.int64)
            label = viterbi(model.scores(letters)[codes], counts, penalty) if names else np.zeros(len(codes), np.int64)
            mass = weight[codes]
            total = per_text(mass, counts)
            if names:
                each = np.stack([per_text(mass * (label == k), counts) for k in range(len(names))], 1)
                top = each.argmax(1)
                share = each.max(1) / np.maximum(total, 1)
            known = (total > 0) & bool(names)
            ends = np.cumsum(counts)
            spans = []
            for doc, (end, n) in enumerate(zip(ends.tolist(), counts.tolist())):
                own = label[end - n : end]
                cuts = np.append(0, np.flatnonzero(np.diff(own)) + 1) if n else []
                sizes = np.diff(np.append(cuts, n)) if n else []
                spans.append([{"first": int(a), "words": int(m), "lang": names[own[a]]} for a, m in zip(cuts, sizes)] if known[doc] else [])
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "lang_pred": [names[top[i]] if known[i] else "und" for i in range(len(pdf))],
                    "score": [float(share[i]) if known[i] else 0.0 for i in range(len(pdf))],
                    "spans": spans,
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.mapInPandas(lean(run), OUT.format(kind=kind))


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True for the rows that teach nothing: crc32 of the id as text, modulo folds, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))
