"""Greedy word-piece lengths by a linear longest-match automaton, without building pieces.

The vocabulary's pieces form two tries, one for the start of a word and one for its rest. Every trie node has a failure
link to the node that reading goes on from once the pieces before it are popped, and the number of pieces popped on
that way; both are computed once for each vocabulary (Song et al., "Fast WordPiece Tokenization", 2021). Counting the
pieces of a word then takes one step for each character plus the links followed, which is linear in the word however
the pieces overlap. Words are dictionary-encoded a batch at a time, so each distinct word of a batch is read once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean
from .words import per_text, split_words

NONE = -1
START, REST = 0, 1


class LongestMatch:
    """Counts greedy longest-match pieces. `initial` are pieces that start a word, `inner` those that continue it."""

    def __init__(self, initial: set[str], inner: set[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        order: list[tuple[int, int, str]] = []  # (node, parent, character), parents first
        for root, vocabulary in ((START, initial), (REST, inner)):
            for piece in sorted(vocabulary, key=len):
                at = root
                for c in piece:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        order.append((len(self.next), at, c))
                        self.next.append({})
                        ends.append(False)
                    at = self.next[at][c]
                ends[at] = at > REST
        self.fail, self.pops = [NONE] * len(ends), [0] * len(ends)
        depth = [0] * len(ends)
        for node, parent, _ in order:
            depth[node] = depth[parent] + 1
        for node, parent, c in sorted(order, key=lambda x: depth[x[0]]):
            if ends[node]:
                self.fail[node], self.pops[node] = REST, 1
                continue
            at, popped = self.fail[parent], self.pops[parent]
            while at != NONE and c not in self.next[at]:
                popped += self.pops[at]
                at = self.fail[at]
            if at != NONE:
                self.fail[node], self.pops[node] = self.next[at][c], popped

    def count(self, word: str) -> int:
        """Pieces of the word; 1, for the unknown piece, where greedy matching gets stuck."""
        step, fail, pops, at, n = self.next, self.fail, self.pops, START, 0
        for c in word:
            while (to := step[at].get(c)) is None:
                n += pops[at]
                at = fail[at]
                if at == NONE:
                    return 1
            at = to
        while at != REST:
            if fail[at] == NONE:
                return 1
            n += pops[at]
            at = fail[at]
        return n


def marked_vocabulary(model: str, mark: str = "▁") -> tuple[set[str], set[str]]:
    """The pieces of a sentencepiece model: those with the mark start a word (mark cut off), others continue it."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
    return {p[1:] for p in pieces if p.startswith(mark) and len(p) > 1}, {p for p in pieces if not p.startswith(mark)}


def token_counts(docs: DataFrame, initial: set[str], inner: set[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens): words are separated by ASCII white space; a word that cannot be matched counts 1.

    Null and empty texts have 0 of both. Every row is counted, repeated ids too; other columns are left out. The
    automaton is as large as the vocabulary, whatever the corpus.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(LongestMatch(initial, inner))

    def run(batches):
        one = sent.value.count
        for pdf in batches:
            codes, distinct, counts = split_words(pdf["text"].tolist())
            sizes = np.fromiter(map(one, distinct), np.int64, len(distinct))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": counts, "n_tokens": per_text(sizes[codes], counts)})

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.mapInPandas(lean(run), f"doc_id {kind}, n_words long, n_tokens long")
