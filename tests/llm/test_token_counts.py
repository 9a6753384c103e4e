import random

import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from relscope.llm import queries, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def library(initial, inner):
    vocabulary = {"[UNK]": 0}
    for p in sorted(initial) + [f"##{p}" for p in sorted(inner)]:
        vocabulary[p] = len(vocabulary)
    return Tokenizer(models.WordPiece(vocab=vocabulary, unk_token="[UNK]", continuing_subword_prefix="##", max_input_chars_per_word=10**6))


def test_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        some = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(12)}
        inner = {w for w in some if rng.random() < 0.8}
        lm, lib = token_counts.LongestMatch(some, inner), library(some, inner)
        for _ in range(200):
            word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 14)))
            assert lm.count(word) == len(lib.encode(word).ids), (some, inner, word)


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    lib = library(*token_counts.marked_vocabulary(MODEL))
    lib.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    got = {r.doc_id: r.n_tokens for r in queries.op5_token_counts(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {r.doc_id: len(lib.encode(r.text).ids) for r in rows}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, "", 0), (2, " \n\t ", 0), (None, "ab  ab\nzz", 0), (3, "a" * 100_000, 0)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in token_counts.token_counts(docs, {"a", "ab"}, {"a", "b"}).collect())
    assert got == [(0, 3, 3), (1, 0, 0), (1, 0, 0), (2, 0, 0), (3, 1, 100_000)]
    assert token_counts.token_counts(docs.limit(0), {"a"}, {"a"}).count() == 0
