import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece

from relscope.llm import queries
from relscope.llm import sentencepiece_codec as codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def test_same_as_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op1_sentencepiece(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = sp.encode(r.text, add_bos=True, add_eos=True)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_odd_texts(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "the ", "▁", "é", "中文", "🙂", "​", "<s>", "<0x0A>", "\x00", "�", "x" * 90]
    texts = [None, "", " ", "\n", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)), "word " * 60_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for r in codec.decode(codec.encode(docs, MODEL), MODEL).collect():
        ids = sp.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.text == sp.decode(ids)


def test_table_is_bounded(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h") for i in range(40)], "doc_id long, text string")
    assert codec.chunk_table(docs, MODEL, table_rows=4).count() <= 4
    assert codec.chunk_table(docs, MODEL).count() == 8


def test_repeated_and_null_ids(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(1, "one text"), (1, "another"), (1, "one text"), (None, "no id"), (None, None)]
    got = codec.decode(codec.encode(spark.createDataFrame(rows, "doc_id long, text string"), MODEL), MODEL).collect()
    shown = sorted((r.doc_id or 0, r.text, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in got)
    assert shown == sorted((i or 0, t or "", sp.encode(t or "", add_bos=True, add_eos=True)) for i, t in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert codec.encode(docs, MODEL).count() == 0
