"""The opN_ queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import conversation_repair, embedding_dedup, language_id, near_text, packing, periodic_runs, pii, quality, secret_scan, sentencepiece_codec, token_counts, warc
from .common import cut, table
from .exact_dedup import UPPER, exact_dedup


def op1_sentencepiece(spark, sf_dir, model=None):
    model = model or public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, model), model)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op2_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


def op3_warc(spark, sf_dir):
    back = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark, sf_dir, model=None):
    vocabulary = token_counts.marked_vocabulary(model or public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary)


def _spans(found, base):
    """(joined base spans, joined spans, counts of each base kind) of a column of spans."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["finish"])), ",")

    def count(kind):
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return joined(F.filter(found, lambda s: s["kind"].isin(base))), joined(found), [count(k) for k in base]


def op6_pii(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans, counts = _spans("spans", pii.BASE)
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def op7_ngram_jaccard_join(spark, sf_dir):
    return near_text.near_texts(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark, sf_dir, tokenizer=None):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"))


def op9_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, digest_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = docs.withColumn("held_out", language_id.held_out())
    model = language_id.Model(language_id.train(fold.where("not held_out")))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op11_conversation_repair(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = conversation_repair.damaged(given)
    report = cut(conversation_repair.repair_report(rows))
    digests = conversation_repair.repaired_digests(rows, report)
    ids = given.select(F.col("conv_id").alias("id")).distinct()
    met = ids.join(report.withColumnRenamed("conv_id", "own"), F.col("id").eqNullSafe(F.col("own")), "left").join(digests, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in conversation_repair.COUNTS]
    return met.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_secret_scan(spark, sf_dir):
    found = secret_scan.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, spans, counts = _spans("spans", secret_scan.BASE)
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def op13_periodic_runs(spark, sf_dir):
    docs = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.find_runs(docs).withColumn("order", F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    best = found.withColumn("best", F.array_max("order"))
    length, start, period = F.col("best")["length"], -F.col("best")["col2"], -F.col("best")["col3"]
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality": op2_quality,
    "op3_warc": op3_warc,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_pii": op6_pii,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_secret_scan": op12_secret_scan,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE = {
    "op3_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
             r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM r""",
    "op9_exact_dedup": f"""
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)""",
}
