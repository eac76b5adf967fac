"""Registered queries of the corpus operators: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from riskweave.llm.bpe import encode_decode
from riskweave.llm.conversations import damage, repair_conversations
from riskweave.llm.decontaminate import covered, decontaminate
from riskweave.llm.exact_dedup import exact_dedup
from riskweave.llm.html_text import extract_main_text, train_labeller
from riskweave.llm.langid import held_out, predict_language, train_language_model
from riskweave.llm.line_dedup import drop_repeated_lines
from riskweave.llm.near_dedup import near_duplicates
from riskweave.llm.passages import linked_documents, passage_links, passages_of_documents
from riskweave.llm.secret_scan import RULES, scan_secrets, span_text
from riskweave.llm.sharding import shard_documents
from riskweave.llm.warc import archive_and_read
from riskweave.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_language_model(docs.where(~held_out("doc_id")))
    given = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return predict_language(given, model).select("doc_id", "held_out", "lang_pred", "score")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    coded = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85).drop("k1", "k2")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract_main_text(pages.select("page_id", "url", "html"), train_labeller(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = covered(F.col("hits")).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with a repeated passage: its passages, how many, the least partner, its component and verified links."""
    return documents_with_passages(table(spark, sf_dir, "documents"))


def documents_with_passages(docs: DataFrame) -> DataFrame:
    links = passage_links(docs)
    span = F.struct("start", "end")
    spans = passages_of_documents(links).groupBy("doc_id").agg(
        F.countDistinct(span).alias("n_passages"),
        F.min("partner_id").alias("partner_id"),
        F.max(F.col("end") - F.col("start")).cast("long").alias("longest"),
        F.array_join(
            F.transform(F.array_sort(F.collect_set(span)), lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","
        ).alias("passages"),
    )
    linked = linked_documents(links).withColumnRenamed("doc_id", "id")
    return spans.join(linked, F.col("doc_id").eqNullSafe(F.col("id")), "left").drop("id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = [r.kind for r in RULES if r.base]
    return found.select(
        "doc_id", *[count(k) for k in base],
        F.sha2(span_text(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        span_text(F.col("found")).alias("spans"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=4)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_bpe": op3_bpe,
    "op4_near_dedup": op4_near_dedup,
    "op5_html_text": op5_html_text,
    "op6_feistel_sharding": op6_feistel_sharding,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_secret_scan": op10_secret_scan,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_warc": op13_warc,
    "pipeline": corpus_pipeline.run,
}
