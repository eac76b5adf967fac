"""A training corpus from raw documents: five stages, each one corpus operator.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps, with the
columns of ``docs``; the last returns the encoded documents.  ``run`` writes
every stage as Parquet and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.bpe import encode_decode
from riskweave.llm.columns import text_of, with_text_key
from riskweave.llm.decontaminate import decontaminate
from riskweave.llm.langid import UNKNOWN, held_out, predict_language, train_language_model
from riskweave.llm.line_dedup import drop_repeated_lines
from riskweave.llm.near_dedup import near_duplicates
from riskweave.session import materialise

#: A prediction less sure than this is no prediction.
MIN_SCORE = 0.3


def _row(docs: DataFrame):
    """The whole row as one column, so that no name of ``docs`` can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells; no text, no letters or no confidence is a rejection."""
    model = train_language_model(docs.where(~held_out("doc_id")))
    told = predict_language(docs.select(_row(docs), "text"), model)
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; ``n_chars`` follows the text."""
    cut = drop_repeated_lines(docs.select(_row(docs), "text"))
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group; a row that is repeated whole stays once."""
    decided = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), "k1", "k2").distinct()
    keyed = with_text_key(docs.select(_row(docs), F.col("doc_id").alias("_doc"), text_of("text").alias("_text")), F.col("_text"))
    same = keyed["_doc"].eqNullSafe(decided["_id"]) & (keyed["k1"] == decided["k1"]) & (keyed["k2"] == decided["k2"])
    kept = keyed.join(decided, same, "left_semi").dropDuplicates(["_doc", "k1", "k2"])
    return kept.select("_row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items).where(F.size("hits") == 0).select("row.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    coded = encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: The language model is trained, which SQL cannot express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
