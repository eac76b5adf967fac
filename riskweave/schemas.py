"""Fixed schemas of the input and result tables."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCE_RESULTS = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("evidence_count", T.StringType()),
        T.StructField("query_used", T.StringType()),
    ]
)

EVIDENCE = T.StructType(
    [
        T.StructField("evidence_id", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("identity_score", T.DoubleType()),
        T.StructField("review_required", T.StringType()),
        T.StructField("url_or_reference", T.StringType()),
        T.StructField("raw_content_hash", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("review_reason", T.StringType()),
        T.StructField("extracted_fields", T.StringType()),
    ]
)

MATCH_SUMMARY = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("entity_name", T.StringType()),
        T.StructField("input_country", T.StringType()),
        T.StructField("input_entity_type", T.StringType()),
        T.StructField("sources_hit", T.StringType()),
        T.StructField("match_count", T.StringType()),
        T.StructField("matches_json", T.StringType()),
        T.StructField("is_suspicious_analyst", T.StringType()),
    ]
)

FOCUS = T.StructType([T.StructField("entity_id", T.StringType())])

EDGES = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("relation_type", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)

# DDL of the serialised columns.
QUERY_USED = (
    "array<struct<entity_id:string,query_value:string,"
    "metadata:struct<country_code:string,entity_type:string>>>"
)
EXTRACTED_FIELDS = (
    "struct<statement_of_reasons:string,csd_cancellation_reason:string,"
    "review_reason:string,regime_name:string,programs_json:string,"
    "status:string,supposition:string>"
)
