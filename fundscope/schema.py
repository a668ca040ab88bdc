"""Explicit schemas of the record data model (no inference on read)."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I = T.StringType(), T.LongType(), T.IntegerType()
ARR = T.ArrayType(T.StringType())

AMOUNT = T.StructType([T.StructField("min", L), T.StructField("max", L), T.StructField("currency", S),
                       T.StructField("duration_years", I)])

RECORD = T.StructType([
    T.StructField("id", S),
    T.StructField("title", S),
    T.StructField("organization", S),
    T.StructField("category", S),
    T.StructField("subcategory", S),
    T.StructField("description", S),
    T.StructField("eligibility", T.StructType([T.StructField("career_stage", S), T.StructField("disciplines", ARR),
                                               T.StructField("requirements", ARR)])),
    T.StructField("funding_details", T.StructType([T.StructField("amount", AMOUNT), T.StructField("covers", ARR)])),
    T.StructField("application", T.StructType([T.StructField("deadline", S), T.StructField("next_deadline", S),
                                               T.StructField("frequency", S), T.StructField("application_url", S),
                                               T.StructField("guidelines_url", S)])),
    T.StructField("key_info", T.StructType([T.StructField("priority_level", S), T.StructField("competition_level", S),
                                            T.StructField("success_rate", S)])),
    T.StructField("contact", T.StructType([T.StructField("email", S), T.StructField("phone", S)])),
    T.StructField("tags", ARR),
    T.StructField("last_updated", T.TimestampNTZType()),
    T.StructField("scraped_from", S),
    T.StructField("status", S),
])

ENVELOPE = T.StructType([
    T.StructField("last_updated", S),
    T.StructField("total_fundings", L),
    T.StructField("fundings", T.ArrayType(RECORD)),
])

SCHEME = T.StructType([
    T.StructField("source_id", S),
    T.StructField("title", S),
    T.StructField("description", S),
    T.StructField("career_stage", S),
    T.StructField("amount_min", L),
    T.StructField("amount_max", L),
    T.StructField("duration_years", I),
    T.StructField("deadline", S),
    T.StructField("frequency", S),
    T.StructField("tags", ARR),
    T.StructField("success_rate", S),
])

DIMENSION = T.StructType([
    T.StructField("source_id", S),
    T.StructField("kind", S),
    T.StructField("name", S),
    T.StructField("base_url", S),
    T.StructField("funding_url", S),
    T.StructField("disciplines", ARR),
    T.StructField("description", S),
    T.StructField("rank", I),
])
