"""A corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, packing.

``STAGES`` are (name, function) pairs. A function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``.

Null texts count as empty and null ids stay null; rows of equal id are judged as each operator's docstring
says. Empty tables give empty results, and other columns pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundscope.llm import decontaminate, line_join, order_minhash, packing, quality
from fundscope.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the model reject go; the model is fitted on the stage's own input."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    return quality.with_quality(docs, quality.fit(docs, labels)).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, but for TAU edits, go; every document stays."""
    out = line_join.without_repeats(docs, written(line_join.classes(docs), "line-classes"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one of the least id (and text hash, if rows share the id)."""
    found = order_minhash.classes(docs)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "unit")).alias("c"))
    kept = first.select(F.coalesce("c.doc_id", F.lit(0)).alias("__id"), F.col("c.last").alias("__null"), F.col("c.unit").alias("__unit"))
    rows = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__null": F.col("doc_id").isNull(), "__unit": order_minhash.unit_of()})
    keys = ["__id", "__null", "__unit"]
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with or without an id."""
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    held = found.select(F.col("doc_key").alias("__key")).distinct()
    return docs.withColumn("__key", decontaminate.key_of()).join(held, "__key", "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte", end_id=2, capacity=1024)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]
#: SQL cannot express the trained model, the alignment or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
