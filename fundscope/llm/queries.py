"""The registered query of each corpus operator, with production parameters over its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import decontaminate, html_main, line_join, merkle, order_minhash, packing, quality, secrets, spelling, suffix_levels, token_files, url_reputation, vector_tiles
from .common import table, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte", end_id=2, capacity=1024)


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    folder = scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
    files = written(token_files.write_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"), "word", end_id=1), "token-files")
    return token_files.read_files(token_files.with_starts(files).repartition(spark.sparkContext.defaultParallelism * 2))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document of its id."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    labelled = pages.join(labels, "page_id").select("url", "good")
    return url_reputation.judge(pages, labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "level", "bound")


ORACLE["op2_url_reputation"] = url_reputation.ORACLE_SQL


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    return quality.with_quality(docs, quality.fit(docs, labels), columns=["doc_id"])


@query
def op9_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return secrets.digests(secrets.scan(docs, secrets.train(docs), columns=("doc_id",)), "doc_id")


@query
def op5_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles; every item is searched."""
    return decontaminate.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


@query
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least id of its class of near-duplicates."""
    found = order_minhash.classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


@query
def op4_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_join.classes(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op8_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_levels.deduplicate(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_merkle_butterfly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents by language; every seventh document by crc32 is checked with one character more."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    seventh = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = docs.select("doc_id", "lang", merkle.leaf(*fields).alias("leaf"), F.when(seventh, merkle.leaf(*fields[:3], fields[3] + 1, fields[4])).alias("tampered"))
    found = merkle.manifest(rows, "lang", ["doc_id"], "leaf")
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE["op11_merkle_butterfly"] = merkle.ORACLE_SQL


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.with_slips(spelling.runs(table(spark, sf_dir, "documents", "doc_id", "text")))
    return spelling.group(spelling.vocabulary(found))


ORACLE["op12_spelling_variants"] = spelling.ORACLE_SQL


@query
def op13_vector_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return vector_tiles.search(rows.where(F.col("id") % 100 == 0), rows, k=10)


ORACLE["op13_vector_tiles"] = vector_tiles.ORACLE_SQL
