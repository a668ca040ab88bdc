"""Parquet table scans over a scale-factor folder (SRC-3 and the driver tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; Catalyst prunes columns and pushes filters into the parquet reader."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-3: already-fetched pages as input rows (page_id, url, html)."""
    return load(spark, sf_dir, "pages").select("page_id", "url", "html")
