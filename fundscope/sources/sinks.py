"""Sinks (SNK-1 .. SNK-3). Partitioned table writes, never one file per record."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import derive
from . import storage


def with_record_key(df: DataFrame, source_col: str = "category") -> DataFrame:
    """SNK-1 key '{source}_{subcategory}_{id}' kept as a column (the per-file name of the source system)."""
    return df.withColumn("record_key", derive.record_key(F.col(source_col), F.col("subcategory"), F.col("id")))


def write_records(df: DataFrame, path: str, run: str, max_records_per_file: int = 1_000_000) -> None:
    """SNK-1: the records of one run, as partition ``run`` of a table partitioned by run, category and subcategory.

    The run is written beside the table and then takes the place of what an earlier try left, so a repeated run or
    task leaves the same rows, and a run that dies in between leaves the old ones. Other runs are not touched. Rows are
    dealt by partition before the write; a partition with many rows is split by the adaptive rebalance, one with few
    is not scattered over all tasks. Readers take the latest row per id (RL-6).
    """
    spark = df.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    (with_record_key(df).hint("rebalance", "category", "subcategory").write.partitionBy("category", "subcategory")
     .option("maxRecordsPerFile", max_records_per_file).parquet(staged))
    storage.drop(spark, f"{path}/run={run}")
    storage.move(spark, staged, f"{path}/run={run}")


def envelope_meta(df: DataFrame, as_of_ts: str) -> DataFrame:
    """SNK-2 metadata row: total_fundings and last_updated of the rewritten database."""
    return df.agg(F.count(F.lit(1)).alias("total_fundings"),
                  F.max("last_updated").alias("max_record_updated")).select(
        F.lit(as_of_ts.replace(" ", "T")).alias("last_updated"), "total_fundings", "max_record_updated")


def write_summary(summary: DataFrame, path: str) -> None:
    """SNK-3: the 1-row update summary as JSON (one row, so one small file)."""
    summary.coalesce(1).write.mode("overwrite").json(path)
