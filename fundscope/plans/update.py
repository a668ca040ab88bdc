"""The full update run as a composition of the operators and sinks.

sources -> source subset (FL-7) -> validation / commit gate (FL-2, RL-5) -> upsert-append into the
partitioned record table (RL-4, SNK-1) -> update summary over the whole batch (AG-1, SNK-3).
A run owns its partitions; readers take the latest row per id (RL-6) with ``read_latest``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..operators import merge, metrics, quality, search
from ..sources import sinks
from ..sources.storage import exists as _exists


def read_table(spark: SparkSession, table_path: str) -> DataFrame:
    """The record table, or an empty frame in the record schema when it does not exist yet."""
    columns = T.StructType([*schema.RECORD.fields, *[T.StructField(c, T.StringType()) for c in ("record_key", "run")]])
    return spark.read.schema(columns).parquet(table_path) if _exists(spark, table_path) else spark.createDataFrame([], columns)


def read_latest(spark: SparkSession, table_path: str) -> DataFrame:
    """RL-6 on the table: the latest row per id (by last_updated, then record_key)."""
    return merge.latest_snapshot(read_table(spark, table_path), "id", ["last_updated", "record_key"])


def run_update(spark: SparkSession, batch: DataFrame, table_path: str, as_of_ts: str, sources=None,
               dedupe_batch: bool = False, failure_scope: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """One update run over ``batch`` (records in the record schema, plus ``ord``).

    Adds the valid records whose id is not in the table's other runs to ``table_path`` and writes the
    summary row under ``table_path/_summary/<as_of>``. A run of the same ``as_of_ts`` again replaces its own rows.
    Returns the quarantined rows and the summary (both computed from the batch alone, so they stay valid after the
    write). ``failure_scope`` (RL-5) lets a failing record stop its source or scraper; by default only itself.
    """
    if sources is not None:
        batch, rejected = search.source_subset(batch, sources)
        if rejected:
            raise ValueError(f"unknown sources: {rejected}")
    run = as_of_ts.replace(" ", "T").replace(":", "")
    gated = quality.commit_gate(batch.withColumn("reasons", quality.typed_reasons(batch)), "reasons", scope=failure_scope or {})
    stopped = gated.filter("verdict != 'commit'")
    base_ids = read_table(spark, table_path).filter(F.col("run") != run).select("id")
    new, _ = merge.upsert_append(base_ids, gated.filter("verdict = 'commit'").select(*batch.columns), dedupe_batch=dedupe_batch)
    sinks.write_records(new.drop("ord"), table_path, run)
    summary = metrics.summary_report(batch, as_of_ts)
    sinks.write_summary(summary, f"{table_path}/_summary/{run}")
    return {"quarantined": stopped, "summary": summary}
