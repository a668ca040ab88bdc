"""Streaming queries (ST-1, ST-2) over the events table, run to completion with ``availableNow``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import load
from ..streaming import upsert
from .registry import register


def _events_stream(spark, d):
    """The events table as a file stream: the folder is the source, the glob filter picks the table."""
    schema = load(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d.rstrip("/"))


@register("stream_upsert", """
SELECT user_id, event_type, event_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
WHERE rn = 1""")
def q_stream_upsert(spark, d):
    src = _events_stream(spark, d).select("user_id", "event_type", "event_id", "ts")
    target = upsert.stream_upsert(spark, src, ["user_id", "event_type"], "ts", ["ts", "event_id"])
    return spark.read.parquet(target).select("user_id", "event_type", "event_id", "ts")


@register("stream_upsert_batches", """
SELECT user_id, event_type, event_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
WHERE rn = 1""")
def q_stream_upsert_batches(spark, d):
    """The events arrive as four files in order of time, a micro-batch each; the third batch is then run again."""
    ev = load(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    run = scratch_path(spark, f"stream-batches-{uuid.uuid4().hex}")
    cuts = ev.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.25, 0.5, 0.75], 1000).alias("c")).first()["c"] or []
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = [None, *cuts, None]
    parts = []
    for low, high in zip(edges, edges[1:]):
        part = ev.filter((micros > low) if low is not None else F.lit(True)).filter((micros <= high) if high is not None else F.lit(True))
        part.coalesce(1).write.mode("append").parquet(f"{run}/in")
        parts.append(part)
    src = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{run}/in")
    target = upsert.stream_upsert(spark, src, ["user_id", "event_type"], "ts", ["ts", "event_id"], run_dir=run)
    if len(parts) > 2:
        upsert.upsert_batch(parts[2], target, ["user_id", "event_type"], ["ts", "event_id"], 2)
    return spark.read.parquet(target).select("user_id", "event_type", "event_id", "ts")


@register("stream_counts", """
SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def q_stream_counts(spark, d):
    src = _events_stream(spark, d).select("ts", "event_type")
    return upsert.stream_counts(spark, src, "ts", "event_type", window="1 day", watermark="1 hour")
