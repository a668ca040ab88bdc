"""Merge queries (RL-1, RL-4, RL-6, RL-7, FL-5) over V1 and the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import rules
from ..operators import merge
from ..session import scratch_path
from ..sources import database
from ..sources.tables import load
from .registry import register
from .registry import v1 as _v1

SPLIT_TS = "1997-01-01 00:00:00"
CHANGES_SPLIT_TS = "2024-01-15 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
RETENTION_DAYS = 7


@register("union_sources", """
SELECT ord, category, CASE category WHEN 'ukri' THEN 0 WHEN 'academies' THEN 1 ELSE 2 END AS source_rank
FROM opportunities WHERE category IN ('ukri', 'academies', 'foundations')""", "opportunities")
def q_union_sources(spark, d):
    v = _v1(spark, d).select("ord", "category")
    frames = {s: v.filter(F.col("category") == s) for s in rules.SOURCE_ORDER}
    return merge.union_sources(frames)


_BASE = f"SELECT ord, id FROM opportunities WHERE last_updated < TIMESTAMP '{SPLIT_TS}'"
_BATCH = (f"SELECT ord, id FROM opportunities WHERE last_updated >= TIMESTAMP '{SPLIT_TS}' "
          "AND category IS NOT NULL AND deadline IS NOT NULL")


def _split(spark, d):
    v = _v1(spark, d)
    cut = F.to_timestamp_ntz(F.lit(SPLIT_TS))
    return v.filter(F.col("last_updated") < cut), v.filter(F.col("last_updated") >= cut)


@register("upsert_append", f"""
SELECT ord, id, 'base' AS origin FROM ({_BASE})
UNION ALL
SELECT ord, id, 'new' AS origin FROM ({_BATCH}) b WHERE b.id NOT IN (SELECT id FROM ({_BASE}))""", "opportunities")
def q_upsert_append(spark, d):
    base, batch = _split(spark, d)
    new, _ = merge.upsert_append(base, batch)
    return (base.select("ord", "id", F.lit("base").alias("origin"))
            .unionByName(new.select("ord", "id", F.lit("new").alias("origin"))))


@register("upsert_append_dedup", f"""
SELECT ord, id, 'new' AS origin FROM (
  SELECT min(ord) AS ord, id FROM ({_BATCH}) b WHERE b.id NOT IN (SELECT id FROM ({_BASE})) GROUP BY id)""",
          "opportunities")
def q_upsert_append_dedup(spark, d):
    base, batch = _split(spark, d)
    new, _ = merge.upsert_append(base, batch, dedupe_batch=True)
    return new.select("ord", "id", F.lit("new").alias("origin"))


@register("latest_snapshot", """
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def q_latest_snapshot(spark, d):
    ev = load(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return merge.latest_snapshot(ev, "user_id", ["ts", "event_id"])


@register("snapshot_changes", """
SELECT user_id, event_id, ts, CASE WHEN prev IS NULL THEN 'new' ELSE 'changed' END AS change FROM (
  SELECT user_id, event_id, ts, event_type,
         lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
WHERE prev IS NULL OR prev <> event_type""")
def q_snapshot_changes(spark, d):
    ev = load(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return merge.snapshot_changes(ev, "user_id", "ts", "event_id", ["event_type"], bucket="hour")


@register("snapshot_changes_batches", """
SELECT user_id, event_id, ts, CASE WHEN prev IS NULL THEN 'new' ELSE 'changed' END AS change FROM (
  SELECT user_id, event_id, ts, event_type,
         lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
WHERE prev IS NULL OR prev <> event_type""")
def q_snapshot_changes_batches(spark, d):
    """Two batches, before and after a time, the second against the published state of the first."""
    ev = load(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    path = scratch_path(spark, f"entity-state-{uuid.uuid4().hex}")
    cut = F.to_timestamp_ntz(F.lit(CHANGES_SPLIT_TS))
    key = ("user_id", "ts", "event_id", ["event_type"])
    first, second = ev.filter(F.col("ts") < cut), ev.filter(F.col("ts") >= cut)
    database.publish_version(merge.entity_state(first, *key), path, CHANGES_SPLIT_TS)
    state = database.read_version(spark, path)
    one = merge.snapshot_changes(first, *key, bucket="hour", hot=merge.HOT_BUCKET)
    return one.unionByName(merge.snapshot_changes(second, *key, bucket="hour", state=state, hot=merge.HOT_BUCKET))


@register("retention", f"""
SELECT event_id, ts FROM events
WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL {RETENTION_DAYS} DAY""")
def q_retention(spark, d):
    ev = load(spark, d, "events").select("event_id", "ts")
    return merge.retention(ev, "ts", EVENTS_AS_OF, RETENTION_DAYS)


@register("retention_records", f"""
SELECT ord, last_updated FROM opportunities
WHERE last_updated >= TIMESTAMP '{SPLIT_TS}' - INTERVAL 30 DAY""", "opportunities")
def q_retention_records(spark, d):
    return merge.retention(_v1(spark, d), "last_updated", SPLIT_TS, 30).select("ord", "last_updated")
