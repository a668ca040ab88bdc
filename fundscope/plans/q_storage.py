"""Queries that write and read back: the commit gate (RL-5), the record sink (SNK-1), database versions (SNK-2), log
retention by file (FL-5), the table laid out by id (FL-6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import merge, quality, search
from ..session import scratch_path
from ..sources import database, sinks
from ..sources.tables import load
from .q_merge import EVENTS_AS_OF, RETENTION_DAYS, SPLIT_TS, _BASE, _BATCH, _split
from .registry import AS_OF_TS, register
from .registry import v1 as _v1
from .views import CATEGORIES

# the sources whose deadlines are held to be dates: a bad one stops the record of the first, the source of the others
_FAILING = "regexp_matches(subcategory, '[79]$') AND deadline IS NOT NULL AND NOT regexp_matches(deadline, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')"


@register("source_gate", f"""
WITH tagged AS (SELECT ord, category, subcategory, {_FAILING} AS bad FROM opportunities),
per AS (SELECT category, subcategory, count(*) FILTER (WHERE bad) AS n FROM tagged GROUP BY ALL)
SELECT ord, CASE WHEN tagged.category IN ('academies', 'foundations') AND n > 0 THEN 'source' WHEN bad AND COALESCE(tagged.category, 'ukri') = 'ukri' THEN 'record' ELSE 'commit' END AS verdict,
  CASE WHEN tagged.category IN ('academies', 'foundations') THEN n WHEN bad THEN 1 ELSE 0 END AS failed,
  CASE WHEN bad THEN 'deadline:no date' ELSE '' END AS reasons_text
FROM tagged JOIN per ON tagged.category IS NOT DISTINCT FROM per.category AND tagged.subcategory = per.subcategory""", "opportunities")
def q_source_gate(spark, d):
    v = _v1(spark, d).select("ord", "category", "subcategory", F.col("application.deadline").alias("deadline"))
    bad = F.col("subcategory").rlike("[79]$") & F.col("deadline").isNotNull() & ~F.col("deadline").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    v = v.withColumn("reasons", F.when(bad, F.array(F.lit("deadline:no date"))).otherwise(F.array().cast("array<string>")))
    return quality.commit_gate(v, "reasons").select("ord", "verdict", "failed", F.array_join("reasons", ",").alias("reasons_text"))


@register("scraper_gate", f"""
WITH tagged AS (SELECT ord, category, {_FAILING} AND category = 'foundations' AS bad FROM opportunities),
per AS (SELECT category, count(*) FILTER (WHERE bad) AS n FROM tagged GROUP BY category)
SELECT COALESCE(tagged.category, '') AS category, CASE WHEN n > 0 THEN 'scraper' ELSE 'commit' END AS verdict, count(*) AS n_rows, max(n) AS failed
FROM tagged JOIN per ON tagged.category IS NOT DISTINCT FROM per.category GROUP BY 1, 2""", "opportunities")
def q_scraper_gate(spark, d):
    """A scraper that fails takes all its sources along; the others go on."""
    v = _v1(spark, d).select("category", "subcategory", F.col("application.deadline").alias("deadline"))
    bad = (F.col("category") == "foundations") & F.col("subcategory").rlike("[79]$") & F.col("deadline").isNotNull() & ~F.col("deadline").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    v = v.withColumn("reasons", F.when(bad, F.array(F.lit("deadline:no date"))))
    gated = quality.commit_gate(v, "reasons", scope=dict.fromkeys(CATEGORIES, "scraper"))
    return gated.groupBy(F.coalesce("category", F.lit("")).alias("category"), "verdict").agg(F.count("*").alias("n_rows"), F.max("failed").alias("failed"))


@register("record_sink", f"""
SELECT ord, concat_ws('_', category, subcategory, id) AS record_key, category, CASE WHEN last_updated < TIMESTAMP '{SPLIT_TS}' THEN 'run1' ELSE 'run2' END AS run
FROM opportunities""", "opportunities")
def q_record_sink(spark, d):
    """Two runs, the first written twice: each record is there once."""
    path = scratch_path(spark, f"record-sink-{uuid.uuid4().hex}")
    base, batch = _split(spark, d)
    for rows, run in ((base, "run1"), (batch, "run2"), (base, "run1")):
        sinks.write_records(rows, path, run)
    return spark.read.parquet(path).select("ord", "record_key", "category", "run")


@register("database_versions", f"""
SELECT ord, id, 1 AS version, (SELECT count(*) FROM ({_BASE})) AS total_fundings FROM ({_BASE})
UNION ALL
SELECT ord, id, 2, (SELECT count(*) FROM ({_BASE})) + (SELECT count(*) FROM ({_BATCH}) b WHERE b.id NOT IN (SELECT id FROM ({_BASE})))
FROM (SELECT ord, id FROM ({_BASE}) UNION ALL SELECT ord, id FROM ({_BATCH}) b WHERE b.id NOT IN (SELECT id FROM ({_BASE})))""", "opportunities")
def q_database_versions(spark, d):
    """The database is rewritten with the new batch; both versions stay readable."""
    path = scratch_path(spark, f"database-{uuid.uuid4().hex}")
    base, batch = _split(spark, d)
    database.publish_version(base, path, SPLIT_TS)
    _, whole = merge.upsert_append(database.read_version(spark, path), batch)
    database.publish_version(whole, path, AS_OF_TS)
    out = None
    for version in (1, 2):
        rows = database.read_version(spark, path, version).select("ord", "id", F.lit(version).alias("version"))
        rows = rows.crossJoin(F.broadcast(database.read_meta(spark, path, version).select("total_fundings")))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("expire_log", f"""
SELECT event_id, ts, CAST(ts AS DATE) AS day FROM events
WHERE CAST(ts AS DATE) >= CAST(TIMESTAMP '{EVENTS_AS_OF}' AS DATE) - {RETENTION_DAYS}""")
def q_expire_log(spark, d):
    path = scratch_path(spark, f"event-log-{uuid.uuid4().hex}")
    database.write_log(load(spark, d, "events").select("event_id", "ts"), path, "ts")
    database.expire_days(spark, path, EVENTS_AS_OF, RETENTION_DAYS)
    return spark.read.schema("event_id bigint, ts timestamp_ntz, day date").parquet(path)


@register("point_lookup", """
SELECT o.id, min(o.ord) AS ord, arg_min(o.title, o.ord) AS title
FROM opportunities o WHERE o.id IN (SELECT p.id FROM opportunities p JOIN orders r ON r.o_orderkey = p.ord WHERE r.o_orderstatus = 'P') GROUP BY o.id""", "opportunities")
def q_point_lookup(spark, d):
    """First record of each id that an order still in process names, from the table laid out by id."""
    name = f"records_by_id_{uuid.uuid4().hex}"
    v = _v1(spark, d).select("id", "ord", "title")
    database.write_by_id(v, name, scratch_path(spark, name), buckets=16)
    ids = v.join(load(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("ord")), "ord", "left_semi").select("id")
    return search.lookup_by_id(spark.table(name), ids).select("id", "ord", "title")


SEARCH_TERMS = ["q", "Fe", "NATION_1", "fellow", "g work in", "no such thing"]


@register("search_index", f"""
SELECT term, ord FROM opportunities, (VALUES {', '.join(f"('{t}')" for t in SEARCH_TERMS)}) AS terms(term)
WHERE contains(lower(title), lower(term)) OR contains(lower(organization), lower(term)) OR contains(lower(description), lower(term))
   OR contains(lower(tag1), lower(term)) OR contains(lower(tag2), lower(term))""", "opportunities")
def q_search_index(spark, d):
    """Terms of one, two, three and more characters, and one that no record holds, through the index."""
    path = scratch_path(spark, f"search-index-{uuid.uuid4().hex}")
    v = _v1(spark, d)
    search.write_search_index(v, path)
    out = None
    for term in SEARCH_TERMS:
        rows = search.search_indexed(v, path, term).select(F.lit(term).alias("term"), "ord")
        out = rows if out is None else out.unionByName(rows)
    return out
