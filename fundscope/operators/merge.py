"""Merging batches into the de-duplicated table (RL-1, RL-4, RL-6, RL-7, FL-5).

- RL-1 union of sources keeps a ``source_rank`` so "first source wins" stays expressible.
- RL-4 upsert-append is a left-anti join on ``id`` (AQE picks broadcast or sort-merge at run time).
- RL-6 latest snapshot per entity is a ``max_by`` aggregate: partial aggregation per task, so a hot
  entity never sits whole in one task.
- RL-7 change detection compares each snapshot with its predecessor. The comparison is split by
  time bucket (hour in the registered query): ``lag`` runs inside (entity, bucket) groups, and the first row of a bucket is
  compared with the last row of the entity's previous bucket, taken from a per-bucket ``max_by``
  aggregate (one row per entity and bucket). A hot entity is therefore spread over many groups; a hot bucket of one
  is split by minutes, then seconds. Batches go on from a stored state of one row per entity.
- FL-5 retention is a filter on the record timestamp (pushed into the parquet scan).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """RL-1: union in the given source order, tagging each row with ``source_rank``."""
    tagged = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(frames.values())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def record_valid(df: DataFrame) -> Column:
    """FL-2 for typed tables (where missing and null coincide): required fields present."""
    cond = F.lit(True)
    for c in ("id", "title", "organization", "category", "description", "eligibility", "funding_details",
              "application", "funding_details.amount", "application.deadline"):
        cond = cond & F.col(c).isNotNull()
    return cond


def upsert_append(base: DataFrame, batch: DataFrame, dedupe_batch: bool = False,
                  order_col: str = "ord") -> tuple[DataFrame, DataFrame]:
    """RL-4: append the valid batch rows whose id is not in ``base``; existing rows are never updated.

    Faithful default: duplicates inside the batch are all appended (the id set is not grown inside
    the batch). ``dedupe_batch=True`` keeps the first row per id (lowest ``order_col``).
    Returns (new_rows, base ∪ new_rows).
    """
    cand = batch.filter(record_valid(batch))
    if dedupe_batch:
        cols = [c for c in cand.columns if c != "id"]
        cand = cand.groupBy("id").agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("r")).select("id", "r.*")
    new = cand.join(base.select("id"), "id", "left_anti")  # anti join: duplicate base ids need no distinct
    return new, base.unionByName(new.select(*base.columns))


def latest_snapshot(df: DataFrame, entity, order_cols) -> DataFrame:
    """RL-6: the latest row per entity by ``order_cols`` (ties broken by the later columns)."""
    entity = [entity] if isinstance(entity, str) else list(entity)
    cols = [c for c in df.columns if c not in entity]
    key = F.struct(*[F.col(c) for c in order_cols])
    return df.groupBy(*entity).agg(F.max_by(F.struct(*cols), key).alias("r")).select(*entity, "r.*")


#: Rows of one entity and bucket from which the bucket is split by minutes, and a minute by seconds.
HOT_BUCKET = 50_000


def _buckets(rows: DataFrame, bucket: str, hot: int) -> DataFrame:
    """Adds _b, the start of the row's time bucket: finer ones where an entity has more than ``hot`` rows in one."""
    rows = rows.withColumn("_b", F.date_trunc(bucket, F.col("_t")))
    for finer in ("minute", "second"):
        many = rows.groupBy("_e", "_b").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select("_e", "_b", F.lit(True).alias("_many"))
        rows = rows.join(many, ["_e", "_b"], "left").withColumn("_b", F.when(F.col("_many"), F.date_trunc(finer, F.col("_t"))).otherwise(F.col("_b"))).drop("_many")
    return rows


def snapshot_changes(df: DataFrame, entity: str, ts: str, tiebreak: str, content_cols, bucket: str = "day",
                     state: DataFrame | None = None, hot: int | None = None) -> DataFrame:
    """RL-7: rows whose content hash differs from the entity's previous row ('changed') or that have no
    previous row ('new'); unchanged rows are dropped. ``bucket`` is the time unit of the split; with ``hot`` given,
    buckets with more rows of one entity are split further. Null entities are no entity.

    ``state`` (from ``entity_state``) is what is known of each entity from earlier batches: its row is the previous one
    of the batch's first. Rows not after it are 'late': they are reported, not compared.
    """
    h = F.xxhash64(*[F.col(c) for c in content_cols])
    rows = df.select(F.col(entity).alias("_e"), F.col(ts).alias("_t"), F.col(tiebreak).alias("_i"), h.alias("_h")).filter(F.col("_e").isNotNull())
    if state is not None:
        rows = rows.join(state.select("_e", F.col("_t").alias("_st"), F.col("_i").alias("_si"), F.col("_h").alias("_sh")), "_e", "left")
        rows = rows.withColumn("_late", F.coalesce(F.struct("_t", "_i") <= F.struct(F.col("_st").alias("_t"), F.col("_si").alias("_i")), F.lit(False)) & F.col("_st").isNotNull())
    else:
        rows = rows.withColumns({"_sh": F.lit(None).cast("bigint"), "_late": F.lit(False)})
    late = rows.filter("_late")
    rows = rows.filter(~F.col("_late"))
    rows = rows.withColumn("_b", F.date_trunc(bucket, F.col("_t"))) if hot is None else _buckets(rows, bucket, hot)
    w = Window.partitionBy("_e", "_b").orderBy("_t", "_i")
    last = rows.groupBy("_e", "_b").agg(F.max_by("_h", F.struct("_t", "_i")).alias("_last"))
    rows = rows.withColumn("_prev", F.lag("_h").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    wb = Window.partitionBy("_e").orderBy("_b")
    prev_bucket = last.select("_e", "_b", F.lag("_last").over(wb).alias("_pb"))
    j = rows.join(prev_bucket, ["_e", "_b"], "left")
    prev = F.when(F.col("_first"), F.coalesce("_pb", "_sh")).otherwise(F.col("_prev"))
    change = F.when(prev.isNull(), F.lit("new")).when(prev != F.col("_h"), F.lit("changed"))
    out = j.select("_e", "_i", "_t", change.alias("change")).filter(F.col("change").isNotNull())
    if state is not None:
        out = out.unionByName(late.select("_e", "_i", "_t", F.lit("late").alias("change")))
    return out.select(F.col("_e").alias(entity), F.col("_i").alias(tiebreak), F.col("_t").alias(ts), "change")


def entity_state(df: DataFrame, entity: str, ts: str, tiebreak: str, content_cols, state: DataFrame | None = None) -> DataFrame:
    """RL-7: the last row of each entity as (_e, _t, _i, _h), merged with an earlier ``state``; a row per entity."""
    h = F.xxhash64(*[F.col(c) for c in content_cols])
    rows = df.select(F.col(entity).alias("_e"), F.col(ts).alias("_t"), F.col(tiebreak).alias("_i"), h.alias("_h")).filter(F.col("_e").isNotNull())
    if state is not None:
        rows = rows.unionByName(state)
    return rows.groupBy("_e").agg(F.max(F.struct("_t", "_i", "_h")).alias("r")).select("_e", "r.*")


def retention(df: DataFrame, ts_col: str, as_of_ts: str, days: int = 30) -> DataFrame:
    """FL-5: keep rows whose timestamp is within ``days`` of ``as_of_ts`` (older ones are dropped)."""
    cutoff = F.to_timestamp_ntz(F.lit(as_of_ts)) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.filter(F.col(ts_col) >= cutoff)
