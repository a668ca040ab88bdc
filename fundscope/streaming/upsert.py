"""Structured Streaming forms of the merge (ST-1) and of the category counts (ST-2).

ST-1: records stream in; each micro-batch is de-duplicated (first row per id by event time) and
appended with a left-anti join against those parts of the target table that its ids hash to, exactly the batch RL-4
rule, inside ``foreachBatch``; a batch run again replaces its own rows. The anti-join is the authority (the source system de-duplicates forever); the
optional ``dropDuplicatesWithinWatermark`` only bounds streaming state.

ST-2: tumbling-window counts with a watermark in update mode; every micro-batch appends its updated
counts tagged with the batch id, and readers take the latest count per (window, key). Rows later
than the watermark are dropped by Spark.

Both write under the session's shared checkpoint folder (``spark.checkpoint.dir``), so a lost
executor or a restarted query resumes from the checkpoint instead of starting over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources import storage
from ..sources.storage import exists as _exists


def event_time(spark: SparkSession, ts_col: str):
    """TIMESTAMP event-time column for a TIMESTAMP_NTZ wall-clock read as UTC (watermarks need TIMESTAMP)."""
    tz = spark.conf.get("spark.sql.session.timeZone")
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(ts_col).cast("timestamp_ntz")).cast("timestamp")


def wall_clock(spark: SparkSession, col):
    """Back from an event-time TIMESTAMP to the UTC wall-clock TIMESTAMP_NTZ."""
    tz = spark.conf.get("spark.sql.session.timeZone")
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), col.cast("timestamp_ntz"))


#: Parts of a target by hash of the key.
BUCKETS = 64


def read_target(spark: SparkSession, target: str, columns: T.StructType) -> DataFrame:
    """The target's rows with their batch and bucket (both partition columns); none yet: an empty frame."""
    whole = T.StructType([*columns.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(whole).parquet(target) if _exists(spark, target) else spark.createDataFrame([], whole)


def upsert_batch(batch: DataFrame, target: str, key_cols, order_cols, epoch: int, buckets: int = BUCKETS) -> None:
    """One micro-batch of ST-1: first row per key (by ``order_cols``), minus keys of earlier batches in ``target``.

    The target is partitioned by batch and by bucket of the key's hash: only the buckets that the batch has keys in are
    read (their names are at most ``buckets`` numbers), and of them the key columns. A batch that is run again
    looks at the batches before it alone and replaces what it wrote.
    """
    spark = batch.sparkSession
    batch = batch.drop("_evt")
    cols = [c for c in batch.columns if c not in key_cols]
    first = (batch.groupBy(*key_cols)
             .agg(F.min_by(F.struct(*cols), F.struct(*[F.col(c) for c in order_cols])).alias("r"))
             .select(*key_cols, "r.*").withColumn("bucket", F.pmod(F.xxhash64(*key_cols), F.lit(buckets)).cast("int")))
    first.persist()
    try:
        met = sorted(r[0] for r in first.select("bucket").distinct().collect())
        earlier = read_target(spark, target, batch.schema).filter((F.col("batch") < epoch) & F.col("bucket").isin(met))
        keys = earlier.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key_cols)], F.col("bucket").alias("_b"))
        same = F.col("bucket") == F.col("_b")
        for i, c in enumerate(key_cols):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        new = first.join(keys, same, "left_anti").hint("rebalance", "bucket")
        staged = f"{target}/_staged-{uuid.uuid4().hex}"
        new.write.partitionBy("bucket").parquet(staged)
    finally:
        first.unpersist()
    storage.drop(spark, f"{target}/batch={epoch}")
    storage.move(spark, staged, f"{target}/batch={epoch}")


def stream_upsert(spark: SparkSession, source: DataFrame, key_cols, ts_col: str, order_cols,
                  watermark: str = "1 day", run_dir: str | None = None) -> str:
    """ST-1: run the upsert stream to completion (``availableNow``) and return the target path."""
    run_dir = run_dir or scratch_path(spark, f"stream-upsert-{uuid.uuid4().hex}")
    target, ckpt = f"{run_dir}/table", f"{run_dir}/checkpoint"
    s = source.withColumn("_evt", event_time(spark, ts_col)).withWatermark("_evt", watermark)
    q = (s.writeStream.foreachBatch(lambda df, epoch: upsert_batch(df, target, key_cols, order_cols, epoch))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return target


def stream_counts(spark: SparkSession, source: DataFrame, ts_col: str, key_col: str, window: str = "1 day",
                  watermark: str = "1 hour", run_dir: str | None = None) -> DataFrame:
    """ST-2: windowed counts per key with a watermark; returns the final (latest) count per window and key."""
    run_dir = run_dir or scratch_path(spark, f"stream-counts-{uuid.uuid4().hex}")
    target, ckpt = f"{run_dir}/table", f"{run_dir}/checkpoint"
    counts = (source.withColumn("_evt", event_time(spark, ts_col)).withWatermark("_evt", watermark)
              .groupBy(F.window(F.col("_evt"), window).alias("w"), F.col(key_col))
              .agg(F.count(F.lit(1)).alias("n")))

    def sink(df: DataFrame, epoch: int) -> None:
        (df.select(wall_clock(spark, F.col("w.start")).alias("window_start"), key_col, "n",
                   F.lit(epoch).alias("epoch"))
         .write.mode("append").parquet(target))

    q = (counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if not _exists(spark, target):
        return spark.createDataFrame([], f"window_start timestamp_ntz, {key_col} string, n bigint")
    res = spark.read.parquet(target)
    return (res.groupBy("window_start", key_col).agg(F.max_by("n", "epoch").alias("n"))
            .select("window_start", key_col, "n"))
