"""The database as published versions (SNK-2), a log with retention by file (FL-5), and a table laid out by id (FL-6).

SNK-2: a rewrite goes to a folder of its own and is published by one small file that names it. Readers resolve that
file once, so they see the old version or the new, never a half; a rewrite that dies leaves no trace for them.
FL-5: the log is partitioned by day. Days that ended before the cutoff are dropped by name; the files kept are neither
read nor rewritten.
FL-6: the table is bucketed and sorted by id, with Parquet bloom filters on it. A join by id then moves the ids, not
the table, and a lookup of one id opens one bucket and skips the row groups that cannot hold it.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

PUBLISHED = "_published"


def publish_version(df: DataFrame, base: str, as_of_ts: str) -> int:
    """SNK-2: write ``df`` as the next version of the database at ``base`` and publish it; returns its number."""
    spark = df.sparkSession
    folder = f"version-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{folder}/records")
    total = spark.read.parquet(f"{base}/{folder}/records").agg(F.count("*").alias("total_fundings"))
    total.select(F.lit(as_of_ts.replace(" ", "T")).alias("last_updated"), "total_fundings").coalesce(1).write.json(f"{base}/{folder}/meta")
    number = len(versions(spark, base)) + 1
    storage.publish(spark, f"{base}/{PUBLISHED}/{number:09d}", folder)
    return number


def versions(spark: SparkSession, base: str) -> list[str]:
    """Names of the publications, oldest first."""
    return [n for n in storage.names(spark, f"{base}/{PUBLISHED}") if n[0] not in "_."]


def _folder(spark: SparkSession, base: str, version: int | None) -> str | None:
    found = versions(spark, base)
    if not found or (version is not None and f"{version:09d}" not in found):
        return None
    return f"{base}/{storage.read(spark, f'{base}/{PUBLISHED}/' + (f'{version:09d}' if version else found[-1])).strip()}"


def read_version(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The records of a published version (default: the last)."""
    folder = _folder(spark, base, version)
    if folder is None:
        raise FileNotFoundError(f"{base} has no published version {version or ''}")
    return spark.read.parquet(f"{folder}/records")


def read_meta(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """last_updated, total_fundings of a published version."""
    folder = _folder(spark, base, version)
    if folder is None:
        raise FileNotFoundError(f"{base} has no published version {version or ''}")
    return spark.read.schema("last_updated string, total_fundings bigint").json(f"{folder}/meta")


# ------------------------------------------------------------------ FL-5


def write_log(df: DataFrame, path: str, ts_col: str) -> None:
    """Append to a log partitioned by the day of ``ts_col``; null timestamps have a partition of their own."""
    rows = df.withColumn("day", F.to_date(ts_col)).hint("rebalance", "day")
    rows.write.mode("append").partitionBy("day").parquet(path)


def expire_days(spark: SparkSession, path: str, as_of: str, days: int = 30) -> list[str]:
    """FL-5: drop the days of the log that ended before ``as_of`` less ``days``; returns their names. Whole partitions
    go by name; a day that the cutoff falls into stays, and undated rows stay."""
    cutoff = dt.date.fromisoformat(as_of[:10]) - dt.timedelta(days=days)
    gone = []
    for name in storage.names(spark, path):
        key, _, value = name.partition("=")
        try:
            old = key == "day" and dt.date.fromisoformat(value) < cutoff
        except ValueError:
            old = False
        if old and storage.drop(spark, f"{path}/{name}"):
            gone.append(name)
    return gone


def stale_files(df: DataFrame, before_ts: str) -> DataFrame:
    """Files of a file-based frame last written before ``before_ts`` (retention by modification time), with
    their rows: name, modified, n_rows."""
    meta = F.col("_metadata")
    files = df.select(meta["file_path"].alias("name"), meta["file_modification_time"].alias("modified"))
    return files.filter(F.col("modified") < F.to_timestamp(F.lit(before_ts))).groupBy("name", "modified").agg(F.count("*").alias("n_rows"))


# ------------------------------------------------------------------ FL-6


def write_by_id(df: DataFrame, table: str, path: str, buckets: int, id_col: str = "id") -> None:
    """FL-6: store ``df`` as catalog table ``table``, bucketed and sorted by id. Rows are dealt by id first, so each
    bucket is one file and not one of every task."""
    (df.repartition(buckets, F.col(id_col)).write.mode("overwrite").option("path", path)
     .option(f"parquet.bloom.filter.enabled#{id_col}", "true").bucketBy(buckets, id_col).sortBy(id_col).saveAsTable(table))
