"""Published versions, retention by file and the table laid out by id."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from fundscope.operators import quality, search
from fundscope.session import scratch_path
from fundscope.sources import database, storage


def _dir(spark, name):
    return scratch_path(spark, f"test-{name}-{uuid.uuid4().hex}")


def test_readers_see_whole_versions(spark):
    base = _dir(spark, "db")
    with pytest.raises(FileNotFoundError):
        database.read_version(spark, base)
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert database.publish_version(old, base, "2025-01-01 00:00:00") == 1
    held = database.read_version(spark, base)
    bad = old.withColumn("n", F.when(F.col("id") == "b", F.raise_error(F.lit("boom")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="boom"):
        database.publish_version(bad, base, "2025-01-02 00:00:00")
    assert database.read_version(spark, base).count() == 2  # the failed rewrite is not seen
    assert database.publish_version(old.limit(1), base, "2025-01-03 00:00:00") == 2
    assert (held.count(), database.read_version(spark, base).count(), database.read_version(spark, base, 1).count()) == (2, 1, 2)
    assert tuple(database.read_meta(spark, base).first()) == ("2025-01-03T00:00:00", 1)
    with pytest.raises(Exception):  # of two writers of one number, one wins
        storage.publish(spark, f"{base}/{database.PUBLISHED}/000000002", "other")
    with pytest.raises(FileNotFoundError):
        database.read_version(spark, base, 3)


def test_retention_drops_whole_days_and_touches_no_kept_file(spark):
    path = _dir(spark, "log")
    rows = [(i, f"2024-01-{d:02d} 0{i}:00:00") for d in (1, 9, 10, 11) for i in range(3)] + [(99, None)]
    df = spark.createDataFrame(rows, "event_id int, t string").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    database.write_log(df, path, "ts")

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path.removeprefix("file:")) for f in fs if f.endswith(".parquet")}

    before = files()
    assert database.expire_days(spark, path, "2024-01-12 05:00:00", 2) == ["day=2024-01-01", "day=2024-01-09"]
    after = files()
    assert after == {k: v for k, v in before.items() if "day=2024-01-01" not in k and "day=2024-01-09" not in k}
    assert spark.read.parquet(path).count() == 7
    assert database.expire_days(spark, path, "2024-01-12 05:00:00", 2) == []
    assert database.expire_days(spark, path + "-none", "2024-01-12", 2) == []
    log = spark.read.parquet(path)
    assert database.stale_files(log, "2020-01-01 00:00:00").count() == 0
    assert database.stale_files(log, "2999-01-01 00:00:00").agg(F.sum("n_rows")).first()[0] == 7


def test_lookup_does_not_move_the_table(spark):
    name = f"by_id_{uuid.uuid4().hex}"
    df = spark.range(5000).select(F.concat(F.lit("id"), (F.col("id") % 1000).cast("string")).alias("id"), F.col("id").alias("ord"))
    database.write_by_id(df, name, _dir(spark, "byid"), buckets=8)
    ids = df.filter("ord % 7 = 0").select("id")
    for limit in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            found = search.lookup_by_id(spark.table(name), ids)
            assert {r["id"]: r["ord"] for r in found.collect()} == {f"id{i}": i for i in {x % 1000 for x in range(0, 5000, 7)}}
            plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        table = plan[plan.index("Bucketed: true") - 2000 : plan.index("Bucketed: true")]
        assert "Bucketed: true" in plan
        # exchanges stand above the ids only
        above = [x for x in plan[: plan.index("Bucketed: true")].split("\n") if "Exchange hashpartitioning" in x]
        assert not above, table
    one = search.lookup_by_id(spark.table(name).filter("id = 'id5'"))
    assert one.first()["ord"] == 5 and "SelectedBucketsCount: 1 out of 8" in one._jdf.queryExecution().executedPlan().toString()
    spark.sql(f"DROP TABLE {name}")


def test_gate_scopes(spark):
    rows = spark.createDataFrame([("a", "s1", ["x"]), ("a", "s1", []), ("a", "s2", []), ("b", "t1", ["y", "z"]), ("b", "t1", None), ("b", "t2", []), (None, None, ["q"]), (None, None, [])],
                                 "category string, subcategory string, reasons array<string>").withColumn("i", F.monotonically_increasing_id())
    gated = {scope: [r["verdict"] for r in quality.commit_gate(rows, "reasons", scope={"a": scope}).orderBy("i").collect()] for scope in ("record", "source", "scraper")}
    rest = ["record", "commit", "commit", "record", "commit"]
    assert gated == {"record": ["record", "commit", "commit", *rest], "source": ["source", "source", "commit", *rest], "scraper": ["scraper"] * 3 + rest}


def test_search_index_prunes_and_keeps_every_hit(spark):
    path = _dir(spark, "grams")
    rows = [(i, f"Title {i}", "Örg ÄB" if i % 3 else None, "x" * (i % 5), ["Tag one", None, "ab"] if i % 2 else None, "c", i) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, title string, organization string, description string, tags array<string>, category string, ord long")
    search.write_search_index(df, path)
    for term in ("", "t", "le", "tle", "Title 19", "örg ä", "xxxx", "g on", "1ö", "title 1örg", "zzz", "tag", "%", "ab"):
        want = {r["ord"] for r in search.search_filter(df, term).collect()}
        assert {r["ord"] for r in search.search_indexed(df, path, term).collect()} == want, term
    plan = search.search_indexed(df, path, "title 19")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


def test_stream_batches_read_their_buckets_and_run_again(spark):
    from fundscope.streaming import upsert

    target = _dir(spark, "upsert")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    first, second = rows(("a", 1), ("a", 0), (None, 5), ("b", 2)), rows(("b", 9), ("c", 3), (None, 6), ("c", 4))
    upsert.upsert_batch(first, target, ["k"], ["v"], 0)
    upsert.upsert_batch(second, target, ["k"], ["v"], 1)
    want = [(None, 5), ("a", 0), ("b", 2), ("c", 3)]
    got = lambda: sorted(((r["k"], r["v"]) for r in spark.read.parquet(target).collect()), key=str)
    assert got() == sorted(want, key=str)
    for batch, epoch in ((second, 1), (first, 0), (second, 1)):
        upsert.upsert_batch(batch, target, ["k"], ["v"], epoch)
        assert got() == sorted(want, key=str)


def test_changes_in_batches_equal_one_batch(spark):
    from fundscope.operators import merge

    rows = [(u, i, f"2024-01-0{1 + i // 40} 10:{i % 40:02d}:{i % 7:02d}", "ab"[(i * i + u) % 3 % 2]) for u in range(4) for i in range(120)] + [(None, 1, "2024-01-01 00:00:00", "a")]
    df = spark.createDataFrame(rows, "user_id int, event_id int, t string, c string").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    key = ("user_id", "ts", "event_id", ["c"])
    want = sorted(map(str, merge.snapshot_changes(df, *key).collect()))
    assert sorted(map(str, merge.snapshot_changes(df, *key, bucket="hour", hot=3).collect())) == want
    state, got = None, []
    for low, high in ((0, 50), (50, 51), (51, 120)):
        part = df.filter((F.col("event_id") >= low) & (F.col("event_id") < high))
        got += merge.snapshot_changes(part, *key, bucket="hour", state=state, hot=5).collect()
        state = spark.createDataFrame(merge.entity_state(part, *key, state=state).collect(), "_e int, _t timestamp_ntz, _i int, _h long")
    assert sorted(map(str, got)) == want
    late = merge.snapshot_changes(df.filter("event_id < 2"), *key, state=state).collect()
    assert {r["change"] for r in late} == {"late"} and len(late) == 8
