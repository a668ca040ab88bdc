"""Vectors for the dashboard rules, search, upsert and frontier operators (FIXTURES §2.7-§2.12)."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from fundscope import schema
from fundscope.functions import derive
from fundscope.operators import frontier, merge, metrics, search

AS_OF = "2025-06-26"
AS_OF_TS = "2025-06-26 12:00:00"


def _records(spark, rows):
    """rows: dicts with a subset of record fields -> record frame in the full schema, with ord."""
    out = []
    for i, r in enumerate(rows):
        out.append(Row(
            id=r.get("id", f"id{i}"), title=r.get("title", f"T{i}"), organization=r.get("organization", "Org"),
            category=r.get("category", "ukri"), subcategory="s", description=r.get("description", ""),
            eligibility=Row(career_stage=r.get("stage"), disciplines=[], requirements=[]),
            funding_details=Row(amount=Row(min=r.get("min", 0), max=r.get("max", 0), currency="GBP",
                                           duration_years=1), covers=[]),
            application=Row(deadline=r.get("deadline"), next_deadline="", frequency="Annual", application_url="",
                            guidelines_url=""),
            key_info=Row(priority_level="", competition_level="", success_rate=""),
            contact=Row(email="", phone=""), tags=r.get("tags", []), last_updated=None, scraped_from="",
            status=r.get("status", "active")))
    df = spark.createDataFrame(out, schema.RECORD)
    return df.withColumn("ord", F.monotonically_increasing_id())


BUCKET_ROWS = [("2025-06-25", "closed", 0, 0, "urgent", "(Closed)"),
               ("2025-06-26", "closing", 0, 0, "urgent", "(Closed)"),
               ("2025-06-27", "closing", 1, 1, "urgent", "(1 days)"),
               ("2025-07-26", "closing", 1, 1, "warning", "(30 days)"),
               ("2025-07-27", "open", 0, 1, "safe", "(31 days)"),
               ("2025-07-28", "open", 0, 0, "safe", "(32 days)"),
               ("N/A", "open", 0, 0, "safe", "(Closed)"),
               ("Rolling", "open", 0, 0, "safe", "(Closed)"),
               ("2024", "closed", 0, 0, "urgent", "(Closed)"),
               (None, "none", 0, 0, "urgent", "(Closed)"),
               ("", "none", 0, 0, "safe", "(Closed)")]


def test_deadline_rules(spark):
    df = _records(spark, [{"deadline": r[0]} for r in BUCKET_ROWS])
    b = [r[0] for r in df.select(metrics.deadline_bucket(F.col("application.deadline"), AS_OF)).collect()]
    assert b == [r[1] for r in BUCKET_ROWS]
    days = derive.days_left(derive.js_date(F.col("application.deadline")), AS_OF)
    soon_col = F.coalesce((days > 0) & (days <= 30), F.lit(False)).cast("int")
    soon = [int(r[0]) for r in df.select(soon_col).collect()]
    assert soon == [r[2] for r in BUCKET_ROWS]
    up = [int(r[0]) for r in df.select(metrics.upcoming_flag(F.col("application.deadline"), AS_OF_TS)
                                       .cast("int")).collect()]
    assert up == [r[3] for r in BUCKET_ROWS]
    cards = search.card_view(df, AS_OF).select("urgency", "deadline_label").collect()
    assert [tuple(c) for c in cards] == [(r[4], r[5]) for r in BUCKET_ROWS]
    counts = metrics.deadline_buckets(df, AS_OF).collect()[0]
    assert sum(counts) == len(BUCKET_ROWS)


def test_value_bands_and_verdict(spark):
    rows = [{"max": 10}] * 4 + [{"max": 100}, {"min": 5, "max": 0}, {"min": 0, "max": 0}]
    bands = metrics.value_bands(_records(spark, rows))
    r = bands.collect()[0]
    assert (r["n"], r["high"], r["medium"], r["low"]) == (6, 1, 0, 5)
    assert r["high"] + r["medium"] + r["low"] == r["n"]
    v = metrics.competition_verdict(bands).collect()[0]
    assert v["competition_level"] == "Low"


def test_funding_range_empty_is_no_data(spark):
    r = metrics.funding_range(_records(spark, [{"min": 0, "max": 0}])).collect()[0]
    assert r["n"] == 0 and r["min_amount"] is None


def test_shares_sum_and_ties(spark):
    rows = [{"category": "b"}, {"category": "a"}, {"category": None}, {"category": ""}, {"category": "a"},
            {"category": "b"}]
    out = metrics.category_share(_records(spark, rows)).collect()
    assert [r["category"] for r in out] == ["b", "a", "Other"]  # ties by first appearance
    assert sum(r["n"] for r in out) == len(rows)


def test_search(spark):
    df = _records(spark, [{"title": "Pay 100% now", "tags": []}, {"title": "Pay 100 now", "tags": []},
                          {"title": "x", "tags": ["fellowship"]}])
    assert search.search_filter(df, "100%").count() == 1
    assert search.search_filter(df, "FELLOW").count() == 1
    assert search.search_filter(df, "").count() == 3


def test_upsert_faithful_and_dedup(spark):
    dl = "2025-01-01"
    base = _records(spark, [{"id": "1", "deadline": dl}])
    batch = _records(spark, [{"id": "1", "deadline": dl}, {"id": "2", "deadline": dl}, {"id": "2", "deadline": dl},
                             {"id": "3", "category": None, "deadline": dl}])
    new, total = merge.upsert_append(base, batch)
    assert sorted(r["id"] for r in new.collect()) == ["2", "2"] and total.count() == 3
    new, total = merge.upsert_append(base, batch, dedupe_batch=True)
    assert [r["id"] for r in new.collect()] == ["2"] and total.count() == 2
    # idempotent on a duplicate-free batch
    again, _ = merge.upsert_append(total, batch, dedupe_batch=True)
    assert again.count() == 0


def test_pagination_cut_vector(spark):
    listing = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s"), (4, "s"), (10, "t"), (11, "t")],
                                    "page_id long, source string")
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "a"), (3, "c"), (4, "d"),
                                   (11, "z")], "page_id long, link string")
    got = sorted(tuple(r) for r in frontier.pagination_cut(listing, links).collect())
    # source t: page 1 (id 10) has no links -> stop at once
    assert got == [("s", "a", 1), ("s", "b", 1), ("s", "c", 2)]
    # no cap on the number of pages: 40 pages with a new link each are all processed
    many = spark.range(40).selectExpr("id AS page_id", "'m' AS source")
    own = spark.range(40).selectExpr("id AS page_id", "concat('l', id) AS link")
    assert frontier.pagination_cut(many, own).count() == 40


def test_frontier_dedup_unique(spark):
    links = spark.createDataFrame([(2, "u", 1, "fr"), (1, "u", 5, "en"), (1, "v", 2, "en"), (3, "v", 1, "en")],
                                  "page_id long, link string, pos int, source string")
    got = sorted(tuple(r) for r in frontier.frontier_dedup(links).collect())
    assert got == [("u", "en", 1, 5), ("v", "en", 1, 2)]


def test_latest_and_changes(spark):
    ev = spark.createDataFrame([(1, 1, "2024-01-01 10:00:00", "a"), (1, 2, "2024-01-01 11:00:00", "a"),
                                (1, 3, "2024-01-02 09:00:00", "b"), (1, 4, "2024-01-03 09:00:00", "b"),
                                (2, 5, "2024-01-01 00:00:00", "a")], "u long, e long, ts string, t string")
    ev = ev.withColumn("ts", F.to_timestamp_ntz("ts"))
    latest = sorted((r["u"], r["e"]) for r in merge.latest_snapshot(ev, "u", ["ts", "e"]).collect())
    assert latest == [(1, 4), (2, 5)]
    ch = sorted((r["e"], r["change"]) for r in merge.snapshot_changes(ev, "u", "ts", "e", ["t"]).collect())
    assert ch == [(1, "new"), (3, "changed"), (5, "new")]


def test_sort_unknown_key_keeps_input_order(spark):
    df = _records(spark, [{"title": "b"}, {"title": "a"}, {"title": "c"}])
    assert [r["title"] for r in search.sort_records(df, "whatever").collect()] == ["b", "a", "c"]
    assert [r["title"] for r in search.sort_records(df, "title").collect()] == ["a", "b", "c"]


def test_unparsed_deadline_option(spark):
    df = _records(spark, [{"deadline": "N/A"}, {"deadline": "Rolling"}, {"deadline": None}])
    r = metrics.deadline_buckets(df, AS_OF, unparsed="none").collect()[0]
    assert (r["open_now"], r["no_deadline"]) == (0, 3)


def test_nested_values_of_other_kinds_are_invalid(spark):
    import json

    from fundscope import rules
    from fundscope.operators import quality

    whole = {k: "x" for k in rules.REQUIRED_STRICT} | {"funding_details": {"amount": None}, "application": {"deadline": None}}
    rows = [(0, json.dumps(whole))] + [(k, json.dumps(whole | {"funding_details": v})) for k, v in enumerate((None, [], "x", {}, 3), 1)]
    got = {r["k"]: (r["valid"], list(r["reasons"])) for r in
           quality.validate_strict(spark.createDataFrame(rows, "k int, value string")).collect()}
    assert got[0] == (True, [])
    assert all(got[k] == (False, ["missing:funding_details.amount"]) for k in range(1, 6))


def test_stream_upsert_does_not_depend_on_file_order(spark, tmp_path):
    from pyspark.sql import functions as F

    from fundscope.streaming import upsert

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type", "event_id", "ts")
    ev.orderBy(F.rand(5)).repartition(5).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    out = upsert.stream_upsert(spark, src, ["user_id", "event_type"], "ts", ["ts", "event_id"], run_dir=str(tmp_path / "run"))
    want = ev.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("user_id", "event_type", "f.event_id", "f.ts")
    got = spark.read.parquet(out).select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_sorts_order_every_row(spark):
    """The whole order of the record view, against a plain sort of the same rows."""
    import datetime as dt

    from fundscope.plans import catalog

    rows = {r["ord"]: r for r in catalog.QUERIES["sort_title"](spark, "/root/testdata/sf0.001").collect()}
    titles = [r["ord"] for r in catalog.QUERIES["sort_title"](spark, "/root/testdata/sf0.001").collect()]
    assert titles == sorted(titles, key=lambda k: (rows[k]["title"], k)) and len(titles) == 1500  # ASCII titles of one case pattern
    amounts = [(r["max_amount"], r["ord"]) for r in catalog.QUERIES["sort_amount"](spark, "/root/testdata/sf0.001").collect()]
    assert amounts == sorted(amounts, key=lambda x: (-x[0], x[1]))
    deadlines = [(r["deadline_date"], r["ord"]) for r in catalog.QUERIES["sort_deadline"](spark, "/root/testdata/sf0.001").collect()]
    assert deadlines == sorted(deadlines, key=lambda x: (x[0] is None, x[0] or dt.date.min, x[1])) and deadlines[-1][0] is None


def test_summary_counts_null_and_the_text_null_together(spark):
    from fundscope.operators import metrics
    from fundscope.plans import views

    v = views.opportunities(spark, "/root/testdata/sf0.001")
    mixed = v.withColumn("category", F.when(F.col("ord") % 5 == 0, F.lit("null")).otherwise(F.col("category")))
    got = metrics.summary_report(mixed, "1998-06-15 12:00:00").first()["category_breakdown"]
    assert got["null"] == mixed.filter("category IS NULL OR category = 'null'").count() and sum(got.values()) == v.count()
