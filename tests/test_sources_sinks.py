"""Sources and sinks: seeds through EN-2, JSON record / envelope files, validation, partitioned writes."""

import json
import os
import re
import uuid

from pyspark.sql import functions as F

from fundscope import schema
from fundscope.operators import enrich, quality
from fundscope.session import scratch_path
from fundscope.sources import records, sinks


def _dir(spark, name):
    d = scratch_path(spark, f"test-{name}-{uuid.uuid4().hex}")
    os.makedirs(d, exist_ok=True)
    return d


def test_seed_schemes_assemble(spark):
    seeds = records.seed_schemes(spark)
    assert seeds.count() == 12
    dims = records.dimensions(spark)
    s = seeds.join(F.broadcast(dims.select("source_id", "base_url", F.col("kind").alias("family"))), "source_id")
    acad = enrich.assemble_record(s.filter("family = 'academies'"), "academies", "2025-06-26 12:00:00")
    fnd = enrich.assemble_record(s.filter("family = 'foundations'"), "foundations", "2025-06-26 12:00:00")
    rec = enrich.enrich_source(acad.unionByName(fnd), dims)
    rows = {r["title"]: r for r in rec.collect()}
    rg = rows["Research Grants"]
    assert rg["id"] == "academy_research_grants_d955d6660e7f11f9f083faf13150479b"
    assert rg["organization"] == "The Royal Society" and rg["subcategory"] == "royal_society"
    assert rg["application"]["next_deadline"] == "2024-11-26"  # Bi-annual: +180 days
    assert rg["key_info"]["priority_level"] == "High" and rg["key_info"]["success_rate"] == "18%"
    assert rg["eligibility"]["disciplines"] == ["Natural Sciences", "Engineering", "Mathematics"]
    w = rows["Research Excellence Awards"]
    assert w["application"]["next_deadline"] is None  # 'N/A' deadline: null instead of a failed source
    assert w["key_info"]["priority_level"] == "Very High" and w["key_info"]["competition_level"] is None
    assert w["contact"]["email"] == "info@wolfson.org.uk"
    assert w["funding_details"]["covers"] == ["Research costs", "Equipment", "Travel", "Consumables"]


GOOD = {"id": "a", "title": "T", "organization": "O", "category": "ukri", "description": "",
        "eligibility": {"career_stage": "Senior"}, "funding_details": {"amount": {"min": 1, "max": 2}},
        "application": {"deadline": None}, "extra": {"x": 1}}
BAD = {"id": "b"}


def test_json_scans_and_validation(spark):
    d = _dir(spark, "json")
    with open(os.path.join(d, "r1.json"), "w") as f:
        json.dump(GOOD, f)
    with open(os.path.join(d, "r2.json"), "w") as f:
        f.write("{not json")
    got = records.scan_records(spark, d)
    assert got.count() == 2
    rows = got.select("id", records.CORRUPT).collect()
    assert sum(1 for r in rows if r[records.CORRUPT] is not None) == 1
    assert sorted(r["id"] for r in rows if r["id"]) == ["a"]
    assert records.scan_records(spark, os.path.join(d, "missing")).count() == 0
    vals = spark.createDataFrame([(json.dumps(GOOD),), (json.dumps(BAD),), ("{oops",)], "value string")
    v = quality.validate_strict(vals).select("valid", "reasons").collect()
    assert v[0]["valid"] is True  # a null deadline is present, so valid
    assert v[1]["valid"] is False and v[1]["reasons"][0] == "missing:title"
    assert v[2]["valid"] is False and len(v[2]["reasons"]) == 10
    rep = quality.validate_report(vals).collect()[0]
    assert (rep["valid_count"], rep["total"], rep["ok"]) == (1, 3, False)


def test_envelope_scan(spark):
    d = _dir(spark, "env")
    env = {"last_updated": "2025-06-26T12:00:00", "total_fundings": 1, "fundings": [GOOD]}
    with open(os.path.join(d, "db.json"), "w") as f:
        json.dump(env, f, indent=2)
    with open(os.path.join(d, "empty.json"), "w") as f:
        json.dump({"last_updated": "x", "total_fundings": 0}, f)
    rows = records.scan_envelope(spark, d).collect()
    assert [r["id"] for r in rows] == ["a"]


def test_record_sink_partitioned(spark):
    d = _dir(spark, "sink")
    rec = spark.createDataFrame([("a", "ukri", "mrc"), ("b", "academies", "royal_society")],
                                "id string, category string, subcategory string")
    sinks.write_records(rec, d, "r1")
    sinks.write_records(rec, d, "r1")  # the run again: the same rows
    sinks.write_records(rec.limit(1), d, "r2")
    assert spark.read.parquet(d).count() == 3
    sinks.write_records(rec.filter("id = 'b'"), d, "r2")
    back = spark.read.parquet(d)
    assert sorted((r["run"], r["id"]) for r in back.collect()) == [("r1", "a"), ("r1", "b"), ("r2", "b")]
    back = back.filter("run = 'r1'")
    assert sorted(r["record_key"] for r in back.collect()) == ["academies_royal_society_b", "ukri_mrc_a"]
    plan = back.filter("category = 'ukri'")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\n]*category#\d+ = ukri", plan)
    summary = spark.createDataFrame([(1,)], "total_opportunities long")
    sinks.write_summary(summary, os.path.join(d, "_summary"))
    assert spark.read.json(os.path.join(d, "_summary")).count() == 1


def test_record_schema_roundtrip(spark):
    df = spark.createDataFrame([(json.dumps(GOOD),)], "value string")
    r = df.select(records.parse_records(F.col("value")).alias("r")).select("r.*").collect()[0]
    assert r["eligibility"]["career_stage"] == "Senior" and r["application"]["deadline"] is None
    assert set(schema.RECORD.fieldNames()) <= set(r.asDict())


def test_run_update_appends_new_ids_only(spark):
    from fundscope.operators import merge
    from fundscope.plans import update, views

    table = _dir(spark, "update") + "/records"
    v = views.opportunities(spark, "/root/testdata/sf0.001")
    first = v.filter(F.col("last_updated") < F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00")))
    r1 = update.run_update(spark, first, table, "1998-06-15 12:00:00")
    n1 = update.read_table(spark, table).count()
    assert n1 == first.filter(merge.record_valid(first)).count()  # empty base: every valid row (dups kept)
    assert r1["summary"].collect()[0]["total_opportunities"] == first.count()
    seen = {r["id"] for r in update.read_table(spark, table).select("id").collect()}
    valid_all = v.filter(merge.record_valid(v)).select("id").collect()
    expected_new = sum(1 for r in valid_all if r["id"] not in seen)
    update.run_update(spark, v, table, "1998-06-16 12:00:00")
    update.run_update(spark, v, table, "1998-06-16 12:00:00")  # the run again: its rows once
    n2 = update.read_table(spark, table).count()
    assert n2 == n1 + expected_new
    update.run_update(spark, v, table, "1998-06-17 12:00:00", dedupe_batch=True)  # nothing new: idempotent
    assert update.read_table(spark, table).count() == n2
    latest = update.read_latest(spark, table)
    assert latest.count() == latest.select("id").distinct().count()
