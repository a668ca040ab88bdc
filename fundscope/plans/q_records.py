"""Record queries: derivations, enrichment, assembly, JSON scans, validation, sinks
(SC-1..SC-15, EN-1, EN-2, SRC-1, SRC-2, FL-2, FL-3, RL-5, SNK-1, SNK-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules, schema
from ..functions import derive
from ..operators import enrich, quality
from ..sources import records, sinks
from . import oracle_rules as R
from .q_dashboard import DAYS, _amount_text_sql, _date_text_sql, _fmt_sql
from .registry import AS_OF, AS_OF_TS, register
from .registry import v1 as _v1
from .views import _pick

RECORD_COLS = [f.name for f in schema.RECORD.fields]


def _amt():
    return F.col("funding_details.amount")


def _dl():
    return F.col("application.deadline")


# ------------------------------------------------------------------ SC: scalar derivations


@register("content_id", "SELECT ord, id FROM opportunities", "opportunities")
def q_content_id(spark, d):
    return _v1(spark, d).select("ord", derive.content_id(F.col("organization"), F.col("title")).alias("id"))


@register("next_deadline", f"SELECT ord, {R.next_deadline_sql('iso_d', 'frequency')} AS next_deadline FROM opps",
          "opportunities")
def q_next_deadline(spark, d):
    return _v1(spark, d).select("ord", derive.next_deadline(_dl(), F.col("application.frequency")).alias("next_deadline"))


@register("priority_level", f"""
SELECT ord, CASE category WHEN 'ukri' THEN 'High' WHEN 'academies' THEN {R.priority_sql('hi', 'A')}
                          WHEN 'foundations' THEN {R.priority_sql('hi', 'B')} END AS priority_level
FROM opportunities""", "opportunities")
def q_priority_level(spark, d):
    return _v1(spark, d).select("ord", derive.priority_by_category(F.col("category"), _amt()["max"]).alias("priority_level"))


@register("success_rate", f"SELECT ord, {R.success_sql('career_stage')} AS success_rate FROM opportunities",
          "opportunities")
def q_success_rate(spark, d):
    return _v1(spark, d).select("ord", derive.success_rate(F.col("eligibility.career_stage")).alias("success_rate"))


@register("competition_level", f"SELECT ord, {R.competition_sql('success_rate')} AS competition_level "
          "FROM opportunities", "opportunities")
def q_competition_level(spark, d):
    return _v1(spark, d).select("ord", derive.competition_level(F.col("key_info.success_rate"))
                                .alias("competition_level"))


@register("standard_requirements", f"""
SELECT ord, {R.requirements_sql('career_stage', 'A')} AS requirements_a,
       {R.requirements_sql('career_stage', 'B')} AS requirements_b FROM opportunities""", "opportunities")
def q_standard_requirements(spark, d):
    st = F.col("eligibility.career_stage")
    return _v1(spark, d).select("ord", F.array_join(derive.standard_requirements(st, "A"), "; ").alias("requirements_a"),
                                F.array_join(derive.standard_requirements(st, "B"), "; ").alias("requirements_b"))


@register("funding_covers", f"SELECT ord, {R.covers_sql('title')} AS covers_text FROM opportunities", "opportunities")
def q_funding_covers(spark, d):
    return _v1(spark, d).select("ord", F.array_join(derive.funding_covers(F.col("title")), ", ").alias("covers_text"))


@register("source_email", f"SELECT ord, {R.email_sql('scraped_from')} AS email FROM opportunities", "opportunities")
def q_source_email(spark, d):
    return _v1(spark, d).select("ord", derive.source_email(F.col("scraped_from")).alias("email"))


@register("format_deadline", f"SELECT ord, {_date_text_sql('js_d')} AS deadline_text FROM opps", "opportunities")
def q_format_deadline(spark, d):
    return _v1(spark, d).select("ord", derive.format_deadline(derive.js_date(_dl())).alias("deadline_text"))


@register("format_amount", f"SELECT ord, {_fmt_sql('lo')} AS min_text, {_fmt_sql('hi')} AS max_text FROM opportunities",
          "opportunities")
def q_format_amount(spark, d):
    return _v1(spark, d).select("ord", derive.format_amount(_amt()["min"]).alias("min_text"),
                                derive.format_amount(_amt()["max"]).alias("max_text"))


@register("amount_text", f"SELECT ord, {_amount_text_sql('lo', 'hi')} AS amount_text FROM opportunities",
          "opportunities")
def q_amount_text(spark, d):
    return _v1(spark, d).select("ord", derive.amount_text(_amt()["min"], _amt()["max"]).alias("amount_text"))


@register("days_left", f"SELECT ord, CAST({DAYS} AS INTEGER) AS days_left FROM opps", "opportunities")
def q_days_left(spark, d):
    return _v1(spark, d).select("ord", derive.days_left(derive.js_date(_dl()), AS_OF).alias("days_left"))


# ------------------------------------------------------------------ EN: enrichment and assembly

SOURCE_IDS = [r[0] for r in records.dimension_rows()]
ACADEMY_IDS = [a[0] for a in rules.ACADEMIES]
FOUNDATION_IDS = [f[0] for f in rules.FOUNDATIONS]


@register("enrich_source", f"""
SELECT o.ord, dims.name AS organization, dims.kind AS category, dims.source_id AS subcategory,
       CASE WHEN dims.kind = 'ukri' THEN o.discipline ELSE dims.disciplines_text END AS disciplines_text
FROM (SELECT *, {R.pick_sql(SOURCE_IDS, 'ord % 17')} AS source_id FROM opportunities) o
JOIN {R.dims_sql()} ON o.source_id = dims.source_id""", "opportunities")
def q_enrich_source(spark, d):
    rec = _v1(spark, d).withColumn("source_id", _pick(SOURCE_IDS, F.col("ord") % 17))
    out = enrich.enrich_source(rec, records.dimensions(spark))
    return out.select("ord", "organization", "category", "subcategory",
                      F.array_join("eligibility.disciplines", ", ").alias("disciplines_text"))


_ACAD = "s.category = 'academies'"


@register("assemble_record", f"""
WITH s AS (
  SELECT o.*, CASE WHEN o.category = 'academies' THEN {R.pick_sql(ACADEMY_IDS, 'o.ord % 4')}
                   ELSE {R.pick_sql(FOUNDATION_IDS, 'o.ord % 4')} END AS source_id
  FROM opps o WHERE o.category IN ('academies', 'foundations'))
SELECT s.ord,
       CASE WHEN {_ACAD} THEN {R.content_id_sql("'Academy'", 's.title')}
            ELSE {R.content_id_sql("'Foundation'", 's.title')} END AS id,
       dims.name AS organization, s.source_id AS subcategory, dims.disciplines_text,
       CASE WHEN {_ACAD} THEN {R.requirements_sql('s.career_stage', 'A')}
            ELSE {R.requirements_sql('s.career_stage', 'B')} END AS requirements_text,
       CASE WHEN {_ACAD} THEN {R.q(', '.join(rules.COVERS_ACADEMIES))} ELSE {R.covers_sql('s.title')} END AS covers_text,
       {R.next_deadline_sql('s.iso_d', 's.frequency')} AS next_deadline,
       CASE WHEN {_ACAD} THEN {R.priority_sql('s.hi', 'A')} ELSE {R.priority_sql('s.hi', 'B')} END AS priority_level,
       CASE WHEN {_ACAD} THEN 'Very Competitive' ELSE {R.competition_sql('s.success_rate')} END AS competition_level,
       CASE WHEN {_ACAD} THEN {R.success_sql('s.career_stage')} ELSE s.success_rate END AS success_rate,
       CASE WHEN {_ACAD} THEN '' ELSE {R.email_sql('dims.base_url')} END AS email,
       CASE WHEN {_ACAD} THEN '' ELSE dims.base_url END AS application_url
FROM s JOIN {R.dims_sql()} ON s.source_id = dims.source_id""", "opportunities")
def q_assemble_record(spark, d):
    v = _v1(spark, d).filter(F.col("category").isin("academies", "foundations"))
    sid = F.when(F.col("category") == "academies", _pick(ACADEMY_IDS, F.col("ord") % 4)).otherwise(
        _pick(FOUNDATION_IDS, F.col("ord") % 4))
    schemes = v.select("ord", sid.alias("source_id"), "title", "description", "category",
                       F.col("eligibility.career_stage").alias("career_stage"), _amt()["min"].alias("amount_min"),
                       _amt()["max"].alias("amount_max"), _amt()["duration_years"].alias("duration_years"),
                       _dl().alias("deadline"), F.col("application.frequency").alias("frequency"), "tags",
                       F.col("key_info.success_rate").alias("success_rate"))
    dims = records.dimensions(spark)
    schemes = schemes.join(dims.select("source_id", "base_url"), "source_id")
    acad = enrich.assemble_record(schemes.filter(F.col("category") == "academies"), "academies", AS_OF_TS)
    fnd = enrich.assemble_record(schemes.filter(F.col("category") == "foundations"), "foundations", AS_OF_TS)
    rec = enrich.enrich_source(acad.unionByName(fnd), dims)
    return rec.select(
        "ord", "id", "organization", "subcategory",
        F.array_join("eligibility.disciplines", ", ").alias("disciplines_text"),
        F.array_join("eligibility.requirements", "; ").alias("requirements_text"),
        F.array_join("funding_details.covers", ", ").alias("covers_text"),
        F.col("application.next_deadline").alias("next_deadline"),
        F.col("key_info.priority_level").alias("priority_level"),
        F.col("key_info.competition_level").alias("competition_level"),
        F.col("key_info.success_rate").alias("success_rate"),
        F.col("contact.email").alias("email"),
        F.col("application.application_url").alias("application_url"))


# ------------------------------------------------------------------ SRC / SNK: scans and sinks


def _v1_json(spark, d):
    """V1 records as JSON text, the way a writer that omits null fields stores them."""
    return quality.as_json(_v1(spark, d), RECORD_COLS)


@register("scan_records", """
SELECT ord, id, title, category, deadline, lo AS min_amount, hi AS max_amount, career_stage,
       tag1 || ',' || tag2 AS tags_text, last_updated FROM opportunities""", "opportunities")
def q_scan_records(spark, d):
    r = _v1_json(spark, d).select("ord", records.parse_records(F.col("value")).alias("r")).select("ord", "r.*")
    return r.select("ord", "id", "title", "category", _dl().alias("deadline"), _amt()["min"].alias("min_amount"),
                    _amt()["max"].alias("max_amount"), F.col("eligibility.career_stage").alias("career_stage"),
                    F.array_join("tags", ",").alias("tags_text"), "last_updated")


@register("scan_record_files", """
SELECT id, title, category, deadline, lo AS min_amount, hi AS max_amount, career_stage,
       tag1 || ',' || tag2 AS tags_text, last_updated FROM opportunities""", "opportunities")
def q_scan_record_files(spark, d):
    """SRC-1 through files: V1 written as JSON lines (one record per line, null fields omitted) under the
    shared checkpoint folder, then read back with the explicit record schema; JSON lines split across
    tasks, unlike one multi-line document per file."""
    import uuid

    from ..session import scratch_path

    path = scratch_path(spark, f"record-files-{uuid.uuid4().hex}")
    _v1(spark, d).select(*RECORD_COLS).write.json(path)
    r = records.scan_records(spark, path, multiline=False)
    return r.select("id", "title", "category", _dl().alias("deadline"), _amt()["min"].alias("min_amount"),
                    _amt()["max"].alias("max_amount"), F.col("eligibility.career_stage").alias("career_stage"),
                    F.array_join("tags", ",").alias("tags_text"), "last_updated")


ENVELOPE_CHUNK = 1000


@register("scan_envelope", "SELECT id, title, organization FROM opportunities", "opportunities")
def q_scan_envelope(spark, d):
    """Envelopes of at most ENVELOPE_CHUNK records each (keyed by ordinal range), written as JSON text and
    read back through the envelope schema; each envelope is one bounded group."""
    v = _v1(spark, d)
    env = (v.groupBy(F.floor(F.col("ord") / ENVELOPE_CHUNK).alias("chunk"))
           .agg(F.count(F.lit(1)).alias("total_fundings"), F.collect_list(F.struct(*RECORD_COLS)).alias("fundings"))
           .select(F.lit(AS_OF_TS.replace(" ", "T")).alias("last_updated"), "total_fundings", "fundings"))
    text = env.select(F.to_json(F.struct("last_updated", "total_fundings", "fundings")).alias("value"))
    parsed = text.select(F.from_json("value", schema.ENVELOPE).alias("e")).select("e.*")
    return records.explode_envelope(parsed).select("id", "title", "organization")


@register("scan_envelope_files", "SELECT id, title, organization, hi AS max_amount, deadline, last_updated FROM opportunities", "opportunities")
def q_scan_envelope_files(spark, d):
    """SRC-2 through files: envelopes of at most ENVELOPE_CHUNK records, one a line, written and read back by the reader."""
    import uuid

    from ..session import scratch_path

    path = scratch_path(spark, f"envelope-files-{uuid.uuid4().hex}")
    env = (_v1(spark, d).groupBy(F.floor(F.col("ord") / ENVELOPE_CHUNK).alias("chunk"))
           .agg(F.count(F.lit(1)).alias("total_fundings"), F.collect_list(F.struct(*RECORD_COLS)).alias("fundings")))
    env.select(F.lit(AS_OF_TS.replace(" ", "T")).alias("last_updated"), "total_fundings", "fundings").write.json(path)
    r = records.scan_envelope(spark, path, multiline=False)
    return r.select("id", "title", "organization", _amt()["max"].alias("max_amount"), _dl().alias("deadline"), "last_updated")


@register("record_key", "SELECT ord, concat_ws('_', category, subcategory, id) AS record_key FROM opportunities",
          "opportunities")
def q_record_key(spark, d):
    return sinks.with_record_key(_v1(spark, d)).select("ord", "record_key")


@register("envelope_meta", f"""
SELECT '{AS_OF_TS.replace(' ', 'T')}' AS last_updated, count(*) AS total_fundings,
       max(last_updated) AS max_record_updated FROM opportunities""", "opportunities")
def q_envelope_meta(spark, d):
    return sinks.envelope_meta(_v1(spark, d), AS_OF_TS)


# ------------------------------------------------------------------ FL-2 / FL-3 / RL-5: validation

_REASONS = ("concat_ws(',', CASE WHEN category IS NULL THEN 'missing:category' END, "
            "CASE WHEN deadline IS NULL THEN 'missing:application.deadline' END)")


@register("validate_strict", f"""
SELECT ord, (category IS NOT NULL AND deadline IS NOT NULL) AS valid, {_REASONS} AS reasons_text
FROM opportunities""", "opportunities")
def q_validate_strict(spark, d):
    v = quality.validate_strict(_v1_json(spark, d))
    return v.select("ord", "valid", F.array_join("reasons", ",").alias("reasons_text"))


@register("validate_report", """
SELECT count(*) FILTER (WHERE category IS NOT NULL) AS valid_count, count(*) AS total,
       count(*) FILTER (WHERE category IS NOT NULL) = count(*) AS ok FROM opportunities""", "opportunities")
def q_validate_report(spark, d):
    return quality.validate_report(_v1_json(spark, d))


@register("quarantine", f"""
SELECT ord, {_REASONS} AS reasons_text FROM opportunities WHERE category IS NULL OR deadline IS NULL""",
          "opportunities")
def q_quarantine(spark, d):
    _valid, rejected = quality.split_valid(_v1_json(spark, d))
    return rejected.select("ord", F.array_join("reasons", ",").alias("reasons_text"))
