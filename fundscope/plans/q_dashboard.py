"""Dashboard queries: aggregations, search, sorts and views (AG-*, FL-1/4/6/7, SO-*, PR-*).

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables (through the binding
views of ``plans/views.py``); its oracle is an independent DuckDB statement over the same parquet
tables (the flat twins of ``plans/oracle_views.py``). Column names are aliased identically on both
sides. Arrays are compared as joined strings; averages are rounded to 6 digits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, search

from .registry import AS_OF, AS_OF_TS, D_AS_OF, register
from .registry import v1 as _v1

# SQL fragments shared by several oracles (DuckDB dialect)
DAYS = f"date_diff('day', {D_AS_OF}, js_d)"
UPCOMING = f"(date_diff('day', {D_AS_OF}, iso_d) - 1) BETWEEN 0 AND 30"


def _fmt_sql(x: str) -> str:
    """DuckDB twin of derive.format_amount."""
    v = f"(CASE WHEN CAST({x} AS DOUBLE) > 1000000 THEN CAST({x} AS DOUBLE) / 100 ELSE CAST({x} AS DOUBLE) END)"
    return f"regexp_replace(format('{{:,.3f}}', {v}), '\\.?0+$', '')"


def _amount_text_sql(lo: str, hi: str) -> str:
    return (f"(CASE WHEN {lo} = {hi} THEN '£' || {_fmt_sql(hi)} "
            f"ELSE '£' || {_fmt_sql(lo)} || ' - £' || {_fmt_sql(hi)} END)")


def _date_text_sql(d: str) -> str:
    return f"COALESCE(strftime({d}, '%-d %b %Y'), 'Invalid Date')"


# ============================================================== AG: aggregations


@register("category_share", """
SELECT c.category, c.n, t.total, round(100.0::DOUBLE * c.n / t.total, 1) AS pct, c.first_ord
FROM (SELECT COALESCE(NULLIF(category, ''), 'Other') AS category, count(*) AS n, min(ord) AS first_ord
      FROM opportunities GROUP BY 1) c,
     (SELECT count(*) AS total FROM opportunities) t
ORDER BY c.n DESC, c.first_ord""", "opportunities")
def q_category_share(spark, d):
    return metrics.category_share(_v1(spark, d))


@register("stage_share", """
SELECT c.career_stage, c.n, t.total, round(100.0::DOUBLE * c.n / t.total, 1) AS pct, c.first_ord
FROM (SELECT COALESCE(NULLIF(career_stage, ''), 'All Stages') AS career_stage, count(*) AS n,
             min(ord) AS first_ord
      FROM opportunities GROUP BY 1) c,
     (SELECT count(*) AS total FROM opportunities) t""", "opportunities")
def q_stage_share(spark, d):
    return metrics.stage_share(_v1(spark, d))


@register("count_by_category", "SELECT category, count(*) AS n FROM opportunities GROUP BY category",
          "opportunities")
def q_count_by_category(spark, d):
    return metrics.count_by(_v1(spark, d), F.col("category"), "category")


@register("count_by_stage", "SELECT career_stage, count(*) AS n FROM opportunities GROUP BY career_stage",
          "opportunities")
def q_count_by_stage(spark, d):
    return metrics.count_by(_v1(spark, d), F.col("eligibility.career_stage"), "career_stage")


@register("funding_totals", """
SELECT CAST(sum(lo) AS BIGINT) AS min_total_gbp, CAST(sum(hi) AS BIGINT) AS max_total_gbp FROM opportunities""",
          "opportunities")
def q_funding_totals(spark, d):
    return metrics.funding_totals(_v1(spark, d))


@register("upcoming_batch", f"""
SELECT count(*) FILTER (WHERE {UPCOMING}) AS upcoming_deadlines_30_days FROM opps""", "opportunities")
def q_upcoming_batch(spark, d):
    return metrics.upcoming_batch(_v1(spark, d), AS_OF_TS)


@register("summary_report", f"""
SELECT '{AS_OF_TS.replace(' ', 'T')}' AS update_timestamp, t.total_opportunities, c.category_breakdown,
       s.career_stage_breakdown, t.min_total_gbp, t.max_total_gbp, t.upcoming_deadlines_30_days,
       'ukri,academies,foundations' AS data_sources
FROM (SELECT count(*) AS total_opportunities, CAST(sum(lo) AS BIGINT) AS min_total_gbp,
             CAST(sum(hi) AS BIGINT) AS max_total_gbp,
             count(*) FILTER (WHERE {UPCOMING}) AS upcoming_deadlines_30_days FROM opps) t,
     (SELECT string_agg(k || '=' || CAST(n AS VARCHAR), ',' ORDER BY k) AS category_breakdown
      FROM (SELECT COALESCE(category, 'null') AS k, count(*) AS n FROM opps GROUP BY 1)) c,
     (SELECT string_agg(k || '=' || CAST(n AS VARCHAR), ',' ORDER BY k) AS career_stage_breakdown
      FROM (SELECT COALESCE(career_stage, 'null') AS k, count(*) AS n FROM opps GROUP BY 1)) s""",
          "opportunities")
def q_summary_report(spark, d):
    r = metrics.summary_report(_v1(spark, d), AS_OF_TS)
    return r.select("update_timestamp", "total_opportunities",
                    metrics.map_text(F.col("category_breakdown")).alias("category_breakdown"),
                    metrics.map_text(F.col("career_stage_breakdown")).alias("career_stage_breakdown"),
                    F.col("funding_totals.min_total_gbp").alias("min_total_gbp"),
                    F.col("funding_totals.max_total_gbp").alias("max_total_gbp"),
                    "upcoming_deadlines_30_days",
                    F.array_join("data_sources", ",").alias("data_sources"))


@register("headline_stats", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active,
       count(*) FILTER (WHERE {DAYS} > 0 AND {DAYS} <= 30) AS closing_soon
FROM opps""", "opportunities")
def q_headline_stats(spark, d):
    return metrics.headline_stats(_v1(spark, d), AS_OF)


@register("funding_range", """
SELECT count(*) AS n, min(lo2) AS min_amount, max(hi2) AS max_amount,
       round(CAST(sum(lo2) AS DOUBLE) / count(lo2), 6) AS avg_min,
       round(CAST(sum(hi2) AS DOUBLE) / count(hi2), 6) AS avg_max
FROM (SELECT COALESCE(NULLIF(lo, 0), NULLIF(hi, 0), 0) AS lo2, COALESCE(NULLIF(hi, 0), NULLIF(lo, 0), 0) AS hi2
      FROM opportunities) r
WHERE lo2 > 0""", "opportunities")
def q_funding_range(spark, d):
    return metrics.funding_range(_v1(spark, d))


@register("top_organizations", """
SELECT organization, n FROM (
  SELECT COALESCE(NULLIF(organization, ''), 'Unknown') AS organization, count(*) AS n, min(ord) AS first_ord
  FROM opportunities GROUP BY 1)
ORDER BY n DESC, first_ord LIMIT 5""", "opportunities")
def q_top_organizations(spark, d):
    return metrics.top_organizations(_v1(spark, d), 5)


_BANDS_SQL = """
WITH f AS (SELECT a FROM (SELECT COALESCE(NULLIF(hi, 0), NULLIF(lo, 0), 0) AS a FROM opportunities) WHERE a > 0),
     m AS (SELECT CAST(sum(a) AS DOUBLE) / count(*) AS avg_amount FROM f),
     b AS (SELECT count(*) AS n, round(COALESCE(max(m.avg_amount), 0.0), 6) AS avg_amount,
                  count(*) FILTER (WHERE a > 2 * m.avg_amount) AS high,
                  count(*) FILTER (WHERE a > m.avg_amount AND a <= 2 * m.avg_amount) AS medium,
                  count(*) FILTER (WHERE a <= m.avg_amount) AS low
           FROM f, m)
"""


@register("value_bands", _BANDS_SQL + "SELECT n, avg_amount, high, medium, low FROM b", "opportunities")
def q_value_bands(spark, d):
    return metrics.value_bands(_v1(spark, d))


@register("competition_verdict", _BANDS_SQL + """
SELECT CASE WHEN high > n * 0.3 THEN 'High' WHEN medium > n * 0.4 THEN 'Medium' ELSE 'Low' END AS competition_level,
       CASE WHEN high > n * 0.3 THEN 'Many high-value, competitive opportunities'
            WHEN medium > n * 0.4 THEN 'Mix of competitive and accessible opportunities'
            ELSE 'Generally accessible opportunities' END AS description,
       high, medium, low
FROM b""", "opportunities")
def q_competition_verdict(spark, d):
    return metrics.competition_verdict(metrics.value_bands(_v1(spark, d)))


_BUCKET_SQL = f"""CASE WHEN deadline IS NULL OR deadline = '' THEN 'none' WHEN js_d IS NULL THEN 'open'
                      WHEN {DAYS} < 0 THEN 'closed' WHEN {DAYS} <= 30 THEN 'closing' ELSE 'open' END"""


@register("deadline_buckets", f"""
SELECT count(*) FILTER (WHERE b = 'open') AS open_now, count(*) FILTER (WHERE b = 'closing') AS closing_soon,
       count(*) FILTER (WHERE b = 'closed') AS closed, count(*) FILTER (WHERE b = 'none') AS no_deadline
FROM (SELECT {_BUCKET_SQL} AS b FROM opps)""", "opportunities")
def q_deadline_buckets(spark, d):
    return metrics.deadline_buckets(_v1(spark, d), AS_OF)


@register("deadline_buckets_fixed", f"""
SELECT count(*) FILTER (WHERE b = 'open') AS open_now, count(*) FILTER (WHERE b = 'closing') AS closing_soon,
       count(*) FILTER (WHERE b = 'closed') AS closed, count(*) FILTER (WHERE b = 'none') AS no_deadline
FROM (SELECT {_BUCKET_SQL.replace("WHEN js_d IS NULL THEN 'open'", "WHEN js_d IS NULL THEN 'none'")} AS b FROM opps)""",
          "opportunities")
def q_deadline_buckets_fixed(spark, d):
    """AG-9 with the D8 option: a deadline the browser cannot parse counts as no deadline."""
    return metrics.deadline_buckets(_v1(spark, d), AS_OF, unparsed="none")


# ============================================================== FL / SO / PR: search, sort, views

SEARCH_TERM, SEARCH_CATEGORY, SEARCH_STAGE = "FELLOW", "academies", "Early Career"


@register("search_filter", """
SELECT ord, id, title, category FROM opportunities
WHERE (contains(lower(title), 'fellow') OR contains(lower(organization), 'fellow')
       OR contains(lower(description), 'fellow') OR contains(lower(tag1), 'fellow')
       OR contains(lower(tag2), 'fellow'))
  AND category = 'academies' AND career_stage = 'Early Career'""", "opportunities")
def q_search_filter(spark, d):
    return search.search_filter(_v1(spark, d), SEARCH_TERM, SEARCH_CATEGORY, SEARCH_STAGE).select(
        "ord", "id", "title", "category")


@register("active_filter", "SELECT ord, status FROM opportunities WHERE status = 'active'", "opportunities")
def q_active_filter(spark, d):
    return search.active_only(_v1(spark, d)).select("ord", "status")


@register("lookup_by_id", """
SELECT id, min(ord) AS ord, arg_min(title, ord) AS title, arg_min(organization, ord) AS organization
FROM opportunities GROUP BY id""", "opportunities")
def q_lookup_by_id(spark, d):
    v1 = _v1(spark, d).select("id", "ord", "title", "organization")
    return search.lookup_by_id(v1).select("id", "ord", "title", "organization")


@register("source_subset", """
SELECT ord, category FROM opportunities WHERE category IN ('academies', 'foundations')""", "opportunities")
def q_source_subset(spark, d):
    kept, _rejected = search.source_subset(_v1(spark, d), ["academies", "foundations", "wellcome"])
    return kept.select("ord", "category")


@register("sort_deadline", "SELECT ord, js_d AS deadline_date FROM opps ORDER BY js_d NULLS LAST, ord",
          "opportunities")
def q_sort_deadline(spark, d):
    from ..functions import derive
    return search.sort_records(_v1(spark, d), "deadline").select(
        "ord", derive.js_date(F.col("application.deadline")).alias("deadline_date"))


@register("sort_amount", "SELECT ord, hi AS max_amount FROM opportunities ORDER BY hi DESC NULLS LAST, ord",
          "opportunities")
def q_sort_amount(spark, d):
    return search.sort_records(_v1(spark, d), "amount").select(
        "ord", F.col("funding_details.amount.max").alias("max_amount"))


@register("sort_title", "SELECT ord, title FROM opportunities ORDER BY title, ord", "opportunities")
def q_sort_title(spark, d):
    return search.sort_records(_v1(spark, d), "title").select("ord", "title")


@register("card_view", f"""
SELECT ord, id, title, organization, {_amount_text_sql('lo', 'hi')} AS amount_text, career_stage,
       dur AS duration_years, COALESCE(NULLIF(success_rate, ''), 'N/A') AS success_rate, frequency,
       tag1 || ' ' || tag2 AS tags_text,
       CASE WHEN {DAYS} <= 7 THEN 'urgent' WHEN {DAYS} <= 30 THEN 'warning' ELSE 'safe' END AS urgency,
       CASE WHEN {DAYS} > 0 THEN '(' || CAST({DAYS} AS VARCHAR) || ' days)' ELSE '(Closed)' END AS deadline_label,
       {_date_text_sql('js_d')} AS deadline_text
FROM opps""", "opportunities")
def q_card_view(spark, d):
    return search.card_view(_v1(spark, d), AS_OF)


@register("details_view", f"""
SELECT ord, id, {_amount_text_sql('lo', 'hi')} AS amount_text, 'Research costs' AS covers_text,
       discipline AS disciplines_text, '' AS requirements_text, {_date_text_sql('js_d')} AS deadline_text,
       'Invalid Date' AS next_deadline_text, '' AS priority_level, '' AS competition_level,
       COALESCE(NULLIF(success_rate, ''), 'N/A') AS success_rate,
       COALESCE(NULLIF(scraped_from, ''), application_url) AS link
FROM opps""", "opportunities")
def q_details_view(spark, d):
    return search.details_view(_v1(spark, d))
