"""Page-to-record queries (EN-2, SC-10, EX-16, EX-18..EX-20, EX-3..EX-5): over the driver pages and over pages rendered
from the record view. The oracles read the page text by regexes, or state it from the columns it was rendered from."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import blocks
from ..operators import page_records, pages
from ..sources import records
from ..sources.tables import scan_pages
from . import oracle_rules as R
from . import page_views
from .q_pages import _CLEAN_HTML, _TITLE, _clean_sql, _decode
from .oracle_views import with_views
from .registry import AS_OF, AS_OF_TS, ORACLE, register

_P = [r"(?i)£([\d,]+)(?:\s*-\s*£([\d,]+))?", r"(?i)([\d,]+)(?:\s*-\s*([\d,]+))?\s*(?:thousand|k)", r"(?i)([\d,]+)(?:\s*-\s*([\d,]+))?\s*(?:million|m)"]
_MONTH = "|".join(rules.MONTHS)
_NAMED, _SLASH, _ISO = rf"(?i)(\d{{1,2}})\s+({_MONTH})\s+(\d{{4}})", r"(\d{1,2})/(\d{1,2})/(\d{4})", r"(\d{4})-(\d{1,2})-(\d{1,2})"
_NUM = "try_cast(nullif(regexp_replace({}, '[^0-9]', '', 'g'), '') AS BIGINT)"


def _x(pattern: str, group: int, text: str = "t") -> str:
    return f"regexp_extract({text}, '{pattern}', {group})"


def _date(y: str, m: str, d: str) -> str:
    return f"try_cast(nullif(lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0'), '0000-00-00') AS DATE)"


def _council(text: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{cid}'" for cid, words in rules.COUNCIL_KEYWORDS)
    return f"(CASE {whens} END)"


_COUNCIL_NAME = "(CASE council " + " ".join(f"WHEN '{cid}' THEN {R.q(name)}" for cid, name, _, _ in rules.COUNCILS) + " END)"
_TAGS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(words, '{kw}') THEN '{tag}' END" for kw, tag in rules.TAG_KEYWORDS) + "], lambda x: x IS NOT NULL), ',')"


def _record_sql(cte: str) -> str:
    """The record of each row of ``cte`` (page_id, url, t, title, description, requirements_text, application_url)."""
    hit = "CASE WHEN m0 <> '' THEN {0} WHEN m1 <> '' THEN {1} WHEN m2 <> '' THEN {2} END"
    return f"""
r0 AS (SELECT *, {_council('url')} AS by_url, {_council('t')} AS by_text, {', '.join(f'{_x(p, 0)} AS m{i}' for i, p in enumerate(_P))},
    {_x(r'(?i)(\d+)\s*year', 1)} AS years, lower(concat_ws(' ', title, description)) AS words, lower(t) AS lt,
    COALESCE({_date(_x(_NAMED, 3), f"CAST(list_position({[m.lower() for m in rules.MONTHS]}, lower({_x(_NAMED, 2)})) AS VARCHAR)", _x(_NAMED, 1))},
      {_date(_x(_SLASH, 3), _x(_SLASH, 2), _x(_SLASH, 1))}, {_date(_x(_ISO, 1), _x(_ISO, 2), _x(_ISO, 3))}) AS found FROM {cte}),
r1 AS (SELECT *, COALESCE(by_url, by_text, '{rules.DEFAULT_COUNCIL}') AS council, {hit.format(*[_x(p, 1, f'm{i}') for i, p in enumerate(_P)])} AS g1,
    {hit.format(*[_x(p, 2, f'm{i}') for i, p in enumerate(_P)])} AS g2,
    CASE WHEN contains(lt, 'thousand') OR contains(lt, 'k') THEN 1000 WHEN contains(lt, 'm') THEN 1000000 ELSE 1 END AS scale FROM r0),
r2 AS (SELECT *, {_COUNCIL_NAME} AS organization, CASE WHEN g1 IS NULL THEN 0 ELSE {_NUM.format('g1')} END AS a1, CASE WHEN g1 IS NULL THEN 0 WHEN g2 = '' THEN {_NUM.format('g1')} ELSE {_NUM.format('g2')} END AS a2 FROM r1)
SELECT page_id, {R.content_id_sql('organization', 'title')} AS id, title, organization, council AS subcategory, description,
  CASE WHEN contains(lt, 'early career') OR contains(lt, 'postdoc') THEN 'Early Career' WHEN contains(lt, 'senior') OR contains(lt, 'professor') THEN 'Senior'
    WHEN contains(lt, 'fellowship') THEN 'Mid Career' ELSE 'All Stages' END AS career_stage, requirements_text,
  CASE WHEN a1 IS NULL OR a2 IS NULL THEN 0 ELSE a1 * scale END AS amount_min, CASE WHEN a1 IS NULL OR a2 IS NULL THEN 0 ELSE a2 * scale END AS amount_max,
  COALESCE(try_cast(years AS INTEGER), 1) AS duration_years, {R.q(', '.join(rules.COVERS_UKRI))} AS covers_text,
  strftime(COALESCE(found, DATE '{AS_OF}' + {rules.DEFAULT_DEADLINE_DAYS}), '%Y-%m-%d') AS deadline,
  strftime(DATE '{AS_OF}' + {rules.DEFAULT_NEXT_DEADLINE_DAYS}, '%Y-%m-%d') AS next_deadline, '{rules.DEFAULT_FREQUENCY}' AS frequency, application_url,
  '{rules.UKRI_PRIORITY}' AS priority_level, '{rules.COUNCIL_COMPETITION}' AS competition_level, '{rules.COUNCIL_SUCCESS_RATE}' AS success_rate,
  {_x(r'[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', 0)} AS email,
  council || CASE WHEN {_TAGS} = '' THEN '' ELSE ',' || {_TAGS} END AS tags_text, url AS scraped_from,
  concat_ws(',', CASE WHEN by_url IS NULL AND by_text IS NULL THEN 'council' END, CASE WHEN a1 IS NULL OR a2 IS NULL THEN 'amount' END,
    CASE WHEN years <> '' AND try_cast(years AS INTEGER) IS NULL THEN 'duration' END, CASE WHEN found IS NULL THEN 'deadline' END) AS problems_text
FROM r2 WHERE title <> '' AND lower(title) <> '{rules.FUNDING_FINDER}'"""


def _flat(r):
    return r.select(
        "page_id", "id", "title", "organization", "subcategory", "description", F.col("eligibility.career_stage").alias("career_stage"),
        F.array_join("eligibility.requirements", "; ").alias("requirements_text"), F.col("funding_details.amount.min").alias("amount_min"),
        F.col("funding_details.amount.max").alias("amount_max"), F.col("funding_details.amount.duration_years").alias("duration_years"),
        F.array_join("funding_details.covers", ", ").alias("covers_text"), F.col("application.deadline").alias("deadline"),
        F.col("application.next_deadline").alias("next_deadline"), F.col("application.frequency").alias("frequency"),
        F.col("application.application_url").alias("application_url"), F.col("key_info.priority_level").alias("priority_level"),
        F.col("key_info.competition_level").alias("competition_level"), F.col("key_info.success_rate").alias("success_rate"),
        F.col("contact.email").alias("email"), F.array_join("tags", ",").alias("tags_text"), "scraped_from", F.array_join("problems", ",").alias("problems_text"))


# the driver pages: paragraphs are left open and then nest, so the oracle matches opening and closing marks by depth
_PAGES = f"""
raw AS (SELECT page_id, url, {_CLEAN_HTML} AS h, {_TITLE} AS title FROM pages),
chunks AS (SELECT page_id, unnest(c) AS chunk, unnest(range(1, len(c) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(regexp_replace(replace(replace(
    regexp_extract(h, '(?s)<article>(.*?)</article>', 1), '<p>', chr(2)), '</p>', chr(3)), '<[^>]*>', '', 'g'), '[' || chr(2) || chr(3) || '][^' || chr(2) || chr(3) || ']*') AS c FROM raw)),
depths AS (SELECT *, chunk[1] = chr(2) AS opens, sum(CASE WHEN chunk[1] = chr(2) THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM chunks),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM depths WHERE opens) WHERE n <= 3),
ends AS (SELECT f.page_id, f.n, f.i, (SELECT min(e.i) FROM depths e WHERE e.page_id = f.page_id AND e.i > f.i AND e.depth = f.depth - 1) AS stop FROM firsts f),
paras AS (SELECT ends.page_id, ends.n, string_agg(substr(c.chunk, 2), '' ORDER BY c.i) AS p FROM ends JOIN chunks c ON c.page_id = ends.page_id AND c.i >= ends.i AND (stop IS NULL OR c.i < stop) GROUP BY ends.page_id, ends.n),
described AS (SELECT page_id, string_agg({_clean_sql(_decode('p'))}, ' ' ORDER BY n) AS description FROM paras GROUP BY page_id),
parts AS (SELECT raw.page_id, url, title, COALESCE(description, '') AS description, '' AS requirements_text,
    {_decode("regexp_replace(h, '<[^>]*>', '', 'g')")} AS t,
    COALESCE((SELECT '{rules.COUNCIL_SITE}' || regexp_extract(a, 'href="([^"]*)"', 1) FROM (SELECT unnest(regexp_extract_all(h, '<a href="[^"]*">[^<]*</a>')) AS a) x
      WHERE regexp_matches(regexp_extract(a, '>([^<]*)<', 1), '(?i)apply|application') LIMIT 1), '') AS application_url
  FROM raw LEFT JOIN described USING (page_id)),"""


# the paragraphs of the driver pages, for the query of q_pages
ORACLE["extract_description"] = with_views("WITH " + _PAGES.strip().rstrip(",") + " SELECT page_id, description FROM parts")


@register("assemble_page_record", "WITH " + _PAGES.strip() + _record_sql("parts"))
def q_assemble_page_record(spark, d):
    return _flat(page_records.page_records(scan_pages(spark, d), AS_OF_TS))


@register("assemble_detail_page", "WITH " + page_views.DETAIL_PAGES.strip() + "," + _record_sql("(SELECT * FROM page_parts WHERE NOT missing)"), "notices")
def q_assemble_detail_page(spark, d):
    return _flat(page_records.page_records(page_views.detail_pages(spark, d), AS_OF_TS))


@register("detail_fields", f"""WITH {page_views.DETAIL_PAGES.strip()}
SELECT page_id, title, description, requirements_text, application_url FROM page_parts WHERE NOT missing""", "notices")
def q_detail_fields(spark, d):
    """EX-2, EX-4, EX-5 and EX-12 on pages where each of their selectors and branches fires."""
    f = pages.page_facts(page_views.detail_pages(spark, d).filter("html IS NOT NULL"), ("selectors", "first_ps", "elig_items", "anchors", "base_href"))
    return f.select("page_id", pages.title_col().alias("title"), pages.description_col().alias("description"),
                    F.array_join(pages.requirements_col(), "; ").alias("requirements_text"), pages.application_url_col(F.lit(rules.COUNCIL_SITE)).alias("application_url"))


@register("detail_non_records", f"""WITH {page_views.DETAIL_PAGES.strip()}
SELECT page_id, title FROM page_parts WHERE NOT missing AND title <> '' AND lower(title) <> '{rules.FUNDING_FINDER}'""", "notices")
def q_detail_non_records(spark, d):
    """EX-3 on pages without a title and search pages among the others."""
    f = pages.page_facts(page_views.detail_pages(spark, d).filter("html IS NOT NULL"), ("selectors",))
    return pages.drop_non_records(f).select("page_id", "title")


@register("dated_card_fields", f"""WITH {page_views.FOUNDATION_SCHEMES.strip()}
SELECT page_id, title, description, scheme_url AS application_url, deadline, CAST(amount_min AS BIGINT) AS amount_min, CAST(amount_max AS BIGINT) AS amount_max
FROM schemes WHERE kind = 'dated'""")
def q_dated_card_fields(spark, d):
    """EX-20 on rendered cards of each calendar and amount, those without an intro among them."""
    f = pages.page_facts(page_views.foundation_pages(spark, d), ("dated_cards",))
    return pages.dated_cards(f).select("page_id", "title", "description", "application_url", "deadline", "amount_min", "amount_max")


@register("teaser_card_fields", f"""WITH {page_views.FOUNDATION_SCHEMES.strip()}
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS card_pos, title, description, CAST(amount_min AS DOUBLE) AS amount, CAST(duration_years AS INTEGER) AS duration_years
FROM schemes WHERE kind = 'teaser'""")
def q_teaser_card_fields(spark, d):
    """EX-18 on rendered cards."""
    f = pages.page_facts(page_views.foundation_pages(spark, d), ("teaser_cards",))
    return pages.teaser_cards(f).select("page_id", F.col("card_pos").cast("bigint").alias("card_pos"), "title", "description", "amount", "duration_years")


@register("block_fields", f"""WITH {page_views.FOUNDATION_SCHEMES.strip()}
SELECT page_id, title, description, frequency, CAST(duration_years AS INTEGER) AS duration_years, CAST(amount_min AS DOUBLE) AS amount_min, CAST(amount_max AS DOUBLE) AS amount_max, deadline
FROM schemes WHERE kind = 'block'""")
def q_block_fields(spark, d):
    """EX-19 on page texts of many blocks, some of which are none."""
    f = pages.page_facts(page_views.foundation_pages(spark, d), ("text_lines",)).withColumnRenamed("text_lines", "text")
    return blocks.labelled_blocks(f, "page_id").select("page_id", "title", "description", "frequency", "duration_years", "amount_min", "amount_max", "deadline")


@register("rejected_pages", f"""WITH {page_views.DETAIL_PAGES.strip()}
SELECT page_id, CASE WHEN missing THEN 'no page' WHEN title = '' THEN 'no title' ELSE 'search page' END AS reject
FROM page_parts WHERE missing OR title = '' OR lower(title) = '{rules.FUNDING_FINDER}'""", "notices")
def q_rejected_pages(spark, d):
    return page_records.page_outcomes(page_views.detail_pages(spark, d), AS_OF_TS).filter(F.col("reject").isNotNull()).select("page_id", "reject")


@register("classify_links", f"""WITH {page_views.DETAIL_PAGES.strip()}
SELECT page_id AS link_id, COALESCE({_council('url')}, CASE WHEN page_id % 10 <> 9 AND NOT missing THEN {_council('t')} END, '{rules.DEFAULT_COUNCIL}') AS council,
  CASE WHEN {_council('url')} IS NOT NULL THEN 'url' WHEN page_id % 10 <> 9 AND NOT missing AND {_council('t')} IS NOT NULL THEN 'text' ELSE 'default' END AS decided_by
FROM page_parts""", "notices")
def q_classify_links(spark, d):
    """The links of all detail pages, against the pages that were fetched (a tenth failed)."""
    p = page_views.detail_pages(spark, d)
    return page_records.classify_links(p.select(F.col("page_id").alias("link_id"), "url"), p.filter("page_id % 10 <> 9")).select("link_id", "council", "decided_by")


@register("scheme_records", f"""WITH {page_views.FOUNDATION_SCHEMES.strip()}
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS place, schemes.kind, {R.content_id_sql("'Foundation'", 'title')} AS id, title, dims.name AS organization, schemes.source_id AS subcategory, schemes.description,
  dims.disciplines_text, CAST(amount_min AS BIGINT) AS amount_min, CAST(amount_max AS BIGINT) AS amount_max, CAST(duration_years AS INTEGER) AS duration_years,
  {R.covers_sql('title')} AS covers_text, deadline, {R.next_deadline_sql('iso_d', 'frequency')} AS next_deadline, frequency, {R.priority_sql('amount_max', 'B')} AS priority_level,
  {R.email_sql('schemes.base_url')} AS email, {R.requirements_sql("'All Stages'", 'B')} AS requirements_text, tag AS tags_text, scheme_url
FROM schemes JOIN {R.dims_sql()} ON dims.source_id = schemes.source_id""")
def q_scheme_records(spark, d):
    """``place``: the scheme's rank among those of its page."""
    from pyspark.sql import Window

    r = page_records.scheme_records(page_views.foundation_pages(spark, d), records.dimensions(spark), AS_OF_TS)
    return r.select(
        "page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).cast("bigint").alias("place"), "kind", "id", "title", "organization", "subcategory", "description",
        F.array_join("eligibility.disciplines", ", ").alias("disciplines_text"), F.col("funding_details.amount.min").alias("amount_min"),
        F.col("funding_details.amount.max").alias("amount_max"), F.col("funding_details.amount.duration_years").alias("duration_years"),
        F.array_join("funding_details.covers", ", ").alias("covers_text"), F.col("application.deadline").alias("deadline"),
        F.col("application.next_deadline").alias("next_deadline"), F.col("application.frequency").alias("frequency"),
        F.col("key_info.priority_level").alias("priority_level"), F.col("contact.email").alias("email"),
        F.array_join("eligibility.requirements", "; ").alias("requirements_text"), F.array_join("tags", ",").alias("tags_text"), "scheme_url")
