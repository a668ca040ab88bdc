"""Page queries (SRC-3, EX-0, EX-2..EX-5, EX-12, EX-14, EX-15, EX-18, EX-20, RL-2, RL-3).

Spark side: E-0 (one parse per page) then Catalyst expressions. Oracle side: DuckDB regexes over
the raw html (the driver pages are regular: one h1, plain ``<a href="...">`` anchors, four entities),
so the two sides share no code path.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frontier, pages
from ..sources.tables import scan_pages
from . import views
from .registry import register

LISTING_BASE = "https://www.ukri.org"
LINK_PATTERN = r"^/[^/?]+/?$"


def _facts(spark, d, *fields):
    return pages.page_facts(scan_pages(spark, d), fields or None)


# DuckDB: html with script/style/comments/doctype removed, then text pieces between tags
_CLEAN_HTML = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', "
               "'', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<![^>]*>', '', 'g')")


def _decode(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), "
            f"'&lt;', '<'), '&amp;', '&')")


def _clean_sql(x: str) -> str:
    ws = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    c = f"trim(regexp_replace(COALESCE({x}, ''), '{ws}', ' ', 'g'), ' ')"
    return (f"replace(replace(replace(replace({c}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), "
            f"'&gt;', '>')")


_PIECES = f"string_split(regexp_replace({_CLEAN_HTML}, '<[^>]*>', chr(1), 'g'), chr(1))"
_TITLE = _clean_sql(_decode("regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))
_HOST = "regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"
_ANCHORS = """(SELECT page_id, url, unnest(hrefs) AS href, CAST(unnest(range(1, len(hrefs) + 1)) AS INTEGER) AS pos
                FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages))"""
_LINKS = f"""(SELECT page_id, '{LISTING_BASE}' || href AS link, min(pos) AS pos FROM {_ANCHORS}
              WHERE href <> '' AND regexp_matches(href, '{LINK_PATTERN}') AND NOT contains(href, 'filter_')
                AND NOT contains(href, 'sort_') AND NOT contains(href, 'page=') AND NOT contains(href, '?')
              GROUP BY page_id, link)"""


@register("scan_pages", "SELECT page_id, url, length(html) AS html_chars FROM pages")
def q_scan_pages(spark, d):
    return scan_pages(spark, d).select("page_id", "url", F.length("html").cast("bigint").alias("html_chars"))


@register("page_text", f"""
SELECT page_id, {_decode(f"array_to_string(list_filter(list_transform({_PIECES}, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda x: x <> ''), '')")} AS text
FROM pages""")
def q_page_text(spark, d):
    return pages.page_text(_facts(spark, d, "text"), "strip")


@register("extract_title", f"SELECT page_id, {_TITLE} AS title FROM pages")
def q_extract_title(spark, d):
    return pages.extract_title(_facts(spark, d, "selectors"))


@register("drop_non_records", f"""
SELECT page_id, url, title FROM (SELECT page_id, url, {_TITLE} AS title FROM pages)
WHERE title <> '' AND lower(title) <> 'funding finder'""")
def q_drop_non_records(spark, d):
    return pages.drop_non_records(_facts(spark, d, "selectors"))


@register("extract_description")
def q_extract_description(spark, d):
    return pages.extract_description(_facts(spark, d, "selectors", "first_ps"))


@register("extract_requirements")
def q_extract_requirements(spark, d):
    return pages.extract_requirements(_facts(spark, d, "elig_items")).select(
        "page_id", F.array_join("requirements", "; ").alias("requirements_text"))


@register("application_url", f"""
SELECT page_id, COALESCE((
    SELECT {_HOST} || regexp_extract(a, 'href="([^"]*)"', 1)
    FROM (SELECT unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a) t
    WHERE regexp_matches(regexp_extract(a, '>([^<]*)<', 1), '(?i)apply|application')
      AND regexp_extract(a, 'href="([^"]*)"', 1) LIKE '/%'
    LIMIT 1), '') AS application_url
FROM pages""")
def q_application_url(spark, d):
    return pages.application_url(_facts(spark, d, "anchors", "base_href"))


@register("extract_links", f"SELECT page_id, link, pos FROM {_LINKS}")
def q_extract_links(spark, d):
    return pages.extract_links(_facts(spark, d, "anchors"), LINK_PATTERN, F.lit(LISTING_BASE)).select(
        "page_id", "link", "pos")


@register("resolve_url", f"SELECT page_id, pos, href, {_HOST} || href AS resolved FROM {_ANCHORS}")
def q_resolve_url(spark, d):
    from ..functions.urls import resolve_url

    a = pages.anchors(_facts(spark, d, "anchors"))
    return a.select("page_id", "pos", "href", resolve_url(F.col("url"), F.col("href")).alias("resolved"))


@register("teaser_cards", """
SELECT card_id, title,
       CASE k % 3 WHEN 0 THEN (CAST(a AS DOUBLE) + 0.5) * 1000000.0 WHEN 1 THEN CAST(a AS DOUBLE) * 1000000.0
            ELSE 0.0 END AS amount,
       CAST(CASE k % 3 WHEN 0 THEN dur + 1 WHEN 1 THEN dur ELSE 0 END AS INTEGER) AS duration_years
FROM teasers""", "teasers")
def q_teaser_cards(spark, d):
    t = views.teasers(spark, d)
    f = pages.teaser_fields(F.col("meta"))
    return t.select("card_id", "title", f["amount"].alias("amount"), f["duration_years"].alias("duration_years"))


@register("dated_cards")
def q_dated_cards(spark, d):
    return pages.dated_cards(_facts(spark, d, "dated_cards")).select("page_id", "card_pos", "title", "deadline", "amount_min")


# ------------------------------------------------------------------ RL-2 / RL-3 over listing pages

_LANG = "regexp_extract(url, '^[a-zA-Z]+://[^/]+/([a-z]{2})/', 1)"
_RANK = "(CASE " + " ".join(f"WHEN {_LANG} = '{x}' THEN {i}" for i, x in enumerate(frontier.LANG_ORDER)) + \
        f" ELSE {len(frontier.LANG_ORDER)} END)"


def _listing_links(spark, d):
    """Links of the listing pages with their source (the language segment of the page URL)."""
    links = pages.extract_links(_facts(spark, d, "anchors"), LINK_PATTERN, F.lit(LISTING_BASE))
    return links.withColumn("source", frontier.lang_of(F.col("url")))


@register("frontier_dedup", f"""
SELECT link, source, page_id, pos FROM (
  SELECT l.link, p.source, l.page_id, l.pos,
         row_number() OVER (PARTITION BY l.link ORDER BY p.rnk, l.page_id, l.pos) AS rn
  FROM {_LINKS} l JOIN (SELECT page_id, {_LANG} AS source, {_RANK} AS rnk FROM pages) p USING (page_id))
WHERE rn = 1""")
def q_frontier_dedup(spark, d):
    return frontier.frontier_dedup(_listing_links(spark, d))


@register("pagination_cut", f"""
WITH pg AS (SELECT page_id, {_LANG} AS source FROM pages),
     fs AS (SELECT pg.source, l.link, min(pg.page_id) AS page_id FROM pg JOIN {_LINKS} l USING (page_id)
            GROUP BY pg.source, l.link),
     st AS (SELECT source, min(page_id) AS stop FROM pg
            WHERE (source, page_id) NOT IN (SELECT source, page_id FROM fs) GROUP BY source)
SELECT fs.source, fs.link, fs.page_id
FROM fs LEFT JOIN st USING (source)
WHERE st.stop IS NULL OR fs.page_id < st.stop""")
def q_pagination_cut(spark, d):
    facts = _facts(spark, d, "anchors")
    links = pages.extract_links(facts, LINK_PATTERN, F.lit(LISTING_BASE))
    listing = scan_pages(spark, d).select("page_id", frontier.lang_of(F.col("url")).alias("source"))
    return frontier.pagination_cut(listing, links)
