"""Pages to records: the main source's detail pages (EN-2 with SC-10), its two-phase classification (EX-16), and the
foundations' scheme pages (EX-18, EX-19, EX-20 into EN-2).

Each chain parses a page once: one E-0 stage with just the facts its extractors need, then Catalyst projections. A
field that could not be read keeps the source's default and is named in ``problems``, so one bad field costs neither
the record nor the page; a page that is no record at all says why in ``reject``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import blocks, derive
from ..functions import text as tx
from ..functions.urls import resolve_url
from . import enrich, pages

DETAIL_FACTS = ("text_raw", "selectors", "first_ps", "anchors", "elig_items", "base_href")
_COUNCIL_NAMES = [(cid, name) for cid, name, _, _ in rules.COUNCILS]


def _lookup(pairs, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), key)


def _named(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())


def page_outcomes(pages_df: DataFrame, as_of_ts: str) -> DataFrame:
    """EN-2 for the main source: (page_id, url, html[, council]) -> a row per page with page_id, the record's columns,
    problems (array of field names that kept a default) and reject (null for a record, else why the page is none:
    'no page', 'no title', 'search page').

    A given ``council`` (from ``classify_links``) is taken; without one the page's url, then its text decide (EX-16).
    """
    given = "council" in pages_df.columns
    facts = pages.page_facts(pages_df, DETAIL_FACTS, keep=("council",) if given else ())
    site = F.lit(rules.COUNCIL_SITE)
    rows = facts.select(
        "page_id", "url", F.col("text_raw").alias("text"), pages.title_col().alias("title"), pages.description_col().alias("description"),
        pages.requirements_col().alias("requirements"), pages.application_url_col(site).alias("application_url"), "missing",
        *(["council"] if given else []))
    if not given:
        rows = tx.with_source_class(rows, "url", "text", "council", default=None)
    rows = tx.with_amount(rows, "text", "amount")
    rows = tx.with_deadline(rows, "text", "found")
    years = F.nullif(F.regexp_extract("text", tx.DURATION_PATTERN, 1), F.lit(""))
    rows = rows.withColumns({
        "years": years, "email": tx.first_email("text"), "career_stage": tx.career_stage("text"),
        "problem_council": F.col("council").isNull(), "council": F.coalesce("council", F.lit(rules.DEFAULT_COUNCIL))})
    rows = rows.withColumns({"organization": _lookup(_COUNCIL_NAMES, F.col("council")), "duration_years": F.col("years").try_cast("int")})
    zero = F.lit(0).cast("bigint")
    known = F.col("amount.parsed") & F.col("amount.min").isNotNull() & F.col("amount.max").isNotNull()
    amount = F.struct(F.when(known, F.col("amount.min")).otherwise(zero).alias("min"), F.when(known, F.col("amount.max")).otherwise(zero).alias("max"),
                      F.lit("GBP").alias("currency"), F.coalesce("duration_years", F.lit(1)).alias("duration_years"))
    dates = tx.deadline_defaults(F.col("found"), as_of_ts[:10])
    problems = _named({"council": F.col("problem_council"), "amount": ~known, "duration": F.col("years").isNotNull() & F.col("duration_years").isNull(),
                       "deadline": F.col("found").isNull()})
    reject = (F.when(F.col("missing"), F.lit("no page")).when(F.col("title") == "", F.lit("no title"))
              .when(F.lower("title") == rules.FUNDING_FINDER, F.lit("search page")))
    return rows.select(
        "page_id",
        derive.content_id(F.col("organization"), F.col("title")).alias("id"),
        "title", "organization", F.lit("ukri").alias("category"), F.col("council").alias("subcategory"), "description",
        F.struct("career_stage", F.array().cast("array<string>").alias("disciplines"), "requirements").alias("eligibility"),
        F.struct(amount.alias("amount"), F.array(*[F.lit(c) for c in rules.COVERS_UKRI]).alias("covers")).alias("funding_details"),
        F.struct(F.date_format(dates["deadline"], "yyyy-MM-dd").alias("deadline"), F.date_format(dates["next_deadline"], "yyyy-MM-dd").alias("next_deadline"),
                 dates["frequency"].alias("frequency"), "application_url", F.lit("").alias("guidelines_url")).alias("application"),
        F.struct(F.lit(rules.UKRI_PRIORITY).alias("priority_level"), F.lit(rules.COUNCIL_COMPETITION).alias("competition_level"),
                 F.lit(rules.COUNCIL_SUCCESS_RATE).alias("success_rate")).alias("key_info"),
        F.struct("email", F.lit("").alias("phone")).alias("contact"),
        tx.generate_tags("council", "title", "description").alias("tags"),
        F.to_timestamp_ntz(F.lit(as_of_ts)).alias("last_updated"), F.col("url").alias("scraped_from"), F.lit("active").alias("status"),
        problems.alias("problems"), reject.alias("reject"))


def page_records(pages_df: DataFrame, as_of_ts: str) -> DataFrame:
    """The pages that are records, in the record schema with page_id and problems."""
    return page_outcomes(pages_df, as_of_ts).filter(F.col("reject").isNull()).drop("reject")


def classify_links(links: DataFrame, fetched: DataFrame, url_col: str = "url") -> DataFrame:
    """EX-16 in two phases: links (with ``url_col``) -> + council, decided_by ('url', 'text', 'default').

    Whether the url decides is a function of the url, so the fetched pages (page_id, url, html) of decided urls go
    before they are parsed, and the rest are cut to (url, council) before the exchange: no text is shuffled, and
    decided links meet no join. Several fetches of one url: that of the least page_id counts.
    """
    by_url = links.withColumn("council", tx.keyword_council(F.lower(F.coalesce(F.col(url_col), F.lit("")))))
    decided = by_url.filter(F.col("council").isNotNull()).withColumn("decided_by", F.lit("url"))
    undecided = by_url.filter(F.col("council").isNull()).drop("council")
    needed = fetched.filter(F.col("url").isNotNull() & tx.keyword_council(F.lower("url")).isNull())
    texts = pages.page_facts(needed, ("text_raw",)).select("page_id", "url", tx.keyword_council(F.lower("text_raw")).alias("c"))
    texts = texts.groupBy(F.col("url").alias(url_col)).agg(F.min_by("c", "page_id").alias("council"))
    rest = undecided.join(texts, url_col, "left")
    by = F.when(F.col("council").isNotNull(), F.lit("text")).otherwise(F.lit("default"))
    rest = rest.withColumn("decided_by", by).withColumn("council", F.coalesce("council", F.lit(rules.DEFAULT_COUNCIL)))
    return decided.unionByName(rest)


def scheme_source(url: Column) -> Column:
    """The foundation whose site the url is on; null if none."""
    out = F.lit(None).cast("string")
    for sid, _, base, *_ in rules.FOUNDATIONS:
        out = F.when(url.startswith(base), F.lit(sid)).otherwise(out)
    return out


def schemes_from_pages(pages_df: DataFrame) -> DataFrame:
    """EX-18, EX-19, EX-20: the foundations' pages (page_id, url, html) -> one scheme row per card or block, in the
    columns EN-2 takes (plus page_id, pos, kind and the card's own link, scheme_url).

    The source of a page decides which cards count. One parse emits all cards as one tagged array; blocks come from the
    page text and join the same array, so one explode feeds every kind.
    """
    facts = pages.page_facts(pages_df, ("text_lines", "cards"))
    rows = facts.withColumn("source_id", scheme_source(F.col("url")))
    rows = rows.withColumn("kind", _lookup([(s, k) for s, k, _, _ in rules.SCHEME_PAGES], F.col("source_id"))).filter(F.col("kind").isNotNull())
    nothing = F.lit(None).cast("string")
    as_cards = F.transform(blocks.matched_blocks(F.col("text_lines")), lambda m: F.struct(
        F.lit("block").alias("kind"), nothing.alias("title"), m.alias("body"), nothing.alias("meta"), nothing.alias("href"), nothing.alias("calendar")))
    cards = F.when(F.col("kind") == "block", as_cards).otherwise(F.filter("cards", lambda c: c["kind"] == F.col("kind")))
    rows = rows.select("page_id", "source_id", F.posexplode(cards).alias("pos", "card"))
    rows = rows.select("page_id", "source_id", (F.col("pos") + 1).alias("pos"), "card.kind", F.col("card.title").alias("card_title"), F.col("card.body").alias("card_body"),
                       F.col("card.meta").alias("meta"), F.col("card.href").alias("href"), F.col("card.calendar").alias("calendar"))
    block, teaser = F.col("kind") == "block", F.col("kind") == "teaser"
    # a block without a match is none; a dated card needs a title and an intro
    rows = rows.filter(F.when(block, F.col("card_body") != "").when(teaser, F.lit(True)).otherwise((F.col("card_title") != "") & (F.col("card_body") != "")))
    rows = blocks.with_block_fields(rows.withColumn("_m", F.when(block, F.col("card_body")).otherwise("")), "_m")
    rows = rows.withColumns({"grant": F.when(teaser, pages.teaser_fields(F.col("meta"))), "money": F.when(~block & ~teaser, pages.dated_amount(F.col("meta")))})
    dated_frequency = {s: f for s, _, _, f in rules.SCHEME_PAGES}
    base = _lookup([(f[0], f[2]) for f in rules.FOUNDATIONS], F.col("source_id"))

    def pick(of_block: Column, of_teaser: Column, of_dated: Column) -> Column:
        return F.when(block, of_block).when(teaser, of_teaser).otherwise(of_dated)

    return rows.select(
        "page_id", "pos", "kind", "source_id",
        pick(F.col("title"), F.col("card_title"), F.col("card_title")).alias("title"),
        pick(F.col("description"), F.col("card_body"), F.col("card_body")).alias("description"),
        F.lit(rules.DEFAULT_CAREER_STAGE).alias("career_stage"),
        pick(F.col("amount_min").try_cast("bigint"), F.col("grant.amount").try_cast("bigint"), F.col("money.min")).alias("amount_min"),
        pick(F.col("amount_max").try_cast("bigint"), F.col("grant.amount").try_cast("bigint"), F.col("money.max")).alias("amount_max"),
        pick(F.col("duration_years"), F.col("grant.duration_years"), F.lit(0)).cast("int").alias("duration_years"),
        pick(F.col("deadline"), F.lit("N/A"), pages.dated_deadline(F.col("calendar"))).alias("deadline"),
        pick(F.col("frequency"), _lookup(dated_frequency.items(), F.col("source_id")), _lookup(dated_frequency.items(), F.col("source_id"))).alias("frequency"),
        F.array(_lookup([(s, t) for s, _, t, _ in rules.SCHEME_PAGES], F.col("source_id"))).alias("tags"),
        F.lit(None).cast("string").alias("success_rate"), base.alias("base_url"),
        F.when(block, base).when(~teaser & F.col("href").isNotNull(), resolve_url(base, F.col("href"))).otherwise("").alias("scheme_url"))


def scheme_records(pages_df: DataFrame, dims: DataFrame, as_of_ts: str) -> DataFrame:
    """The schemes of the foundations' pages as records (EN-2), with their foundation's columns (EN-1)."""
    schemes = schemes_from_pages(pages_df)
    records = enrich.assemble_record(schemes, "foundations", as_of_ts, keep=("page_id", "pos", "kind", "scheme_url"))
    return enrich.enrich_source(records, dims)
