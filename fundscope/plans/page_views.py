"""Rendered test pages over the record view: council detail pages that fire every title, description,
eligibility and link rule, and foundation pages with cards and labelled blocks. The markup is made from the driver
tables' columns; the DuckDB twins below state each page's text and parts from the same columns, without any markup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views

FOUNDATION_URLS = ["https://wellcome.org/grant-funding/schemes", "https://www.leverhulme.ac.uk/funding", "https://www.nuffieldfoundation.org/funding/"]
#: Cards of a foundation page.
PER_PAGE = 20


def _case(idx: Column, values: list, otherwise="") -> Column:
    out = None
    for i, v in enumerate(values):
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(idx == i, v) if out is None else out.when(idx == i, v)
    return out.otherwise(F.lit(otherwise))


def _description(b: DataFrame) -> Column:
    return F.concat(F.lit("Support for "), F.col("kind"), F.lit(" work in "), F.col("n_name"))


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html of a council detail page per record."""
    b = views._base(spark, sf_dir).join(views.notices(spark, sf_dir).select(F.col("notice_id").alias("k"), "text"), "k")
    k, ks = F.col("k"), F.col("k").cast("string")
    d = _description(b)
    c = F.concat
    title = _case(k % 8, [
        c(F.lit('<h1 class="page-title">'), "title", F.lit("</h1>")), c(F.lit("<h1>"), "title", F.lit("</h1>")),
        c(F.lit('<div class="opportunity-title">'), "title", F.lit("</div>")), "<h1>Funding Finder</h1>", "",
        c(F.lit('<h1></h1><div class="opportunity-title">'), "title", F.lit("</div>")),
        c(F.lit('<h1>Other</h1><h1 class="big page-title">'), "title", F.lit("</h1>")),
        c(F.lit('<div class="page-header"><h1> '), "title", F.lit(" &amp;  more </h1></div>"))])
    classes = ["opportunity-summary", "page-summary", "lead", "intro-text"]
    summary = _case(k % 5, [c(F.lit(f'<div class="x {cl}">'), d, F.lit("</div>")) for cl in classes] + [c(F.lit("<p>"), d, F.lit("</p><p></p><p>Third </p><p>Fourth</p>"))])
    eligibility = _case(k % 3, ["<section>Eligibility < 5 years</section><ul><li> PhD </li><li> </li></ul><div>x</div><ol><li>UK <b>base</b></li></ol>",
                                "<div>Eligibility <b>rules</b></div><ul><li>no</li></ul>"])
    apply = F.when(k % 7 == 0, "").when(k % 14 == 3, c(F.lit('<a>Apply soon</a><a href="/apply/'), ks, F.lit('">Apply now</a>'))) \
        .when(k % 2 == 0, c(F.lit('<a href="/apply/'), ks, F.lit('">Apply now</a>'))) \
        .otherwise(c(F.lit('<a href="/about">About</a><a href="https://apply.example.org/scheme/'), ks, F.lit('"><b>Application form</b></a>')))
    contact = F.when(k % 2 == 0, c(F.lit("<p>Write to s"), ks, F.lit("@uni.ac</p>"))).otherwise(F.lit(""))
    html = c(F.lit("<!DOCTYPE html><html><head><title>Opportunity</title>"), F.when(k % 7 == 0, '<base href="https://base.example.org/">').otherwise(""),
             F.lit('<style>p{margin:0 5k}</style></head><body><script>var award="£9 million";</script><template><div><b>£7 thousand</b></div></template>'),
             title, summary, eligibility, F.lit('<!-- £3 million --><p class="award">'), F.col("text"), F.lit("</p>"),
             F.when(k % 6 == 2, "<p>Open to social studies</p>").otherwise(""), apply, contact, F.lit("</body></html>"))
    theme = _case(k % 6, ["arts-and-culture", "medical", "open", "call", "environmental", "science"])
    url = c(F.lit("https://www.ukri.org/opportunity/"), theme, F.lit("-"), ks, F.lit("/"))
    return b.select(k.alias("page_id"), url.alias("url"), F.when(k % 50 == 49, F.lit(None).cast("string")).otherwise(html).alias("html"))


#: page_id, url, missing, t (page text), title, description, requirements_text, application_url of the same pages.
DETAIL_PAGES = """
details AS (
  SELECT *, 'Support for ' || kind || ' work in ' || n_name AS body,
    'https://www.ukri.org/opportunity/' || CASE k % 6 WHEN 0 THEN 'arts-and-culture' WHEN 1 THEN 'medical' WHEN 2 THEN 'open' WHEN 3 THEN 'call' WHEN 4 THEN 'environmental' ELSE 'science' END || '-' || k::varchar || '/' AS url
  FROM base2 JOIN (SELECT notice_id, text FROM notices) nt ON nt.notice_id = base2.k),
page_parts AS (
  SELECT k AS page_id, url, k % 50 = 49 AS missing,
    'Opportunity' || CASE k % 8 WHEN 3 THEN 'Funding Finder' WHEN 4 THEN '' WHEN 6 THEN 'Other' || title WHEN 7 THEN ' ' || title || ' &  more ' ELSE title END
      || CASE k % 5 WHEN 4 THEN body || 'Third Fourth' ELSE body END
      || CASE k % 3 WHEN 0 THEN 'Eligibility < 5 years PhD  xUK base' WHEN 1 THEN 'Eligibility rulesno' ELSE '' END
      || text || CASE WHEN k % 6 = 2 THEN 'Open to social studies' ELSE '' END
      || CASE WHEN k % 7 = 0 THEN '' WHEN k % 14 = 3 THEN 'Apply soonApply now' WHEN k % 2 = 0 THEN 'Apply now' ELSE 'AboutApplication form' END
      || CASE WHEN k % 2 = 0 THEN 'Write to s' || k::varchar || '@uni.ac' ELSE '' END AS t,
    CASE k % 8 WHEN 3 THEN 'Funding Finder' WHEN 4 THEN '' WHEN 5 THEN '' WHEN 7 THEN title || ' & more' ELSE title END AS title,
    CASE k % 5 WHEN 4 THEN body || '  Third' ELSE body END AS description,
    CASE k % 3 WHEN 0 THEN 'PhD; UK base' ELSE '' END AS requirements_text,
    CASE WHEN k % 7 = 0 THEN 'https://base.example.org/' WHEN k % 14 = 3 THEN '' WHEN k % 2 = 0 THEN 'https://www.ukri.org/apply/' || k::varchar
      ELSE 'https://apply.example.org/scheme/' || k::varchar END AS application_url
  FROM details)"""


def foundation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html of the foundations' pages: PER_PAGE cards or blocks each, so a page's group is bounded."""
    b = views._base(spark, sf_dir)
    k, j = F.col("k"), F.floor(F.col("k") / 3)
    a, dur, d, c = (F.lit(1) + j % 9).cast("string"), F.col("dur").cast("string"), F.col("d"), F.concat
    more = (F.col("dur") + 1).cast("string")
    body = _description(b)
    meta = _case(j % 3, [c(F.lit("Up to £"), a, F.lit(".5 million over 2 to "), more, F.lit(" years")), c(F.lit("up to £"), a, F.lit(" million for "), dur, F.lit(" years")), "Awards for a period"])
    teaser = c(F.lit('<div class="teaser-grant wide"><h3 class="teaser-grant__title"> '), "title", F.lit(' </h3><p class="teaser-grant__summary">'), body,
               F.lit('</p><p class="teaser-grant__meta">'), meta, F.lit("</p></div>"))
    named = F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.date_format(d, "MMMM"), F.year(d).cast("string"))
    years = _case(j % 3, [c(dur, F.lit(" to "), more, F.lit(" years")), c(dur, F.lit(" years")), c(F.lit("up to "), dur, F.lit(" year"))])
    value = F.when(j % 2 == 0, c(F.lit("£"), F.col("lo").cast("string"), F.lit(" to £"), F.col("hi").cast("string"))).otherwise(c(F.lit("up to £"), a, F.lit(".5 million")))
    deadline = _case(j % 4, ["Currently closed", "Open all year", named, c(F.lit("Spring "), F.year(d).cast("string"))])
    block = c(F.when(j % 5 == 0, F.lit("Notes about this page\n\n")).otherwise(F.lit("")), "title", F.lit("\nFor "), body, F.lit("\nDuration: "), years,
              F.when(j % 6 == 0, F.lit("")).otherwise(F.lit("\nFrequency: Annual")), F.lit("\nValue: "), value, F.lit("\nDeadline/Opening: "), deadline)
    calendar = _case(j % 5, ["Closed", named, "October 2025", "", "To be announced"])
    sub = _case(j % 3, [c(F.lit("£"), F.col("lo").cast("string"), F.lit(" - £"), F.col("hi").cast("string")), c(F.lit("Up to "), a, F.lit(" million")), ""])
    dated = c(F.lit('<div class="tool-card date-card fund-card bg-area'), F.when(j % 2 == 0, " bg-dark-blue").otherwise(""), F.lit('"><h3 class="tool-card__title"> '), "title",
              F.lit('</h3><div class="tool-card__intro">'), F.when(j % 7 == 0, F.lit(" ")).otherwise(body), F.lit('</div><a class="btn-secondary" href="/fund/'), k.cast("string"),
              F.lit('">More</a><div class="select-county-box__calendar-top">'), calendar, F.lit('</div><div class="tool-card__subheading">'), sub, F.lit("</div></div>"))
    card = _case(k % 3, [teaser, block, dated])
    group = F.floor(j / PER_PAGE)
    pages = b.select((group * 3 + k % 3).alias("page_id"), (k % 3).alias("site"), F.struct(k.alias("k"), card.alias("card")).alias("x"))
    pages = pages.groupBy("page_id", "site").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    cards = F.transform("xs", lambda x: x["card"])
    texts = F.when(F.col("site") == 1, F.array_join(cards, "\n\n")).otherwise(F.array_join(cards, ""))
    shell = c(F.lit('<html><body><div class="list">'), texts, F.lit("</div></body></html>"))
    return pages.select("page_id", c(_case(F.col("site"), FOUNDATION_URLS), F.lit("?page="), F.floor(F.col("page_id") / 3).cast("string")).alias("url"), shell.alias("html"))


#: The scheme of each card on those pages, from the columns.
FOUNDATION_SCHEMES = f"""
cards AS (SELECT *, CAST(floor(k / 3) AS BIGINT) AS j, 'Support for ' || kind || ' work in ' || n_name AS body FROM base2),
schemes AS (
  SELECT CAST(floor(j / {PER_PAGE}) AS BIGINT) * 3 + k % 3 AS page_id, k,
    CASE k % 3 WHEN 0 THEN 'teaser' WHEN 1 THEN 'block' ELSE 'dated' END AS kind,
    CASE k % 3 WHEN 0 THEN 'wellcome_trust' WHEN 1 THEN 'leverhulme_trust' ELSE 'nuffield_foundation' END AS source_id,
    CASE k % 3 WHEN 0 THEN 'https://wellcome.org' WHEN 1 THEN 'https://www.leverhulme.ac.uk' ELSE 'https://www.nuffieldfoundation.org' END AS base_url,
    title, body AS description,
    CASE k % 3 WHEN 0 THEN CASE j % 3 WHEN 0 THEN (1 + j % 9) * 1000000 + 500000 WHEN 1 THEN (1 + j % 9) * 1000000 ELSE 0 END
      WHEN 1 THEN CASE WHEN j % 2 = 0 THEN lo ELSE (1 + j % 9) * 1000000 + 500000 END
      ELSE CASE j % 3 WHEN 0 THEN lo WHEN 1 THEN (1 + j % 9) * 1000000 ELSE 0 END END AS amount_min,
    CASE k % 3 WHEN 0 THEN CASE j % 3 WHEN 0 THEN (1 + j % 9) * 1000000 + 500000 WHEN 1 THEN (1 + j % 9) * 1000000 ELSE 0 END
      WHEN 1 THEN CASE WHEN j % 2 = 0 THEN hi ELSE (1 + j % 9) * 1000000 + 500000 END
      ELSE CASE j % 3 WHEN 0 THEN hi WHEN 1 THEN (1 + j % 9) * 1000000 ELSE 0 END END AS amount_max,
    CASE k % 3 WHEN 0 THEN CASE j % 3 WHEN 0 THEN dur + 1 WHEN 1 THEN dur ELSE 0 END WHEN 1 THEN CASE j % 3 WHEN 0 THEN dur + 1 ELSE dur END ELSE 0 END AS duration_years,
    CASE k % 3 WHEN 0 THEN 'N/A'
      WHEN 1 THEN CASE j % 4 WHEN 0 THEN 'Closed' WHEN 1 THEN 'Rolling' WHEN 2 THEN strftime(d, '%Y-%m-%d') ELSE strftime(d, '%Y') END
      ELSE CASE j % 5 WHEN 1 THEN strftime(d, '%Y-%m-%d') WHEN 4 THEN NULL ELSE 'N/A' END END AS deadline,
    CASE WHEN (k % 3 = 1 AND (k % 3 = 1 AND j % 4 = 2)) OR (k % 3 = 2 AND j % 5 = 1) THEN d END AS iso_d,
    CASE k % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN CASE WHEN j % 6 = 0 THEN 'N/A' ELSE 'Annual' END ELSE 'Annual' END AS frequency,
    CASE k % 3 WHEN 0 THEN 'wellcome-trust' WHEN 1 THEN 'leverhulme-trust' ELSE 'nuffield-foundation' END AS tag,
    CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'https://www.leverhulme.ac.uk' ELSE 'https://www.nuffieldfoundation.org/fund/' || k::varchar END AS scheme_url
  FROM cards WHERE NOT (k % 3 = 2 AND j % 7 = 0))"""
