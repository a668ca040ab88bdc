"""Page -> record extraction (E-0, EX-0, EX-2..EX-5, EX-12, EX-14, EX-18, EX-20).

E-0 is the one Python stage: an Arrow-batched ``mapInPandas`` that parses each page once with the
stdlib HTML parser and emits ``page_facts`` (texts, selector hits, paragraphs, anchors, eligibility
items, base href, cards). The raw ``html`` column is dropped right there, so nothing downstream
carries it. DOM rules (class selectors, nesting of unclosed tags, sole-string tests, sibling lists)
are what Catalyst expressions cannot state; everything after E-0 is Catalyst again.

Scale: pages are split by the parquet reader (``spark.sql.files.maxPartitionBytes``) and E-0 runs per
partition; of an Arrow batch, FACTS_ROWS pages or FACTS_CHARS characters are parsed and handed on at a time, so the
facts in a worker do not grow with the table; no shuffle is needed until a grouping operator asks for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules
from ..functions import text as tx
from ..functions.urls import resolve_url

SELECTORS = list(dict.fromkeys(rules.TITLE_SELECTORS + rules.DESCRIPTION_SELECTORS))

S = T.StringType()
ANCHOR = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("href", S),
                       T.StructField("text", S), T.StructField("sole", S)])
TEASER = T.StructType([T.StructField("title", S), T.StructField("summary", S), T.StructField("meta", S)])
DATED = T.StructType([T.StructField("title", S), T.StructField("intro", S), T.StructField("href", S),
                      T.StructField("calendar", S), T.StructField("subheading", S)])
CARD = T.StructType([T.StructField("kind", S), T.StructField("title", S), T.StructField("body", S), T.StructField("meta", S),
                     T.StructField("href", S), T.StructField("calendar", S)])
FACTS_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", S),
    T.StructField("text_raw", S),
    T.StructField("text", S),
    T.StructField("text_lines", S),
    T.StructField("selectors", T.MapType(S, S)),
    T.StructField("first_ps", T.ArrayType(S)),
    T.StructField("anchors", T.ArrayType(ANCHOR)),
    T.StructField("elig_items", T.ArrayType(S)),
    T.StructField("base_href", S),
    T.StructField("teaser_cards", T.ArrayType(TEASER)),
    T.StructField("dated_cards", T.ArrayType(DATED)),
    T.StructField("cards", T.ArrayType(CARD)),
])


#: Pages, and characters of their html, whose facts are in a Python worker at a time (a longer page is alone).
FACTS_ROWS, FACTS_CHARS = 500, 1 << 21


def _slices(lengths):
    """(first, end) of the runs of pages that are parsed at a time."""
    first = size = 0
    for i, n in enumerate(lengths):
        if i > first and (i - first == FACTS_ROWS or size + n > FACTS_CHARS):
            yield first, i
            first, size = i, 0
        size += n
    if first < len(lengths):
        yield first, len(lengths)


def _facts_fn(fields, keep=()):
    def run(batches):
        import pandas as pd

        from ..functions.html_facts import page_facts as facts_of

        for pdf in batches:
            for first, end in _slices([len(h or "") for h in pdf["html"]]):
                part = pdf.iloc[first:end]
                html = part["html"].tolist()
                facts = [facts_of(page, SELECTORS, fields) for page in html]
                yield pd.DataFrame({"page_id": [int(k) for k in part["page_id"]], "url": part["url"].to_numpy(), **{f: [x[f] for x in facts] for f in fields},
                                    **{c: part[c].to_numpy() for c in keep}, "missing": [page is None for page in html]})

    return run


def page_facts(pages: DataFrame, fields=None, keep=()) -> DataFrame:
    """E-0: (page_id, url, html) -> page_facts; one parse per page, html dropped.

    ``fields`` names the facts the caller needs (default: all). Catalyst cannot prune columns
    inside a Python stage, so asking only for what a query uses keeps both the parse work and the
    Arrow transfer proportional to it. ``missing`` says that html is null (a failed fetch: no facts but empty ones);
    string columns named in ``keep`` pass through.
    """
    names = [f.name for f in FACTS_SCHEMA.fields if f.name not in ("page_id", "url")]
    fields = [f for f in names if fields is None or f in fields]
    schema = T.StructType([FACTS_SCHEMA["page_id"], FACTS_SCHEMA["url"], *[FACTS_SCHEMA[f] for f in fields],
                           *[T.StructField(c, S) for c in keep], T.StructField("missing", T.BooleanType())])
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", *keep).mapInPandas(
        _facts_fn(fields, tuple(keep)), schema)


# ------------------------------------------------------------------ projections over facts


def page_text(facts: DataFrame, variant: str = "strip") -> DataFrame:
    """EX-0: page text; 'strip' = stripped strings joined by '', 'lines' = joined by newline, 'raw'."""
    col = {"strip": "text", "lines": "text_lines", "raw": "text_raw"}[variant]
    return facts.select("page_id", F.col(col).alias("text"))


def _first_selector(facts_sel: Column, selectors) -> Column:
    """Text of the first selector (in priority order) that hit, even when empty; null if none hit."""
    return F.coalesce(*[F.try_element_at(facts_sel, F.lit(s)) for s in selectors])


def title_col() -> Column:
    """EX-2: first title selector hit, cleaned; none -> ''."""
    return F.coalesce(tx.clean_text(_first_selector(F.col("selectors"), rules.TITLE_SELECTORS)), F.lit(""))


def description_col() -> Column:
    """EX-4: first description selector hit, cleaned; else the first three paragraphs, each cleaned,
    joined by a space (blank ones kept); else ''."""
    sel = _first_selector(F.col("selectors"), rules.DESCRIPTION_SELECTORS)
    ps = F.array_join(F.transform(F.col("first_ps"), lambda p: tx.clean_text(p)), " ")
    return F.when(sel.isNotNull(), tx.clean_text(sel)).when(F.size("first_ps") > 0, ps).otherwise(F.lit(""))


def extract_title(facts: DataFrame) -> DataFrame:
    return facts.select("page_id", title_col().alias("title"))


def drop_non_records(facts: DataFrame) -> DataFrame:
    """EX-3: pages with an empty title or the title 'funding finder' are not records."""
    t = title_col()
    return facts.select("page_id", "url", t.alias("title")).filter(
        (F.col("title") != "") & (F.lower("title") != "funding finder"))


def extract_description(facts: DataFrame) -> DataFrame:
    return facts.select("page_id", description_col().alias("description"))


def requirements_col() -> Column:
    """EX-5: list items after the eligibility heading, cleaned, blanks dropped."""
    return F.filter(F.transform(F.col("elig_items"), lambda s: tx.clean_text(s)), lambda s: s != "")


def extract_requirements(facts: DataFrame) -> DataFrame:
    return facts.select("page_id", requirements_col().alias("requirements"))


APPLY = r"(?i)apply|application"


def application_url_col(base_url: Column) -> Column:
    """EX-12: ``<base href>`` or ''; replaced by the first anchor whose sole string mentions
    apply/application and has a non-empty href, resolved against ``base_url``."""
    hit = F.slice(F.filter(F.col("anchors"), lambda a: a["sole"].rlike(APPLY)), 1, 1)
    # resolved inside the array: every use of the href would filter the anchors anew
    resolved = F.transform(hit, lambda a: F.when(a["href"] != "", resolve_url(base_url, a["href"])))
    return F.coalesce(F.try_element_at(resolved, F.lit(1)), F.col("base_href"), F.lit(""))


def application_url(facts: DataFrame, base_url: Column | None = None) -> DataFrame:
    base = base_url if base_url is not None else F.col("url")
    return facts.select("page_id", application_url_col(base).alias("application_url"))


def anchors(facts: DataFrame) -> DataFrame:
    """Anchors with a href as rows (page_id, url, pos, href, text)."""
    return facts.select("page_id", "url", F.inline("anchors")).filter(F.col("href").isNotNull())


def extract_links(facts: DataFrame, pattern: str = rules.OPPORTUNITY_HREF, base_url: Column | None = None,
                  excludes=tuple(rules.LINK_EXCLUDES)) -> DataFrame:
    """EX-14: anchors whose href matches ``pattern`` (search, not anchored), without any excluded
    substring, resolved; distinct per page, keeping the first position. Rows: (page_id, url, link, pos).

    All anchors of a page live in one row, so the per-page distinct needs no shuffle: the resolved
    (link, pos) pairs are sorted inside the row and an element is kept when its link differs from
    its predecessor's (O(n log n) per page).
    """
    base = base_url if base_url is not None else F.col("url")

    def keep(a):
        ok = (a["href"] != "") & a["href"].rlike(pattern)
        for x in excludes:
            ok = ok & ~a["href"].contains(x)
        return ok

    pairs = F.transform(F.filter(F.col("anchors"), keep),
                        lambda a: F.struct(resolve_url(base, a["href"]).alias("link"), a["pos"].alias("pos")))
    staged = facts.select("page_id", "url", F.array_sort(pairs).alias("_ls"))
    firsts = F.filter(F.col("_ls"), lambda x, i: (i == 0) | (F.element_at(F.col("_ls"), i)["link"] != x["link"]))
    return staged.select("page_id", "url", F.inline(firsts))


# ------------------------------------------------------------------ cards


TEASER_AMOUNT = r"(?i)up to £([\d,.]+) million"
TEASER_RANGE = r"(?i)(\d+)(?: to |-)(\d+) years"
TEASER_YEARS = r"(?i)(\d+) years"


def teaser_fields(meta: Column) -> Column:
    """EX-18 regex part: amount 'up to £x million' x 1e6 (a comma'd number fails -> null), duration
    'a to b years' / 'a-b years' -> b, else 'n years', else 0."""
    g = F.nullif(F.regexp_extract(meta, TEASER_AMOUNT, 1), F.lit(""))
    amount = F.when(g.isNull(), F.lit(0.0)).otherwise(g.try_cast("double") * F.lit(1000000.0))
    rng = F.nullif(F.regexp_extract(meta, TEASER_RANGE, 2), F.lit("")).try_cast("int")
    yrs = F.nullif(F.regexp_extract(meta, TEASER_YEARS, 1), F.lit("")).try_cast("int")
    return F.struct(amount.alias("amount"), F.coalesce(rng, yrs, F.lit(0)).alias("duration_years"))


def teaser_cards(facts: DataFrame) -> DataFrame:
    """EX-18: teaser cards -> scheme rows (stage 'All Stages', deadline/frequency 'N/A', one tag)."""
    c = facts.select("page_id", F.posexplode("teaser_cards").alias("card_pos", "c"))
    f = teaser_fields(F.col("c.meta"))
    return c.select("page_id", "card_pos", F.col("c.title").alias("title"), F.col("c.summary").alias("description"),
                    f["amount"].alias("amount"), f["duration_years"].alias("duration_years"),
                    F.lit("All Stages").alias("career_stage"), F.lit("N/A").alias("deadline"),
                    F.lit("N/A").alias("frequency"), F.array(F.lit("wellcome-trust")).alias("tags"))


def dated_deadline(cal: Column) -> Column:
    """EX-20: the deadline of a calendar text: 'N/A' if it says Closed or 'October 2025' or is empty, else the
    extracted date (maybe null)."""
    undated = cal.contains("Closed") | cal.contains("October 2025")
    return F.when(cal != "", F.when(undated, F.lit("N/A")).otherwise(F.date_format(tx.extract_deadline(cal), "yyyy-MM-dd"))).otherwise(F.lit("N/A"))


def dated_amount(sub: Column) -> Column:
    """EX-20: the amount of a subheading by EX-7; '' -> 0 / 0."""
    return F.when(sub != "", tx.extract_amount(sub)).otherwise(
        F.struct(F.lit(0).cast("bigint").alias("min"), F.lit(0).cast("bigint").alias("max"),
                 F.lit("GBP").alias("currency"), F.lit(True).alias("parsed")))


def dated_cards(facts: DataFrame, base_url: Column | None = None) -> DataFrame:
    """EX-20: dated cards, kept only when both title and intro are non-empty."""
    c = facts.select("page_id", "url", F.posexplode("dated_cards").alias("card_pos", "c"))
    dl, amt = dated_deadline(F.col("c.calendar")), dated_amount(F.col("c.subheading"))
    base = base_url if base_url is not None else F.col("url")
    href = F.col("c.href")
    return c.filter((F.col("c.title") != "") & (F.col("c.intro") != "")).select(
        "page_id", "card_pos", F.col("c.title").alias("title"), F.col("c.intro").alias("description"),
        F.when(href.isNotNull(), resolve_url(base, href)).otherwise(F.lit("")).alias("application_url"),
        dl.alias("deadline"), amt["min"].alias("amount_min"), amt["max"].alias("amount_max"),
        F.lit("All Stages").alias("career_stage"), F.lit("Annual").alias("frequency"),
        F.array(F.lit("nuffield-foundation")).alias("tags"))
