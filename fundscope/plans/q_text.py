"""Text-extraction queries (EX-1, EX-6..EX-11, EX-13, EX-16, EX-17, EX-19) over V2 notices, labelled
leaflets and the documents table.

For notices and leaflets the oracle derives each answer from the columns the text was rendered
from, not by running the same regex; for documents the oracle is the same rule written for
DuckDB's regex engine.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import blocks
from ..functions import text as tx
from ..sources.tables import load
from . import oracle_rules as R
from . import views
from .registry import AS_OF, D_AS_OF, register

# ------------------------------------------------------------------ notices (V2)


@register("extract_amount", """
SELECT notice_id,
       CASE k % 4 WHEN 0 THEN lo WHEN 1 THEN CAST(floor(lo / 1000) AS BIGINT) * 1000 WHEN 2 THEN a * 1000000 END
           AS amount_min,
       CASE k % 4 WHEN 0 THEN hi WHEN 1 THEN CAST(floor(hi / 1000) AS BIGINT) * 1000 WHEN 2 THEN a * 1000000 END
           AS amount_max,
       k % 4 <> 3 AS parsed
FROM notices""", "notices")
def q_extract_amount(spark, d):
    n = tx.with_amount(views.notices(spark, d), "text", "a")
    return n.select("notice_id", F.col("a.min").alias("amount_min"), F.col("a.max").alias("amount_max"),
                    F.col("a.parsed").alias("parsed"))


_AMOUNT_SQL = """
SELECT notice_id,
       CASE k % 4 WHEN 0 THEN lo WHEN 1 THEN CAST(floor(lo / 1000) AS BIGINT) * 1000 WHEN 2 THEN a * 1000000 END
           AS amount_min,
       CASE k % 4 WHEN 0 THEN hi WHEN 1 THEN CAST(floor(hi / 1000) AS BIGINT) * 1000 WHEN 2 THEN a * 1000000 END
           AS amount_max,
       k % 4 <> 3 AS parsed
FROM notices"""


@register("extract_amount_fixed", _AMOUNT_SQL, "notices")
def q_extract_amount_fixed(spark, d):
    """EX-7 with the D1/D2 options: scale from the matched amount only, decimals kept."""
    n = tx.with_amount(views.notices(spark, d), "text", "a", scale_scope="match", allow_decimal=True)
    return n.select("notice_id", F.col("a.min").alias("amount_min"), F.col("a.max").alias("amount_max"),
                    F.col("a.parsed").alias("parsed"))


@register("career_stage", """
SELECT notice_id, CASE WHEN career_stage IN ('Early Career', 'Mid Career', 'Senior') THEN career_stage
                       ELSE 'All Stages' END AS career_stage
FROM notices""", "notices")
def q_career_stage(spark, d):
    return views.notices(spark, d).select("notice_id", tx.career_stage(F.col("text")).alias("career_stage"))


@register("duration_years", "SELECT notice_id, dur AS duration_years FROM notices", "notices")
def q_duration_years(spark, d):
    return views.notices(spark, d).select("notice_id", tx.duration_years(F.col("text")).alias("duration_years"))


_NOTICE_DATE = "CASE WHEN k % 4 = 3 AND k % 8 <> 7 THEN NULL ELSE d END"


@register("extract_deadline", f"SELECT notice_id, {_NOTICE_DATE} AS deadline FROM notices", "notices")
def q_extract_deadline(spark, d):
    return tx.with_deadline(views.notices(spark, d), "text", "deadline").select("notice_id", "deadline")


NOT_BEFORE = "1998-01-01"


@register("extract_deadline_fixed", f"""
SELECT notice_id, CASE WHEN ({_NOTICE_DATE}) >= DATE '{NOT_BEFORE}' THEN ({_NOTICE_DATE}) END AS deadline
FROM notices""", "notices")
def q_extract_deadline_fixed(spark, d):
    """EX-10 with the D3 option: dates before NOT_BEFORE are skipped."""
    return tx.with_deadline(views.notices(spark, d), "text", "deadline", not_before=NOT_BEFORE).select(
        "notice_id", "deadline")


@register("deadline_defaults", f"""
SELECT notice_id, COALESCE({_NOTICE_DATE}, {D_AS_OF} + {rules.DEFAULT_DEADLINE_DAYS}) AS deadline,
       {D_AS_OF} + {rules.DEFAULT_NEXT_DEADLINE_DAYS} AS next_deadline, 'Annual' AS frequency,
       ({_NOTICE_DATE}) IS NULL AS deadline_is_default
FROM notices""", "notices")
def q_deadline_defaults(spark, d):
    dd = tx.deadline_defaults(F.col("found"), AS_OF)
    return tx.with_deadline(views.notices(spark, d), "text", "found").select("notice_id", dd["deadline"].alias("deadline"),
                                          dd["next_deadline"].alias("next_deadline"),
                                          dd["frequency"].alias("frequency"),
                                          dd["deadline_is_default"].alias("deadline_is_default"))


def _tags_sql() -> str:
    t = "lower(title || ' ' || text)"
    parts = ", ".join(f"CASE WHEN contains({t}, {R.q(kw)}) THEN {R.q(tag)} END" for kw, tag in rules.TAG_KEYWORDS)
    return f"concat_ws(',', subcategory, {parts})"


@register("generate_tags", f"SELECT notice_id, {_tags_sql()} AS tags_text FROM notices", "notices")
def q_generate_tags(spark, d):
    n = views.notices(spark, d)
    tags = tx.generate_tags(F.col("subcategory"), F.col("title"), F.col("text"))
    return n.select("notice_id", F.array_join(tags, ",").alias("tags_text"))


# ------------------------------------------------------------------ labelled blocks (EX-19)

_LEAFLET_SQL = """
SELECT leaflet_id, 1 AS block_no, title, phrase AS description, frequency,
       CAST(CASE k % 3 WHEN 0 THEN dur + 1 ELSE dur END AS INTEGER) AS duration_years,
       CASE WHEN k % 2 = 0 THEN CAST(lo AS DOUBLE) ELSE (a + 0.5) * 1000000.0 END AS amount_min,
       CASE WHEN k % 2 = 0 THEN CAST(hi AS DOUBLE) ELSE (a + 0.5) * 1000000.0 END AS amount_max,
       CASE k % 4 WHEN 0 THEN 'Closed' WHEN 1 THEN 'Rolling' WHEN 2 THEN strftime(d, '%Y-%m-%d')
            ELSE CAST(year(d) AS VARCHAR) END AS deadline
FROM leaflets"""


def _leaflet_blocks(spark, d):
    return blocks.labelled_blocks(views.leaflets(spark, d), "leaflet_id")


@register("labelled_blocks", _LEAFLET_SQL, "leaflets")
def q_labelled_blocks(spark, d):
    return _leaflet_blocks(spark, d).select("leaflet_id", "block_no", "title", "description", "frequency",
                                            "duration_years", "amount_min", "amount_max", "deadline")


@register("block_duration", f"SELECT leaflet_id, block_no, duration_years FROM ({_LEAFLET_SQL})", "leaflets")
def q_block_duration(spark, d):
    return _leaflet_blocks(spark, d).select("leaflet_id", "block_no", "duration_years")


@register("block_amount", f"SELECT leaflet_id, block_no, amount_min, amount_max FROM ({_LEAFLET_SQL})", "leaflets")
def q_block_amount(spark, d):
    return _leaflet_blocks(spark, d).select("leaflet_id", "block_no", "amount_min", "amount_max")


@register("deadline_status", f"SELECT leaflet_id, block_no, deadline FROM ({_LEAFLET_SQL})", "leaflets")
def q_deadline_status(spark, d):
    return _leaflet_blocks(spark, d).select("leaflet_id", "block_no", "deadline")


# ------------------------------------------------------------------ documents

_WS_RE2 = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"  # RE2 twin of tx.WS


def _clean_sql(x: str) -> str:
    c = f"trim(regexp_replace(COALESCE({x}, ''), '{_WS_RE2}+', ' ', 'g'), ' ')"
    return f"replace(replace(replace(replace({c}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"


@register("clean_text", f"SELECT doc_id, {_clean_sql('text')} AS text_clean FROM documents")
def q_clean_text(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text_clean"))


@register("first_email", f"SELECT doc_id, regexp_extract(text, '{rules.EMAIL_PATTERN}', 0) AS email FROM documents")
def q_first_email(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.first_email(F.col("text")).alias("email"))


def _council_sql(x: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({x}), {R.q(kw)})" for kw in kws) + f" THEN {R.q(cid)}"
        for cid, kws in rules.COUNCIL_KEYWORDS)
    return f"(CASE {whens} END)"


@register("classify_source", f"""
SELECT doc_id, COALESCE({_council_sql('source')}, {_council_sql('text')}, {R.q(rules.DEFAULT_COUNCIL)}) AS council
FROM documents""")
def q_classify_source(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "source", "text")
    return tx.with_source_class(docs, "source", "text", "council").select("doc_id", "council")


def _amount_sql() -> str:
    pats = [p.replace(tx.WS, _WS_RE2) for p in tx.AMOUNT_PATTERNS]
    g = [(f"regexp_extract(text, '{p}', 0)", f"regexp_extract(text, '{p}', 1)", f"regexp_extract(text, '{p}', 2)")
         for p in pats]
    hit = [f"({g0} <> '')" for g0, _, _ in g]
    g1 = f"(CASE WHEN {hit[0]} THEN {g[0][1]} WHEN {hit[1]} THEN {g[1][1]} WHEN {hit[2]} THEN {g[2][1]} END)"
    g2 = f"(CASE WHEN {hit[0]} THEN {g[0][2]} WHEN {hit[1]} THEN {g[1][2]} WHEN {hit[2]} THEN {g[2][2]} END)"
    return f"""
WITH x AS (
  SELECT doc_id, text, {hit[0]} OR {hit[1]} OR {hit[2]} AS any_hit,
         try_cast(nullif(regexp_replace({g1}, '[^0-9]', '', 'g'), '') AS BIGINT) AS lo, {g2} AS g2,
         CASE WHEN contains(lower(text), 'thousand') OR contains(lower(text), 'k') THEN 1000
              WHEN contains(lower(text), 'million') OR contains(lower(text), 'm') THEN 1000000 ELSE 1 END AS scale
  FROM documents),
y AS (SELECT *, CASE WHEN g2 IS NULL OR g2 = '' THEN lo
                     ELSE try_cast(nullif(regexp_replace(g2, '[^0-9]', '', 'g'), '') AS BIGINT) END AS hi FROM x)
SELECT doc_id,
       CASE WHEN NOT any_hit THEN 0 WHEN lo IS NULL OR hi IS NULL THEN 0
            ELSE try_cast(CAST(lo AS HUGEINT) * scale AS BIGINT) END AS amount_min,
       CASE WHEN NOT any_hit THEN 0 WHEN lo IS NULL OR hi IS NULL THEN 0
            ELSE try_cast(CAST(hi AS HUGEINT) * scale AS BIGINT) END AS amount_max
FROM y"""


@register("amount_defaults", _amount_sql())
def q_amount_defaults(spark, d):
    docs = tx.with_amount(load(spark, d, "documents").select("doc_id", "text"), "text", "a")
    zero = F.lit(0).cast("bigint")
    return docs.select("doc_id", F.when(F.col("a.parsed"), F.col("a.min")).otherwise(zero).alias("amount_min"),
                       F.when(F.col("a.parsed"), F.col("a.max")).otherwise(zero).alias("amount_max"))
