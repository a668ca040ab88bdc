"""Faceted search, lookup, source subset, sorts and the card / details projections
(FL-1, FL-6, FL-7, SO-1..SO-4, PR-1, PR-2).

Predicates are plain Catalyst expressions; empty facets are dropped at plan-build time so the
scan sees only the predicates that matter (and equality facets reach the parquet reader when the
records are stored as a table). Sorts are global sorts (range-partitioned by Spark); ties are
broken by the ordinal so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import derive

KNOWN_SOURCES = tuple(rules.SOURCE_ORDER)


def search_predicate(term: str = "", category: str = "", career_stage: str = "") -> Column:
    """FL-1: literal, case-insensitive substring search over title / organization / description / tags,
    AND'ed with the exact-match facets. Empty parameters contribute no predicate."""
    pred = F.lit(True)
    t = (term or "").lower()
    if t:
        lit = F.lit(t)
        pred = (F.lower("title").contains(lit) | F.lower("organization").contains(lit)
                | F.lower("description").contains(lit)
                | F.exists(F.coalesce(F.col("tags"), F.array().cast("array<string>")),
                           lambda x: F.lower(x).contains(lit)))
    if category:
        pred = pred & (F.col("category") == F.lit(category))
    if career_stage:
        pred = pred & (F.col("eligibility.career_stage") == F.lit(career_stage))
    return pred


def search_filter(df: DataFrame, term: str = "", category: str = "", career_stage: str = "") -> DataFrame:
    return df.filter(search_predicate(term, category, career_stage))


#: Trigrams of a term that choose candidates: the rarest, as one common trigram would list most records.
PROBES = 3
GRAM = 3
_FIELDS = ("title", "organization", "description")


def _grams(text: Column) -> Column:
    """The distinct character trigrams of a text."""
    at = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def write_search_index(df: DataFrame, path: str, ord_col: str = "ord") -> None:
    """FL-1 as an index: postings (gram, ord) of the lowercased fields and tags, and how often each gram occurs.

    Postings are sorted by gram across files, so a lookup opens the files and row groups of its grams alone. Grams do
    not reach over the end of a field.
    """
    fields = F.concat(F.array(*[F.coalesce(F.lower(c), F.lit("")) for c in _FIELDS]), F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.coalesce(F.lower(t), F.lit(""))))
    grams = F.array_distinct(F.flatten(F.transform(fields, _grams)))
    postings = df.select(F.explode(grams).alias("gram"), F.col(ord_col).alias("ord"))
    # by gram and record, so that a gram most records have is spread over files
    postings.repartitionByRange("gram", "ord").sortWithinPartitions("gram", "ord").write.parquet(f"{path}/postings")
    counts = df.sparkSession.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")


def search_indexed(df: DataFrame, path: str, term: str = "", category: str = "", career_stage: str = "", ord_col: str = "ord") -> DataFrame:
    """The rows of ``search_filter``, by the index of ``write_search_index``: candidates hold the term's rarest trigrams,
    and the exact predicate decides. A term of less than three characters has none: all records are judged."""
    t = (term or "").lower()
    grams = sorted({t[i : i + GRAM] for i in range(len(t) - GRAM + 1)})
    if grams:
        spark = df.sparkSession
        known = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(grams)).collect()}
        if len(known) < len(grams):  # a gram that no record has
            return df.filter(F.lit(False))
        rarest = sorted(grams, key=lambda g: (known[g], g))[:PROBES]
        found = spark.read.parquet(f"{path}/postings").filter(F.col("gram").isin(rarest))
        found = found.groupBy("ord").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(rarest)).select(F.col("ord").alias("_ord"))
        df = df.join(found, F.col(ord_col) == F.col("_ord"), "left_semi")
    return search_filter(df, term, category, career_stage)


def active_only(df: DataFrame) -> DataFrame:
    """FL-4: status = 'active'."""
    return df.filter(F.col("status") == "active")


def lookup_by_id(df: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """FL-6: the first record (lowest ``ord``) per id; with ``ids`` given, only those ids (semi join).

    A per-id ``min_by`` aggregate: partial aggregation per task, so a hot id never lands whole in
    one task.
    """
    if ids is not None:
        df = df.join(ids.select("id"), "id", "left_semi")
    cols = [c for c in df.columns if c != "id"]
    first = df.groupBy("id").agg(F.min_by(F.struct(*cols), F.col("ord")).alias("r"))
    return first.select("id", "r.*")


def source_subset(df: DataFrame, names) -> tuple[DataFrame, list[str]]:
    """FL-7: keep the chosen sources; names not among the known sources are returned as rejected."""
    names = list(names)
    rejected = [n for n in names if n not in KNOWN_SOURCES]
    kept = [n for n in names if n in KNOWN_SOURCES]
    return df.filter(F.col("category").isin(kept)), rejected


# ------------------------------------------------------------------ sorts


def sort_records(df: DataFrame, key: str) -> DataFrame:
    """SO-1..SO-4: 'deadline' asc (invalid dates last), 'amount' max desc, 'title' by Unicode
    collation; any other key keeps the input order (``ord``)."""
    if key == "deadline":
        return df.orderBy(F.asc_nulls_last(derive.js_date(F.col("application.deadline"))), F.asc("ord"))
    if key == "amount":
        return df.orderBy(F.desc_nulls_last("funding_details.amount.max"), F.asc("ord"))
    if key == "title":
        return df.orderBy(F.collate(F.col("title"), "UNICODE"), F.asc("ord"))
    return df.orderBy(F.asc("ord"))


# ------------------------------------------------------------------ projections


def card_view(df: DataFrame, as_of: str) -> DataFrame:
    """PR-1: the card: amount text, urgency class, '(n days)' / '(Closed)' label, success rate or N/A."""
    dl = derive.js_date(F.col("application.deadline"))
    days = derive.days_left(dl, as_of)
    urgency = (F.when(days <= rules.URGENT_DAYS, F.lit("urgent"))
               .when(days <= rules.CLOSING_SOON_DAYS, F.lit("warning")).otherwise(F.lit("safe")))
    label = F.when(days > 0, F.concat(F.lit("("), days.cast("string"), F.lit(" days)"))).otherwise(F.lit("(Closed)"))
    amt = F.col("funding_details.amount")
    return df.select(
        "ord", "id", "title", "organization",
        derive.amount_text(amt["min"], amt["max"]).alias("amount_text"),
        F.col("eligibility.career_stage").alias("career_stage"),
        amt["duration_years"].alias("duration_years"),
        derive.falsy_to(F.col("key_info.success_rate"), "N/A").alias("success_rate"),
        F.col("application.frequency").alias("frequency"),
        F.array_join("tags", " ").alias("tags_text"),
        urgency.alias("urgency"),
        label.alias("deadline_label"),
        derive.format_deadline(dl).alias("deadline_text"),
    )


def details_view(df: DataFrame) -> DataFrame:
    """PR-2: details: amount text, joined lists, formatted deadlines, link = scraped_from || application_url."""
    amt = F.col("funding_details.amount")
    return df.select(
        "ord", "id",
        derive.amount_text(amt["min"], amt["max"]).alias("amount_text"),
        F.array_join("funding_details.covers", ", ").alias("covers_text"),
        F.array_join("eligibility.disciplines", ", ").alias("disciplines_text"),
        F.array_join("eligibility.requirements", "; ").alias("requirements_text"),
        derive.format_deadline(derive.js_date(F.col("application.deadline"))).alias("deadline_text"),
        derive.format_deadline(derive.js_date(F.col("application.next_deadline"))).alias("next_deadline_text"),
        F.col("key_info.priority_level").alias("priority_level"),
        F.col("key_info.competition_level").alias("competition_level"),
        derive.falsy_to(F.col("key_info.success_rate"), "N/A").alias("success_rate"),
        derive.falsy_to(F.col("scraped_from"), F.col("application.application_url")).alias("link"),
    )
