"""Aggregations over opportunity records (AG-1 .. AG-9).

Every operator is a grouped or global aggregate, so Spark runs it as partial (map-side) aggregation
followed by one small final shuffle; a hot category or organization is pre-aggregated per task and
never gathered into one task. Totals needed by shares/bands are 1-row aggregates joined back by a
broadcast of that single row (a proven bound), never an un-partitioned window over the data.

Records need the nested record schema plus an ``ord`` column (first-appearance order) where ties
are broken "by first appearance".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import derive


def _category() -> Column:
    return F.col("category")


def _stage() -> Column:
    return F.col("eligibility.career_stage")


def _amin() -> Column:
    return F.col("funding_details.amount.min")


def _amax() -> Column:
    return F.col("funding_details.amount.max")


def _deadline() -> Column:
    return F.col("application.deadline")


def _nz0(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


# ------------------------------------------------------------------ AG-1 update summary


def upcoming_flag(deadline: Column, as_of_ts: str) -> Column:
    """AG-1d batch rule: ISO deadline with 0 <= floor(days from now) <= 30; unparsable -> false."""
    days = derive.days_floor_from_ts(derive.iso_date(deadline), as_of_ts)
    return F.coalesce(days.between(0, rules.CLOSING_SOON_DAYS), F.lit(False))


def count_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    """AG-1a / AG-1b: count per raw key value (null kept as its own group)."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def funding_totals(df: DataFrame) -> DataFrame:
    """AG-1c: Σ min, Σ max over the batch (duplicates included)."""
    return df.agg(F.sum(_amin()).cast("bigint").alias("min_total_gbp"),
                  F.sum(_amax()).cast("bigint").alias("max_total_gbp"))


def upcoming_batch(df: DataFrame, as_of_ts: str) -> DataFrame:
    """AG-1d: number of deadlines within the next 30 days, batch rule."""
    return df.agg(F.count_if(upcoming_flag(_deadline(), as_of_ts)).alias("upcoming_deadlines_30_days"))


def summary_report(df: DataFrame, as_of_ts: str, sources=tuple(rules.SOURCE_ORDER)) -> DataFrame:
    """AG-1 (+ SNK-3 payload): one row with totals, category/stage maps, Σ amounts, upcoming, sources.

    One scan and one shuffle: a grouping-sets aggregate yields per-category counts, per-stage counts
    and the grand totals together (partial aggregation per task); a final global aggregate over those
    few rows assembles the report row.
    """
    # a JSON object's key for null is "null", and one for both it and the text: they are one entry
    key = lambda c: F.coalesce(c, F.lit("null"))
    flat = df.select(key(_category()).alias("category"), key(_stage()).alias("career_stage"), _amin().alias("amin"),
                     _amax().alias("amax"), upcoming_flag(_deadline(), as_of_ts).alias("upcoming"))
    g = (flat.groupingSets([["category"], ["career_stage"], []], "category", "career_stage")
         .agg(F.count(F.lit(1)).alias("n"), F.sum("amin").alias("smin"), F.sum("amax").alias("smax"),
              F.count_if("upcoming").alias("up"), F.grouping_id().alias("gid")))
    total, by_cat, by_stage = F.col("gid") == 3, F.col("gid") == 1, F.col("gid") == 2

    def entries(key: str, sel: Column) -> Column:
        return F.map_from_entries(F.collect_list(F.when(sel, F.struct(F.col(key), F.col("n")))))

    return g.agg(
        F.lit(as_of_ts.replace(" ", "T")).alias("update_timestamp"),
        F.sum(F.when(total, F.col("n"))).cast("bigint").alias("total_opportunities"),
        entries("category", by_cat).alias("category_breakdown"),
        entries("career_stage", by_stage).alias("career_stage_breakdown"),
        F.struct(F.sum(F.when(total, F.col("smin"))).cast("bigint").alias("min_total_gbp"),
                 F.sum(F.when(total, F.col("smax"))).cast("bigint").alias("max_total_gbp")).alias("funding_totals"),
        F.sum(F.when(total, F.col("up"))).cast("bigint").alias("upcoming_deadlines_30_days"),
        F.array(*[F.lit(x) for x in sources]).alias("data_sources"))


def map_text(m: Column) -> Column:
    """Deterministic 'k=v,k=v' text of a map (sorted by key), for display and comparison."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


# ------------------------------------------------------------------ AG-2 .. AG-9 dashboard


def headline_stats(df: DataFrame, as_of: str) -> DataFrame:
    """AG-2: total, active (status = 'active'), closing soon (0 < days_left <= 30, browser dates)."""
    days = derive.days_left(derive.js_date(_deadline()), as_of)
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(F.col("status") == "active").alias("active"),
                  F.count_if((days > 0) & (days <= rules.CLOSING_SOON_DAYS)).alias("closing_soon"))


def share(df: DataFrame, key: Column, name: str, falsy_default: str) -> DataFrame:
    """AG-3 / AG-4: count per key (falsy -> default), percent of the total (1 decimal), first appearance.

    Sorted by count desc, ties by first appearance (``ord``). The input is aggregated once per key (partial
    aggregation per task); the one-row total is the sum over those counts and joins back. It carries the least
    ``ord`` too, so both branches need the same aggregate and its exchange is used again.
    """
    flat = df.select(derive.falsy_to(key, falsy_default).alias(name), F.col("ord"))
    g = flat.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    total = g.agg(F.sum("n").alias("total"), F.min("first_ord").alias("_o"))
    return (g.crossJoin(F.broadcast(total))
            .select(name, "n", F.col("total").cast("bigint").alias("total"),
                    F.round(F.lit(100.0) * F.col("n") / F.col("total"), 1).alias("pct"), "first_ord")
            .orderBy(F.desc("n"), F.asc("first_ord")))


def category_share(df: DataFrame) -> DataFrame:
    return share(df, _category(), "category", "Other")


def stage_share(df: DataFrame) -> DataFrame:
    return share(df, _stage(), "career_stage", "All Stages")


def funding_range(df: DataFrame) -> DataFrame:
    """AG-5: min' = min||max||0, max' = max||min||0 over rows with min' > 0; an empty set gives nulls."""
    lo = F.coalesce(_nz0(_amin()), _nz0(_amax()), F.lit(0))
    hi = F.coalesce(_nz0(_amax()), _nz0(_amin()), F.lit(0))
    r = df.select(lo.alias("lo"), hi.alias("hi")).filter(F.col("lo") > 0)
    return r.agg(F.count(F.lit(1)).alias("n"), F.min("lo").cast("bigint").alias("min_amount"),
                 F.max("hi").cast("bigint").alias("max_amount"),
                 F.round(F.sum("lo") / F.count("lo"), 6).alias("avg_min"),
                 F.round(F.sum("hi") / F.count("hi"), 6).alias("avg_max"))


def top_organizations(df: DataFrame, k: int = 5) -> DataFrame:
    """AG-6: top-k organizations by count (falsy -> 'Unknown'); ties by first appearance.
    Grouped counts then a distributed top-k (TakeOrderedAndProject); the limit is the feature."""
    org = derive.falsy_to(F.col("organization"), "Unknown")
    return (df.groupBy(org.alias("organization"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
            .orderBy(F.desc("n"), F.asc("first_ord")).limit(k)
            .select("organization", "n"))


def value_bands(df: DataFrame) -> DataFrame:
    """AG-7: a = max||min||0 over a > 0; bands against the mean: high > 2·avg, medium (avg, 2·avg], low <= avg.

    Two passes, as the rule needs the mean before any band: the mean is an exact Σ/n (a 1-row
    aggregate, broadcast), and one more aggregate counts the bands and carries the mean along.
    """
    a = F.coalesce(_nz0(_amax()), _nz0(_amin()), F.lit(0))
    amounts = df.select(a.alias("a")).filter(F.col("a") > 0)
    mean = amounts.agg((F.sum("a") / F.count(F.lit(1))).alias("avg_amount"))
    j = amounts.crossJoin(F.broadcast(mean))
    avg = F.col("avg_amount")
    return j.agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.coalesce(F.max(avg), F.lit(0.0)), 6).alias("avg_amount"),
                 F.count_if(F.col("a") > 2 * avg).alias("high"),
                 F.count_if((F.col("a") > avg) & (F.col("a") <= 2 * avg)).alias("medium"),
                 F.count_if(F.col("a") <= avg).alias("low"))


def competition_verdict(bands: DataFrame) -> DataFrame:
    """AG-8: High if high > 0.3·n, else Medium if medium > 0.4·n, else Low; with the description."""
    n = F.col("n")
    level = (F.when(F.col("high") > n * rules.VERDICT_HIGH_SHARE, F.lit("High"))
             .when(F.col("medium") > n * rules.VERDICT_MEDIUM_SHARE, F.lit("Medium")).otherwise(F.lit("Low")))
    desc = F.create_map(*[x for lv, d in rules.VERDICTS for x in (F.lit(lv), F.lit(d))])
    return bands.select(level.alias("competition_level"), F.element_at(desc, level).alias("description"),
                        "high", "medium", "low")


def deadline_bucket(deadline: Column, as_of: str, unparsed: str = "open") -> Column:
    """AG-9 bucket: falsy -> none; browser-invalid date -> open (NaN comparisons fail; option
    ``unparsed='none'`` counts it as no deadline, SURVEY D8); days < 0 closed; days <= 30 closing;
    else open."""
    days = derive.days_left(derive.js_date(deadline), as_of)
    return (F.when(deadline.isNull() | (deadline == ""), F.lit("none"))
            .when(days.isNull(), F.lit(unparsed))
            .when(days < 0, F.lit("closed"))
            .when(days <= rules.CLOSING_SOON_DAYS, F.lit("closing"))
            .otherwise(F.lit("open")))


def deadline_buckets(df: DataFrame, as_of: str, unparsed: str = "open") -> DataFrame:
    """AG-9: one row of bucket counts (one pass, conditional aggregates)."""
    b = deadline_bucket(_deadline(), as_of, unparsed)
    return df.select(b.alias("b")).agg(
        F.count_if(F.col("b") == "open").alias("open_now"),
        F.count_if(F.col("b") == "closing").alias("closing_soon"),
        F.count_if(F.col("b") == "closed").alias("closed"),
        F.count_if(F.col("b") == "none").alias("no_deadline"))
