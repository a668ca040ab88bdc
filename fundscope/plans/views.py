"""Test-binding views over the driver tables.

V1 ``opportunities``: record-shaped view over orders ⋈ customer ⋈ nation, in the nested record
schema the operators consume. V2 ``notices``: opportunity text rendered from V1 so that the text
extractors (amount, deadline, duration, stage, tags) have inputs whose answers are known from
columns. ``leaflets`` renders V1 as labelled blocks (EX-19) and ``teasers`` as card meta lines (EX-18).

Every view reads the driver tables, so its work grows with them. The DuckDB twins used by the
oracle live in ``plans/oracle_views.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import derive
from ..sources.tables import load

AS_OF = "1998-06-15"
AS_OF_TS = "1998-06-15 12:00:00"

KINDS = ["fellowship", "grant", "equipment", "training", "network"]
CATEGORIES = ["ukri", "academies", "foundations"]
FREQUENCIES = ["Annual", "Bi-annual", "Multiple rounds"]
SOURCE_URLS = ["https://wellcome.org", "https://www.leverhulme.ac.uk", "https://www.nuffieldfoundation.org",
               "https://www.wolfson.org.uk"]
STAGE_BY_PRIORITY = {"1-URGENT": "Early Career", "2-HIGH": "Mid Career", "3-MEDIUM": "Senior",
                     "4-NOT SPECIFIED": "All Stages"}
PHRASE_BY_STAGE = {"Early Career": "early career researchers", "Mid Career": "fellowship holders",
                   "Senior": "senior professors", "All Stages": "all researchers"}


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _lookup(table: dict, key: Column) -> Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, key)


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation with the per-order derived scalars of the binding."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                             "o_orderdate", "o_orderpriority")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("o_orderkey")
    lo = F.when(k % 11 == 0, F.lit(0).cast("bigint")).otherwise(F.floor("o_totalprice").cast("bigint"))
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == n.n_nationkey)
        .select(
            k.alias("k"),
            F.to_date("o_orderdate").alias("d"),
            F.col("o_orderdate"),
            _pick(KINDS, k % 5).alias("kind"),
            lo.alias("lo"),
            F.col("n_name"),
            F.col("c_nationkey"),
            F.col("c_mktsegment"),
            F.col("o_orderstatus"),
            F.col("o_orderpriority"),
        )
        .withColumn("hi", F.when(F.col("k") % 17 == 0, F.lit(0).cast("bigint"))
                    .otherwise(F.col("lo") * (F.lit(1) + F.col("k") % 3)))
        .withColumn("career_stage", _lookup(STAGE_BY_PRIORITY, F.col("o_orderpriority")))
        .withColumn("title", F.concat(F.lit("Scheme "), (F.col("k") % 997).cast("string"), F.lit(" "),
                                      F.col("kind")))
        .withColumn("dur", (F.lit(1) + F.col("k") % 5).cast("int"))
    )


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one opportunity record per order, nested like the source system's JSON records."""
    b = _base(spark, sf_dir)
    k = F.col("k")
    deadline = (F.when(k % 13 == 0, F.lit("N/A")).when(k % 13 == 1, F.lit("Rolling"))
                .when(k % 13 == 2, F.lit(None).cast("string")).when(k % 13 == 3, F.lit(""))
                .otherwise(F.date_format("d", "yyyy-MM-dd")))
    rate = (F.when(k % 7 == 0, F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("N/A")))
            .otherwise(F.concat((F.lit(5) * (k % 7 + 1)).cast("string"), F.lit("%"))))
    scraped = F.when(F.col("c_nationkey") % 5 == 4,
                     F.concat(F.lit("https://www.ukri.org/opportunity/scheme-"), k.cast("string"), F.lit("/"))
                     ).otherwise(_pick(SOURCE_URLS, F.col("c_nationkey") % 5))
    return b.select(
        derive.content_id(F.col("n_name"), F.col("title")).alias("id"),
        F.col("title"),
        F.col("n_name").alias("organization"),
        F.when(k % 101 == 0, F.lit(None).cast("string")).otherwise(_pick(CATEGORIES, F.col("c_nationkey") % 3))
        .alias("category"),
        F.lower("n_name").alias("subcategory"),
        F.concat(F.lit("Support for "), F.col("kind"), F.lit(" work in "), F.col("n_name"), F.lit(" for the "),
                 F.lower("c_mktsegment"), F.lit(" sector")).alias("description"),
        F.struct(
            F.col("career_stage").alias("career_stage"),
            F.array(F.col("c_mktsegment")).alias("disciplines"),
            F.array().cast("array<string>").alias("requirements"),
        ).alias("eligibility"),
        F.struct(
            F.struct(F.col("lo").alias("min"), F.col("hi").alias("max"), F.lit("GBP").alias("currency"),
                     F.col("dur").alias("duration_years")).alias("amount"),
            F.array(F.lit("Research costs")).alias("covers"),
        ).alias("funding_details"),
        F.struct(
            deadline.alias("deadline"),
            F.lit("").alias("next_deadline"),
            _pick(FREQUENCIES, k % 3).alias("frequency"),
            F.concat(F.lit("https://apply.example.org/scheme/"), k.cast("string")).alias("application_url"),
            F.lit("").alias("guidelines_url"),
        ).alias("application"),
        F.struct(F.lit("").alias("priority_level"), F.lit("").alias("competition_level"),
                 rate.alias("success_rate")).alias("key_info"),
        F.struct(F.lit("").alias("email"), F.lit("").alias("phone")).alias("contact"),
        F.array(F.col("kind"), F.lower("c_mktsegment")).alias("tags"),
        F.col("o_orderdate").alias("last_updated"),
        scraped.alias("scraped_from"),
        F.when(F.col("o_orderstatus") == "F", F.lit("closed")).otherwise(F.lit("active")).alias("status"),
        k.alias("ord"),
    )


def _phrase(stage: Column) -> Column:
    return F.coalesce(_lookup(PHRASE_BY_STAGE, stage), F.lit("everyone"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: notice text per V1 row; variant k%4 picks the plain / 'k' / 'million' / ', k' renderings."""
    b = _base(spark, sf_dir)
    k = F.col("k")
    d = F.col("d")
    phrase = _phrase(F.col("career_stage"))
    iso = F.date_format(d, "yyyy-MM-dd")
    dmy = F.concat_ws("/", F.dayofmonth(d).cast("string"), F.month(d).cast("string"), F.year(d).cast("string"))
    named = F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.date_format(d, "MMMM"), F.year(d).cast("string"))
    ymd = F.concat_ws("-", F.year(d).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string"))
    lo_k = F.floor(F.col("lo") / 1000).cast("bigint")
    hi_k = F.floor(F.col("hi") / 1000).cast("bigint")
    a = (F.lit(1) + k % 9).cast("bigint")
    dur = F.col("dur").cast("string")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("Award of £"), F.col("lo").cast("string"), F.lit(" - £"),
                                    F.col("hi").cast("string"), F.lit(" for "), dur, F.lit(" years to "), phrase,
                                    F.lit(". Closing "), iso, F.lit(".")))
        .when(k % 4 == 1, F.concat(F.lit("Grants of "), lo_k.cast("string"), F.lit("-"), hi_k.cast("string"),
                                   F.lit("k over "), dur, F.lit(" years to "), phrase, F.lit(", closing "), dmy))
        .when(k % 4 == 2, F.concat(F.lit("Up to "), a.cast("string"), F.lit(" million over "), dur,
                                   F.lit(" years to "), phrase, F.lit("; deadline "), named))
        .otherwise(F.concat(F.lit("Funding, known in advance, for "), dur, F.lit(" years to "), phrase, F.lit("."),
                            F.when(k % 8 == 7, F.concat(F.lit(" Deadline "), ymd)).otherwise(F.lit(""))))
    )
    return b.select(
        k.alias("notice_id"),
        F.col("title"),
        F.col("n_name").alias("organization"),
        F.lower("n_name").alias("subcategory"),
        text.alias("text"),
    )


def leaflets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled-block text per V1 row (EX-19 input): title / For / Duration / Frequency / Value / Deadline."""
    b = _base(spark, sf_dir)
    k = F.col("k")
    d = F.col("d")
    dur = F.col("dur")
    duration = (F.when(k % 3 == 0, F.concat(dur.cast("string"), F.lit(" to "), (dur + 1).cast("string"),
                                            F.lit(" years")))
                .when(k % 3 == 1, F.concat(dur.cast("string"), F.lit(" years")))
                .otherwise(F.concat(F.lit("up to "), dur.cast("string"), F.lit(" year"))))
    a = (F.lit(1) + k % 9).cast("string")
    value = F.when(k % 2 == 0, F.concat(F.lit("£"), F.col("lo").cast("string"), F.lit(" to £"),
                                        F.col("hi").cast("string"))).otherwise(
        F.concat(F.lit("up to £"), a, F.lit(".5 million")))
    named = F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.date_format(d, "MMMM"), F.year(d).cast("string"))
    deadline = (F.when(k % 4 == 0, F.lit("Currently closed")).when(k % 4 == 1, F.lit("Open all year"))
                .when(k % 4 == 2, named).otherwise(F.concat(F.lit("Spring "), F.year(d).cast("string"))))
    text = F.concat(F.col("title"), F.lit("\nFor "), _phrase(F.col("career_stage")), F.lit("\nDuration: "), duration,
                    F.lit("\nFrequency: "), _pick(FREQUENCIES, k % 3), F.lit("\nValue: "), value,
                    F.lit("\nDeadline/Opening: "), deadline)
    return b.select(k.alias("leaflet_id"), text.alias("text"))


def teasers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teaser-card meta line per V1 row (EX-18 regex input)."""
    b = _base(spark, sf_dir)
    k = F.col("k")
    dur = F.col("dur")
    a = (F.lit(1) + k % 9).cast("string")
    meta = (F.when(k % 3 == 0, F.concat(F.lit("Up to £"), a, F.lit(".5 million over 2 to "),
                                        (dur + 1).cast("string"), F.lit(" years")))
            .when(k % 3 == 1, F.concat(F.lit("up to £"), a, F.lit(" million for "), dur.cast("string"),
                                       F.lit(" years")))
            .otherwise(F.concat(F.lit("Awards of £"), F.col("lo").cast("string"), F.lit(" for a period"))))
    return b.select(k.alias("card_id"), F.col("title"), meta.alias("meta"))
