"""Record assembly and dimension enrichment (EN-1, EN-2 with SC-1..SC-10).

EN-2 turns flat scheme rows into the nested record the way each source family builds it; EN-1
then overwrites organization / category / subcategory / disciplines from the 17-row source
dimension; the planner chooses how to join it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import derive



def _amount(df_cols) -> Column:
    return F.struct(F.col("amount_min").cast("bigint").alias("min"), F.col("amount_max").cast("bigint").alias("max"),
                    F.lit("GBP").alias("currency"), F.col("duration_years").cast("int").alias("duration_years"))


def assemble_record(schemes: DataFrame, family: str, as_of_ts: str, keep=("ord",)) -> DataFrame:
    """EN-2: flat schemes (source_id, title, description, career_stage, amount_min, amount_max,
    duration_years, deadline, frequency, tags, success_rate, base_url) -> nested records.

    ``family`` is 'academies' (id org literal 'Academy', requirements A, fixed covers, priority A,
    stage-estimated success rate) or 'foundations' (literal 'Foundation', requirements B, covers by
    title, priority B, competition from the given success rate, e-mail by base URL). A value the
    source system could not compute (non-ISO deadline, missing success rate) becomes null (D5).
    Columns named in ``keep`` pass through beside the record.
    """
    acad = family == "academies"
    stage = F.col("career_stage")
    rate = derive.success_rate(stage) if acad else F.col("success_rate")
    return schemes.select(
        *[c for c in schemes.columns if c in keep],
        F.col("source_id"),
        derive.content_id(F.lit("Academy" if acad else "Foundation"), F.col("title")).alias("id"),
        F.col("title"),
        F.lit("").alias("organization"),
        F.lit(family).alias("category"),
        F.lit("").alias("subcategory"),
        F.col("description"),
        F.struct(stage.alias("career_stage"), F.array().cast("array<string>").alias("disciplines"),
                 derive.standard_requirements(stage, "A" if acad else "B").alias("requirements")).alias("eligibility"),
        F.struct(_amount(schemes.columns).alias("amount"),
                 (F.array(*[F.lit(c) for c in rules.COVERS_ACADEMIES]) if acad
                  else derive.funding_covers(F.col("title"))).alias("covers")).alias("funding_details"),
        F.struct(F.col("deadline").alias("deadline"),
                 derive.next_deadline(F.col("deadline"), F.col("frequency")).alias("next_deadline"),
                 F.col("frequency").alias("frequency"),
                 (F.lit("") if acad else F.col("base_url")).alias("application_url"),
                 (F.lit("") if acad else F.col("base_url")).alias("guidelines_url")).alias("application"),
        F.struct(derive.priority_level(F.col("amount_max"), "A" if acad else "B").alias("priority_level"),
                 (F.lit("Very Competitive") if acad else derive.competition_level(rate)).alias("competition_level"),
                 rate.alias("success_rate")).alias("key_info"),
        F.struct((F.lit("") if acad else derive.source_email(F.col("base_url"))).alias("email"),
                 F.lit("").alias("phone")).alias("contact"),
        F.col("tags"),
        F.to_timestamp_ntz(F.lit(as_of_ts)).alias("last_updated"),
        F.col("base_url").alias("scraped_from"),
        F.lit("active").alias("status"),
    )


def enrich_source(records: DataFrame, dims: DataFrame, source_col: str = "source_id") -> DataFrame:
    """EN-1: organization, category, subcategory (and, outside the councils, disciplines) from the
    source dimension. Left join: a record with an unknown source keeps its own fields."""
    d = dims.select(F.col("source_id").alias("_sid"), F.col("name").alias("_name"),
                                F.col("kind").alias("_kind"), F.col("disciplines").alias("_disc"))
    j = records.join(d, records[source_col] == d["_sid"], "left")
    hit = F.col("_sid").isNotNull()
    out = (j.withColumn("organization", F.when(hit, F.col("_name")).otherwise(F.col("organization")))
           .withColumn("category", F.when(hit, F.col("_kind")).otherwise(F.col("category")))
           .withColumn("subcategory", F.when(hit, F.col("_sid")).otherwise(F.col("subcategory")))
           .withColumn("eligibility", F.col("eligibility").withField(
               "disciplines", F.when(hit & (F.col("_kind") != "ukri"), F.col("_disc"))
               .otherwise(F.col("eligibility.disciplines")))))
    return out.drop("_sid", "_name", "_kind", "_disc")
