"""Validation, quarantine and the commit gate (FL-2, FL-3, RL-5).

Validation is key PRESENCE, not non-null: ``{"deadline": null}`` is valid. A typed reader cannot
tell missing from null, so presence is tested on the raw JSON text with ``json_object_keys`` (and
``get_json_object`` for the two nested objects). All of it is Catalyst expressions, row-local, no
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules

def strict_reasons(value: Column) -> Column:
    """FL-2 reasons (array<string>, empty = valid): the 8 required top-level keys (in rule order), then
    funding_details.amount and application.deadline. Malformed JSON misses every key; a nested value that is
    null, an array or a scalar misses its key.

    Three key scans per record (top level and the two nested objects), each referenced once, so
    the expression stays cheap even where the optimizer inlines it into a filter.
    """
    keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
    missing = F.transform(F.array_except(F.array(*[F.lit(k) for k in rules.REQUIRED_STRICT]), keys),
                          lambda k: F.concat(F.lit("missing:"), k))
    fd = F.json_object_keys(F.get_json_object(value, "$.funding_details"))
    app = F.json_object_keys(F.get_json_object(value, "$.application"))
    nested = F.filter(F.array(F.when(~F.coalesce(F.array_contains(fd, "amount"), F.lit(False)), F.lit("missing:funding_details.amount")),
                              F.when(~F.coalesce(F.array_contains(app, "deadline"), F.lit(False)), F.lit("missing:application.deadline"))),
                      lambda r: r.isNotNull())
    return F.concat(missing, nested)


def validate_strict(df: DataFrame, value_col: str = "value") -> DataFrame:
    """FL-2: adds ``reasons`` and ``valid`` to rows holding raw JSON in ``value_col``."""
    return (df.withColumn("reasons", strict_reasons(F.col(value_col)))
            .withColumn("valid", F.size("reasons") == 0))


def split_valid(df: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """FL-2 / RL-5: (valid rows, quarantined rows with their reasons).

    The reasons come out of a one-row ``inline`` generator, so the optimizer cannot inline the JSON
    scans into the filter below (which would evaluate them twice per record).
    """
    v = df.select("*", F.inline(F.array(F.struct(strict_reasons(F.col(value_col)).alias("reasons")))))
    v = v.withColumn("valid", F.size("reasons") == 0)
    return v.filter("valid"), v.filter("NOT valid")


def database_valid(value: Column) -> Column:
    """FL-3 row predicate: the 5 database-required keys are present."""
    keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
    return F.size(F.array_except(F.array(*[F.lit(k) for k in rules.REQUIRED_DATABASE]), keys)) == 0


def validate_report(df: DataFrame, value_col: str = "value", database_exists: bool = True) -> DataFrame:
    """FL-3: valid / total counts; ok = every record valid (an empty list is ok); a missing or empty
    database is not ok."""
    agg = df.agg(F.count_if(database_valid(F.col(value_col))).alias("valid_count"),
                 F.count(F.lit(1)).alias("total"))
    ok = F.lit(database_exists) & (F.col("valid_count") == F.col("total"))
    return agg.select("valid_count", "total", ok.alias("ok"))


def as_json(df: DataFrame, cols=None) -> DataFrame:
    """Records -> (ord, value) JSON text, as a writer that omits null fields would produce them."""
    cols = cols or [c for c in df.columns if c != "ord"]
    return df.select("ord", F.to_json(F.struct(*cols)).alias("value"))


def commit_gate(rows: DataFrame, reasons_col: str, scraper_col: str = "category", source_col: str = "subcategory",
                scope: dict[str, str] | None = None) -> DataFrame:
    """RL-5 at record, source and scraper level: adds ``verdict`` and ``failed`` to rows that carry an array of reasons.

    ``scope`` says for each scraper what one failing row stops: 'record' (itself), 'source' (all rows of its
    source) or 'scraper' (all rows of the scraper); a scraper it does not name has scope 'record'. verdict: 'commit',
    or what stopped the row ('record', 'source', 'scraper'); failed: the failing rows that decided it.

    Rows are counted per source by partial aggregation, and the counts (a row per source) are joined back, so a
    source with most of the rows is never gathered anywhere.
    """
    scope = rules.FAILURE_SCOPE if scope is None else scope
    bad = F.coalesce(F.size(reasons_col) > 0, F.lit(False))
    tagged = rows.withColumns({"_scraper": F.coalesce(F.col(scraper_col).cast("string"), F.lit("")), "_source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "_bad": bad})
    per = tagged.groupBy("_scraper", "_source").agg(F.count_if("_bad").alias("_in_source"))
    whole = per.groupBy("_scraper").agg(F.sum("_in_source").alias("_in_scraper"))
    out = tagged.join(per, ["_scraper", "_source"]).join(whole, "_scraper")
    level = F.lit("record")
    for name, what in scope.items():
        level = F.when(F.col("_scraper") == name, F.lit(what)).otherwise(level)
    failed = (F.when(level == "scraper", F.col("_in_scraper")).when(level == "source", F.col("_in_source"))
              .otherwise(F.col("_bad").cast("bigint")))
    out = out.withColumns({"failed": failed, "_level": level})
    return out.withColumn("verdict", F.when(F.col("failed") > 0, F.col("_level")).otherwise("commit")).drop("_scraper", "_source", "_bad", "_in_source", "_in_scraper", "_level")


def typed_reasons(df: DataFrame) -> Column:
    """FL-2 reasons for typed records, where missing and null coincide."""
    paths = [*rules.REQUIRED_STRICT, "funding_details.amount", "application.deadline"]
    return F.filter(F.array(*[F.when(F.col(p).isNull(), F.lit(f"missing:{p}")) for p in paths]), lambda r: r.isNotNull())
