"""Record sources: JSON record scan (SRC-1), envelope scan (SRC-2), scheme seeds (SRC-4),
source dimensions (SRC-5)."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import rules, schema
from .storage import exists as _exists

CORRUPT = "_corrupt_record"


def scan_records(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """SRC-1: JSON records with the explicit record schema. A missing path gives an empty typed frame;
    a malformed document gives a row whose fields are null and whose ``_corrupt_record`` holds the text
    (filter it into quarantine), never a failed job."""
    sch = T.StructType(list(schema.RECORD.fields) + [T.StructField(CORRUPT, T.StringType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], sch)
    return (spark.read.schema(sch).option("multiLine", multiline).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def parse_records(value: Column) -> Column:
    """SRC-1 on a column of JSON text (e.g. from a stream or a text table): struct in the record schema;
    malformed text parses to null (PERMISSIVE)."""
    return F.from_json(value, schema.RECORD, {"mode": "PERMISSIVE"})


def scan_envelope(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """SRC-2: database envelopes {last_updated, total_fundings, fundings[]} -> one row per record;
    a missing path or a missing ``fundings`` gives no rows. A file that holds one envelope over several lines is read by
    one task; files of an envelope a line (``multiline=False``) are split."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema.RECORD)
    env = spark.read.schema(schema.ENVELOPE).option("multiLine", multiline).json(path)
    return explode_envelope(env)


def explode_envelope(env: DataFrame) -> DataFrame:
    """Envelope rows -> record rows (``inline_outer`` of ``fundings`` with null/empty -> no rows)."""
    return env.select(F.inline(F.coalesce(F.col("fundings"), F.array().cast(schema.ENVELOPE["fundings"].dataType))))


def seed_schemes(spark: SparkSession) -> DataFrame:
    """SRC-4: the static scheme rows of the academies and one foundation (a small config data file)."""
    with open(os.path.join(os.path.dirname(os.path.dirname(__file__)), "data", "seed_schemes.json")) as f:
        rows = json.load(f)
    recs = [tuple(r.get(fld.name) for fld in schema.SCHEME.fields) for r in rows]
    return spark.createDataFrame(recs, schema.SCHEME)


def dimension_rows():
    """SRC-5 rows: (source_id, kind, name, base_url, funding_url, disciplines, description, rank)."""
    out = []
    for i, (cid, name, url, furl) in enumerate(rules.COUNCILS):
        out.append((cid, "ukri", name, url, furl, [], "", i))
    for i, (aid, name, base, furl, disc) in enumerate(rules.ACADEMIES):
        out.append((aid, "academies", name, base, furl, list(disc), "", i))
    for i, (fid, name, base, furl, focus, desc) in enumerate(rules.FOUNDATIONS):
        out.append((fid, "foundations", name, base, furl, list(focus), desc, i))
    return out


def dimensions(spark: SparkSession) -> DataFrame:
    """SRC-5: the 17-row source dimension (councils, academies, foundations); broadcast on join."""
    return spark.createDataFrame(dimension_rows(), schema.DIMENSION)
