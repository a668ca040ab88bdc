"""Operator vectors for the text extractors (FIXTURES §2.1-§2.6)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fundscope.functions import derive
from fundscope.functions import text as tx

AMOUNTS = [
    ("£100,000 - £500,000", 100000, 500000, True),
    ("Up to £1.5 million", 1000000, 1000000, True),
    ("500k funding available", 500000, 500000, True),
    ("Between 50-200 thousand pounds", 50000, 200000, True),
    ("£25,000 for work", 25000000, 25000000, True),
    ("£2 million, ask us", 2000, 2000, True),
    ("£100,000 - 500,000", 100000, 100000, True),
    ("now, known", None, None, False),
    ("no figure here", 0, 0, True),
]


def _single(spark, col_fn, values, schema="t string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col_fn(F.col("t")).alias("x")).collect()]


def test_amount_vectors(spark):
    got = _single(spark, tx.extract_amount, [a[0] for a in AMOUNTS])
    for (text, lo, hi, ok), r in zip(AMOUNTS, got):
        assert (r["min"], r["max"], r["parsed"]) == (lo, hi, ok), text


def test_amount_staged_equals_column_form(spark):
    df = spark.createDataFrame([(a[0],) for a in AMOUNTS], "t string")
    a = [tuple(r[0]) for r in df.select(tx.extract_amount(F.col("t"))).collect()]
    b = [tuple(r["a"]) for r in tx.with_amount(df, "t", "a").select("a").collect()]
    assert a == b


def test_amount_defaults_on_failed_parse(spark):
    got = _single(spark, tx.amount_with_defaults, ["now, known", "£5"])
    assert (got[0]["min"], got[0]["max"]) == (0, 0)
    assert (got[1]["min"], got[1]["max"]) == (5, 5)


DEADLINES = [
    ("Closes 3 june 2025", dt.date(2025, 6, 3)),
    ("3/2/2025", dt.date(2025, 2, 3)),
    ("2025-4-7", dt.date(2025, 4, 7)),
    ("2025-01-01, then 5 May 2024", dt.date(2024, 5, 5)),
    ("31 February 2025 or 1/3/2025", dt.date(2025, 3, 1)),
    ("31 February 2025 or 5 May 2025", None),
    ("soon", None),
]


def test_deadline_vectors(spark):
    got = _single(spark, tx.extract_deadline, [d[0] for d in DEADLINES])
    assert got == [d[1] for d in DEADLINES]
    df = spark.createDataFrame([(d[0],) for d in DEADLINES], "t string")
    staged = [r[0] for r in tx.with_deadline(df, "t", "d").select("d").collect()]
    assert staged == [d[1] for d in DEADLINES]


def test_clean_text_vectors(spark):
    vals = [None, "", "  a\t\nb ", "a  b", "&amp;lt;", "a &nbsp; b", "x\u001cy　z"]
    got = _single(spark, tx.clean_text, vals)
    assert got == ["", "", "a b", "a b", "<", "a   b", "x y z"]


def test_clean_text_idempotent_without_entities(spark):
    vals = ["  several   words\n\there ", "one", " lead and trail "]
    once = _single(spark, tx.clean_text, vals)
    twice = _single(spark, tx.clean_text, once)
    assert once == twice


def test_duration_stage_email(spark):
    assert _single(spark, tx.duration_years, ["for 3 Years", "none"]) == [3, 1]
    assert _single(spark, tx.career_stage, ["A Postdoc role", "for professors", "Fellowship", "x"]) == [
        "Early Career", "Senior", "Mid Career", "All Stages"]
    assert _single(spark, tx.first_email, ["mail a.b@x.org or c@d.com", "none"]) == ["a.b@x.org", ""]


def test_classify_and_tags(spark):
    df = spark.createDataFrame([("https://x/opportunity/arts-award/", "t"), ("https://x/o/plain/", "medical text"),
                                ("https://x/o/plain/", "nothing")], "u string, t string")
    got = [r[0] for r in df.select(tx.classify_source(F.col("u"), F.col("t"))).collect()]
    assert got == ["ahrc", "mrc", "ahrc"]
    df = spark.createDataFrame([("Early Career Fellowship", "international network grant")], "a string, b string")
    tags = df.select(tx.generate_tags(F.lit("mrc"), F.col("a"), F.col("b"))).collect()[0][0]
    assert tags == ["mrc", "fellowship", "grant", "early-career", "international", "networking"]


@pytest.mark.parametrize("org,title,md5", [
    ("Academy", "Research Grants", "d955d6660e7f11f9f083faf13150479b"),
    ("Academy", "Small Research Grants", "c9851102918d07541f1fbb53870131ed"),
    ("Academy", "Newton Advanced Fellowships", "d2b5c2f01ac7a05ff2acffa962f54e99"),
    ("Medical Research Council", "Funding opportunity: Neurosciences and mental health: programme",
     "aa08e818a301697ca81164f74f6bbddf"),
])
def test_content_id(spark, org, title, md5):
    df = spark.createDataFrame([(org, title)], "o string, t string")
    got = df.select(derive.content_id(F.col("o"), F.col("t"))).collect()[0][0]
    assert got.endswith("_" + md5)
    if title == "Research Grants":
        assert got == "academy_research_grants_" + md5


def test_next_deadline_vectors(spark):
    rows = [("2024-05-15", "Annual", "2025-05-15"), ("2024-05-30", "Bi-annual", "2024-11-26"),
            ("2024-04-15", "Multiple rounds", "2025-04-15"), ("N/A", "Annual", None),
            ("2024-02-29", "Annual", "2025-02-28")]
    df = spark.createDataFrame([r[:2] for r in rows], "d string, f string")
    got = [r[0] for r in df.select(derive.next_deadline(F.col("d"), F.col("f"))).collect()]
    assert got == [r[2] for r in rows]


def test_levels(spark):
    amts = [500000, 499999, 200000, 50000, 49999]
    assert _single(spark, lambda c: derive.priority_level(c, "A"), amts, "t long") == [
        "Very High", "High", "High", "Medium", "Low"]
    assert _single(spark, lambda c: derive.priority_level(c, "B"), [1000000, 500000, 200000, 199999], "t long") == [
        "Very High", "High", "Medium", "Low"]
    assert _single(spark, derive.competition_level, ["10%", "20%", "30%", "31%", "N/A"]) == [
        "Extremely Competitive", "Very Competitive", "Competitive", "Moderately Competitive", None]
    assert _single(spark, derive.success_rate, ["Senior", "Unknown", None]) == ["25%", "18%", "18%"]


def test_format_amount(spark):
    got = _single(spark, derive.format_amount, [1234, 1000000, 123456789, 0], "t long")
    assert got == ["1,234", "1,000,000", "1,234,567.89", "0"]


def test_amount_options(spark):
    texts = ["£25,000 for work", "£2 million, ask us", "Up to £1.5 million", "500k funding available",
             "Between 50-200 thousand pounds", "£100,000 - £500,000", "now, known", "£3 Million here"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r["a"]["min"], r["a"]["max"]) for r in
           tx.with_amount(df, "t", "a", scale_scope="match", allow_decimal=True).select("a").collect()]
    assert got == [(25000, 25000), (2000000, 2000000), (1500000, 1500000), (500000, 500000), (50000, 200000),
                   (100000, 500000), (None, None), (3000000, 3000000)]
    faithful = [(r["a"]["min"], r["a"]["max"]) for r in tx.with_amount(df, "t", "a").select("a").collect()]
    assert faithful[:3] == [(25000000, 25000000), (2000, 2000), (1000000, 1000000)]


def test_deadline_not_before_option(spark):
    rows = [("Closes 3 june 2025", "2025-01-01", dt.date(2025, 6, 3)),
            ("2025-01-01, then 5 May 2024", "2024-06-01", dt.date(2025, 1, 1)),
            ("old 2003-05-01, new 2025-02-03", "2020-01-01", dt.date(2025, 2, 3)),
            ("1/2/2001 or 3/4/2026", "2020-01-01", dt.date(2026, 4, 3)),
            ("only 2003-05-01", "2020-01-01", None)]
    for text, bound, want in rows:
        df = spark.createDataFrame([(text,)], "t string")
        got = tx.with_deadline(df, "t", "d", not_before=bound).collect()[0]["d"]
        assert got == want, text
