"""Randomized checks of the text rules against a plain-Python statement of the same rules
(brute force over a few hundred generated strings, one Spark job per rule)."""

import random
import re

from pyspark.sql import functions as F

from fundscope import rules
from fundscope.functions import text as tx

WHITESPACE = [c for c in map(chr, range(0x3001)) if c.isspace()]
PIECES = WHITESPACE + ["&nbsp;", "&amp;", "&lt;", "&gt;", "&amp;lt;", "£", ",", "-", " - ", "k", "K", "m", "M",
                       "thousand", "million", "Million", "5", "12", "3,000", "1.5", "a", "word", "x@y.org", "@",
                       "known", "year"]


def _strings(n=400, seed=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def py_clean(s):
    s = re.sub(r"\s+", " ", (s or "").strip())
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = s.replace(a, b)
    return s


def py_email(s):
    found = re.findall(rules.EMAIL_PATTERN, s)
    return found[0] if found else ""


def test_clean_text_matches_python_rule(spark):
    vals = _strings()
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = [r[0] for r in df.select(tx.clean_text(F.col("t"))).collect()]
    assert got == [py_clean(v) for v in vals]


def test_email_matches_python_rule(spark):
    vals = _strings(seed=3)
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = [r[0] for r in df.select(tx.first_email(F.col("t"))).collect()]
    assert got == [py_email(v) for v in vals]


def test_resolve_url_matches_urljoin(spark):
    from urllib.parse import urljoin

    from fundscope.functions.urls import resolve_url

    rnd = random.Random(9)
    segs = ["a", "b", "..", ".", "", "x.html", "?q=1", "#f", "c d"]
    bases = ["https://h.org", "https://h.org/", "https://h.org/p/q", "https://h.org/p/q/", "http://h.org/p?x=1#y"]
    rows = []
    for _ in range(400):
        href = "/".join(rnd.choice(segs) for _ in range(rnd.randint(1, 5)))
        href = rnd.choice(["", "/", "//cdn.org/"]) + href
        rows.append((rnd.choice(bases), href))
    df = spark.createDataFrame(rows, "b string, h string")
    got = [r[0] for r in df.select(resolve_url(F.col("b"), F.col("h"))).collect()]
    assert got == [urljoin(b, h) for b, h in rows]


def test_next_deadline_and_buckets_match_python_rule(spark):
    import datetime as dt

    from fundscope.functions import derive
    from fundscope.operators import metrics

    rnd = random.Random(17)
    days = [dt.date(2023, 12, 31) + dt.timedelta(days=rnd.randint(0, 900)) for _ in range(300)]
    dls = [d.isoformat() for d in days] + ["2024-02-29", "N/A", "Rolling", "", None, "2025", "2024-2-3"]
    freqs = ["Annual", "Bi-annual", "Multiple rounds", "Twice yearly"]
    rows = [(d, rnd.choice(freqs)) for d in dls]
    df = spark.createDataFrame(rows, "d string, f string")

    def py_next(d, f):
        try:
            x = dt.datetime.strptime(d, "%Y-%m-%d").date()
        except (TypeError, ValueError):
            return None
        if "Annual" in f:
            y = x.year + 1
            return dt.date(y, x.month, min(x.day, 28 if x.month == 2 and not (y % 4 == 0 and (y % 100 or y % 400 == 0))
                                           else x.day)).isoformat()
        return (x + dt.timedelta(days=180 if "Bi-annual" in f else 365)).isoformat()

    got = [r[0] for r in df.select(derive.next_deadline(F.col("d"), F.col("f"))).collect()]
    assert got == [py_next(d, f) for d, f in rows]

    as_of = dt.date(2025, 1, 10)

    def py_bucket(d):
        if d is None or d == "":
            return "none"
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", d):
            x = dt.date.fromisoformat(d)
        elif re.fullmatch(r"\d{4}", d):
            x = dt.date(int(d), 1, 1)
        else:
            return "open"
        n = (x - as_of).days
        return "closed" if n < 0 else ("closing" if n <= 30 else "open")

    got = [r[0] for r in df.select(metrics.deadline_bucket(F.col("d"), as_of.isoformat())).collect()]
    assert got == [py_bucket(d) for d, _ in rows]
