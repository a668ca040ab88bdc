"""Secret scan: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Runs of LONG_RUN or more token characters are scored by the log-likelihood ratio of two first-order models:
one trained on the strings that the patterns found in the whole table, one on all other runs below that
length (so none is judged by itself). What scores at
least LLR_TOTAL in all and LLR_MEAN a transition is a span of kind ``markov``, unless a pattern's span overlaps.
Counts cover every text; the models are tables of ALPHABET x ALPHABET entries. Only SQL functions are used.

Positions are code points, ends exclusive. Null text: empty, no spans. No pattern match anywhere: no model, no
markov spans. Repeated rows and ids: each row is scanned. An empty table gives no rows. Other columns are kept
out of ``scan``'s result unless named in ``columns``.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Fixed patterns: kind, pattern, group whose length counts, least length. Runs that are too short cannot hold
#: a match inside for the last two, so their least length is part of the pattern.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LONG_RUN, TRAIN_RUN = 20, 8
LLR_TOTAL, LLR_MEAN, BACKOFF = 12_000, 300, 20.0
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string>>"


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost matches that do not overlap, as SPAN; the pieces between them give the positions."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    both = F.arrays_zip(found.alias("m"), values.alias("v"), F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("bigint")).alias("gap"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    matched = F.filter(both, lambda x: x["m"].isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(matched, zero, step)["out"]).otherwise(F.array().cast(SPAN))


def with_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds __text, and __base: the patterns' spans by start, then kind."""
    out = docs.withColumn("__text", text_of(text_col).cast("string"))
    parts = [_spans(F.col("__text"), kind, k, pattern, group, least) for k, (kind, pattern, group, least) in enumerate(PATTERNS)]
    return out.withColumn("__base", F.array_sort(F.concat(*parts)))


def train(docs: DataFrame, text_col: str = "text") -> list[int] | None:
    """Log-likelihood ratios of the transitions in thousandths, a row of the alphabet after the other."""
    base = with_base(docs.select(text_col), text_col)
    clean = F.col("__text")
    for _, pattern, _, _ in PATTERNS:
        clean = F.regexp_replace(clean, pattern, " ")
    runs = F.regexp_extract_all(clean, F.lit(f"[A-Za-z0-9+/_=-]{{{TRAIN_RUN},256}}"), F.lit(0))
    secrets = F.flatten(F.transform("__base", lambda s: F.regexp_extract_all(s["value"], F.lit("[A-Za-z0-9+/_=-]{2,256}"), F.lit(0))))
    both = F.concat(F.transform(secrets, lambda r: F.struct(F.lit(1).alias("secret"), r.alias("run"))), F.transform(F.filter(runs, lambda r: F.length(r) < LONG_RUN), lambda r: F.struct(F.lit(0).alias("secret"), r.alias("run"))))
    pairs = base.select(F.explode(both).alias("r")).select(
        "r.secret", F.explode(F.transform(F.sequence(F.lit(1), F.length("r.run") - 1), lambda i: F.substring(F.col("r.run"), i, F.lit(2)))).alias("pair"))
    # at most 2 * len(ALPHABET)**2 rows
    counts = {(r["secret"], r["pair"]): r["n"] for r in pairs.groupBy("secret", "pair").agg(F.count("*").alias("n")).collect()}
    if not any(s for s, _ in counts):
        return None
    models = []
    for kind in (1, 0):
        seen = {a: [counts.get((kind, a + b), 0) for b in ALPHABET] for a in ALPHABET}
        last = [sum(row[k] for row in seen.values()) + 1 for k in range(len(ALPHABET))]
        # a transition backs off to its second character's own rate
        models.append([(n + BACKOFF * last[k] / sum(last)) / (sum(row) + BACKOFF) for row in seen.values() for k, n in enumerate(row)])
    return [round(1000 * (math.log(p) - math.log(q))) for p, q in zip(*models, strict=True)]


def _score(run: Column, weights: Column) -> Column:
    zero = F.struct(F.lit(0).alias("last"), F.lit(0).cast("bigint").alias("sum"))

    def step(acc, ch):
        at = F.instr(F.lit(ALPHABET), ch)
        return F.struct(at.alias("last"), (acc["sum"] + F.when(acc["last"] > 0, F.get(weights, (acc["last"] - 1) * len(ALPHABET) + at - 1)).otherwise(0)).alias("sum"))

    return F.aggregate(F.regexp_extract_all(run, F.lit("."), F.lit(0)), zero, step)["sum"]


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, weights: list[int] | None, text_col: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """The named columns, base and found: arrays of spans (start, rank, kind, end, value)."""
    base = with_base(docs, text_col)
    if weights is None:
        found = F.array().cast(SPAN)
    else:
        table = F.from_json(F.lit(json.dumps(weights)), "array<int>")
        runs = _spans(F.col("__text"), "markov", len(PATTERNS), f"[A-Za-z0-9+/_=-]{{{LONG_RUN},}}", 0, LONG_RUN)
        free = F.filter(runs, lambda m: ~F.exists("__base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
        scored = F.transform(free, lambda m: F.struct(m.alias("m"), _score(m["value"], table).alias("s")))
        good = F.filter(scored, lambda x: (x["s"] >= LLR_TOTAL) & (x["s"] >= LLR_MEAN * (F.length(x["m"]["value"]) - 1)))
        found = F.transform(good, lambda x: x["m"])
    return base.select(*columns, F.col("__base").alias("base"), found.alias("found"))


def digests(spans: DataFrame, *columns: str) -> DataFrame:
    """Counts and joined spans of ``scan``'s rows."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(*columns, *(count(p[0]) for p in PATTERNS), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.array_sort(F.concat("base", "found"))).alias("spans"), F.size("found").cast("long").alias("n_markov"))
