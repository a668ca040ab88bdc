"""Column -> Column text extraction (EX-1, EX-6..EX-11, EX-13, EX-16, EX-17).

All of these are Catalyst expressions (regexp_extract, contains, try_cast, try_to_date ...), so
they run inside whole-stage codegen with no Python worker. Regexes are compiled once per task.
Where the source system's semantics are odd (whole-text scale, failed integer parses, pattern
priority) the faithful behaviour is the default; see SURVEY §2.8.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules

# Python's str whitespace (29 code points) = Unicode White_Space (Java's (?U)\s, 25) + \x1c-\x1f.
# Scoped flag group, so Unicode mode does not reach \d elsewhere in a pattern.
WS = r"(?U:[\s\x1c-\x1f])"

AMOUNT_PATTERNS = [
    rf"(?i)£([\d,]+)(?:{WS}*-{WS}*£([\d,]+))?",
    rf"(?i)([\d,]+)(?:{WS}*-{WS}*([\d,]+))?{WS}*(?:thousand|k)",
    rf"(?i)([\d,]+)(?:{WS}*-{WS}*([\d,]+))?{WS}*(?:million|m)",
]
# D2 option: amounts may carry a decimal part
AMOUNT_PATTERNS_DECIMAL = [p.replace(r"([\d,]+)", r"([\d,]+(?:\.\d+)?)") for p in AMOUNT_PATTERNS]
DURATION_PATTERN = rf"(?i)(\d+){WS}*year"
_MONTH_ALT = "|".join(rules.MONTHS)
DEADLINE_NAMED = rf"(?i)(\d{{1,2}}){WS}+({_MONTH_ALT}){WS}+(\d{{4}})"
DEADLINE_SLASH = r"(\d{1,2})/(\d{1,2})/(\d{4})"
DEADLINE_ISO = r"(\d{4})-(\d{1,2})-(\d{1,2})"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(col) -> Column:
    """EX-1: null/'' -> ''; whitespace runs -> one space; trim; then the four entity replaces in order."""
    c = F.coalesce(_c(col), F.lit(""))
    c = F.trim(F.regexp_replace(c, WS + "+", " "))
    for search, repl in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(search), F.lit(repl))
    return c


def _nz(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _parse_int(s: Column) -> Column:
    """Digits of a '[\\d,]+' token as bigint; a token with no digit (',') gives null = parse failure."""
    return _nz(F.regexp_replace(s, r"[^0-9]", "")).try_cast("bigint")


def _parse_decimal(s: Column) -> Column:
    """D2 option: '[\\d,]+(.\\d+)?' token as double (commas dropped); no digit -> null."""
    digits = _nz(F.regexp_replace(s, r"[^0-9.]", ""))
    return F.when(digits.rlike(r"[0-9]"), digits.try_cast("double"))


def extract_amount(text) -> Column:
    """EX-7/EX-8: struct(min, max, currency, parsed).

    First of three patterns that matches wins; the scale is decided by the WHOLE text (any 'k' or
    'thousand' -> x1000, else any 'm'/'million' -> x1e6). ``parsed`` is false when a matched token
    holds no digit (", known"), where the source system raised and kept its defaults.
    No match -> 0/0 with parsed true.

    This single-expression form suits short texts; on large inputs use the staged ``with_amount``,
    which gives the same result with each regex evaluated once and gated on its marker.
    """
    t = F.coalesce(_c(text), F.lit(""))
    lt = F.lower(t)
    g = []
    for p in AMOUNT_PATTERNS:
        g.append((F.regexp_extract(t, p, 0), F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2)))
    hit = [(_nz(g0).isNotNull()) for g0, _, _ in g]
    g1 = F.when(hit[0], g[0][1]).when(hit[1], g[1][1]).when(hit[2], g[2][1])
    g2 = F.when(hit[0], g[0][2]).when(hit[1], g[1][2]).when(hit[2], g[2][2])
    any_hit = hit[0] | hit[1] | hit[2]
    lo = _parse_int(g1)
    hi = F.when(_nz(g2).isNull(), lo).otherwise(_parse_int(g2))
    scale = (F.when(lt.contains("thousand") | lt.contains("k"), F.lit(1000))
             .when(lt.contains("million") | lt.contains("m"), F.lit(1000000))
             .otherwise(F.lit(1)))
    parsed = ~any_hit | (lo.isNotNull() & hi.isNotNull())
    lo_v = F.when(~any_hit, F.lit(0).cast("bigint")).otherwise(F.try_multiply(lo, scale.cast("bigint")))
    hi_v = F.when(~any_hit, F.lit(0).cast("bigint")).otherwise(F.try_multiply(hi, scale.cast("bigint")))
    return F.struct(
        F.when(parsed, lo_v).alias("min"),
        F.when(parsed, hi_v).alias("max"),
        F.lit("GBP").alias("currency"),
        parsed.alias("parsed"),
    )


def with_amount(df, text_col: str, out: str = "amount", scale_scope: str = "document", allow_decimal: bool = False):
    """EX-7/EX-8 as a staged DataFrame transform (same result as ``extract_amount`` by default).

    A pattern can only match when the text holds its marker ('£', 'k'/'thousand', 'm'), the same
    flags that decide the scale; so each scan is gated on its marker and runs only when the
    earlier patterns missed. The groups are re-read from the short match, and every later step
    references the staged columns, so no regex is evaluated twice.

    Options (SURVEY D1, D2): ``scale_scope='match'`` takes the scale from the matched amount only
    (its own 'k'/'thousand'/'m'/'million' suffix, or the word right after a '£' amount) instead of
    from the whole text; ``allow_decimal=True`` keeps a decimal part ('£1.5 million' -> 1,500,000).
    """
    if scale_scope not in ("document", "match"):
        raise ValueError("scale_scope must be 'document' or 'match'")
    pats = AMOUNT_PATTERNS_DECIMAL if allow_decimal else AMOUNT_PATTERNS
    t = F.coalesce(F.col(text_col), F.lit(""))
    lt = F.lower(t)
    df = df.withColumn("_amlt", lt)
    df = df.withColumns({"_amp": F.col(text_col).contains("£"),
                         "_amkf": F.col("_amlt").contains("thousand") | F.col("_amlt").contains("k"),
                         "_ammf": F.col("_amlt").contains("million") | F.col("_amlt").contains("m")})
    df = df.withColumn("_am0", F.when(F.col("_amp"), F.regexp_extract(t, pats[0], 0)).otherwise(""))
    df = df.withColumn("_am1", F.when((F.col("_am0") == "") & F.col("_amkf"),
                                      F.regexp_extract(t, pats[1], 0)).otherwise(""))
    df = df.withColumn("_am2", F.when((F.col("_am0") == "") & (F.col("_am1") == "") & F.col("_ammf"),
                                      F.regexp_extract(t, pats[2], 0)).otherwise(""))
    df = df.withColumn("_amk", F.when(F.col("_am0") != "", 0).when(F.col("_am1") != "", 1)
                       .when(F.col("_am2") != "", 2))
    g1 = g2 = None
    for i, p in enumerate(pats):
        e1, e2 = F.regexp_extract(F.col(f"_am{i}"), p, 1), F.regexp_extract(F.col(f"_am{i}"), p, 2)
        g1 = F.when(F.col("_amk") == i, e1) if g1 is None else g1.when(F.col("_amk") == i, e1)
        g2 = F.when(F.col("_amk") == i, e2) if g2 is None else g2.when(F.col("_amk") == i, e2)
    if scale_scope == "document":
        scale = (F.when(F.col("_amkf"), F.lit(1000)).when(F.col("_ammf"), F.lit(1000000))
                 .otherwise(F.lit(1))).cast("bigint")
    else:
        m = F.coalesce(_nz(F.col("_am0")), _nz(F.col("_am1")), _nz(F.col("_am2")), F.lit(""))
        after = t.substr(F.position(m, t) + F.length(m), F.length(t))
        unit = F.lower(F.when(F.col("_amk") == 0, F.regexp_extract(after, rf"(?i)^{WS}*(thousand|million|k|m)\b", 1))
                       .otherwise(F.regexp_extract(m, r"(?i)(thousand|million|k|m)$", 1)))
        scale = (F.when(unit.isin("thousand", "k"), F.lit(1000)).when(unit.isin("million", "m"), F.lit(1000000))
                 .otherwise(F.lit(1))).cast("bigint")
    parse = _parse_decimal if allow_decimal else _parse_int
    df = df.withColumns({"_amlo": parse(g1), "_amg2": _nz(g2), "_amsc": scale})
    df = df.withColumn("_amhi", F.when(F.col("_amg2").isNull(), F.col("_amlo")).otherwise(parse(F.col("_amg2"))))
    hit = F.col("_amk").isNotNull()
    parsed = ~hit | (F.col("_amlo").isNotNull() & F.col("_amhi").isNotNull())
    zero = F.lit(0).cast("bigint")
    def scaled(c):
        if allow_decimal:
            return F.floor(c * F.col("_amsc")).try_cast("bigint")
        return F.try_multiply(c, F.col("_amsc"))

    res = F.struct(
        F.when(parsed, F.when(~hit, zero).otherwise(scaled(F.col("_amlo")))).alias("min"),
        F.when(parsed, F.when(~hit, zero).otherwise(scaled(F.col("_amhi")))).alias("max"),
        F.lit("GBP").alias("currency"),
        parsed.alias("parsed"))
    return df.withColumn(out, res).drop("_amlt", "_amp", "_amkf", "_ammf", "_am0", "_am1", "_am2", "_amk", "_amlo",
                                        "_amg2", "_amsc", "_amhi")


def amount_with_defaults(text) -> Column:
    """EX-8: the detail-page path: a failed parse keeps the defaults 0 / 0."""
    a = extract_amount(text)
    return F.struct(
        F.when(a["parsed"], a["min"]).otherwise(F.lit(0).cast("bigint")).alias("min"),
        F.when(a["parsed"], a["max"]).otherwise(F.lit(0).cast("bigint")).alias("max"),
        F.lit("GBP").alias("currency"),
    )


def duration_years(text, default: int = 1) -> Column:
    """EX-9: first '<n> year' (case-insensitive), else ``default``."""
    n = _nz(F.regexp_extract(F.coalesce(_c(text), F.lit("")), DURATION_PATTERN, 1)).try_cast("int")
    return F.coalesce(n, F.lit(default))


def ymd_date(y: Column, m: Column, d: Column) -> Column:
    """Strict calendar date from integer parts; invalid (Feb 31, year 0) -> null."""
    iso = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"),
                      F.lpad(d.cast("string"), 2, "0"))
    return F.when(y >= 1, F.try_to_date(iso, "yyyy-MM-dd"))


def extract_deadline(text) -> Column:
    """EX-10: pattern priority (named month, then d/m/yyyy, then yyyy-m-d); the first match of each
    pattern only; an invalid date falls through to the next pattern. Returns DateType or null."""
    t = F.coalesce(_c(text), F.lit(""))
    months = F.array(*[F.lit(m.lower()) for m in rules.MONTHS])

    def grp(p, i):
        return _nz(F.regexp_extract(t, p, i)).try_cast("int")

    named = ymd_date(grp(DEADLINE_NAMED, 3),
                     F.array_position(months, F.lower(F.regexp_extract(t, DEADLINE_NAMED, 2))).cast("int"),
                     grp(DEADLINE_NAMED, 1))
    slash = ymd_date(grp(DEADLINE_SLASH, 3), grp(DEADLINE_SLASH, 2), grp(DEADLINE_SLASH, 1))
    iso = ymd_date(grp(DEADLINE_ISO, 1), grp(DEADLINE_ISO, 2), grp(DEADLINE_ISO, 3))
    return F.coalesce(named, slash, iso)


def _dates_not_before(t: Column, pattern: str, order, not_before: str, months: Column) -> Column:
    """All matches of one date pattern as dates, keeping the first on or after ``not_before``."""
    g = [F.regexp_extract_all(t, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    parts = F.arrays_zip(*g)

    idx = {k: i for i, k in enumerate(order)}

    def to_date(x):
        v = [x[f"{i}"] for i in range(3)]
        if "name" in idx:
            mnum = F.array_position(months, F.lower(v[idx["name"]])).cast("int")
        else:
            mnum = v[idx["m"]].try_cast("int")
        return ymd_date(v[idx["y"]].try_cast("int"), mnum, v[idx["d"]].try_cast("int"))

    dates = F.transform(parts, to_date)
    return F.try_element_at(F.filter(dates, lambda x: x >= F.to_date(F.lit(not_before))), F.lit(1))


def with_deadline(df, text_col: str, out: str = "deadline", not_before: str | None = None):
    """EX-10 as a staged DataFrame transform (same result as ``extract_deadline``): one scan per
    pattern, groups re-read from the short match.

    Option ``not_before`` (SURVEY D3): dates before it are skipped; every match of a pattern is then
    considered (pattern priority kept), and the first valid date on or after the bound wins.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    if not_before is not None:
        months = F.array(*[F.lit(m.lower()) for m in rules.MONTHS])
        res = F.coalesce(_dates_not_before(t, DEADLINE_NAMED, ("d", "name", "y"), not_before, months),
                         _dates_not_before(t, DEADLINE_SLASH, ("d", "m", "y"), not_before, months),
                         _dates_not_before(t, DEADLINE_ISO, ("y", "m", "d"), not_before, months))
        return df.withColumn(out, res)
    pats = {"_dn": DEADLINE_NAMED, "_ds": DEADLINE_SLASH, "_di": DEADLINE_ISO}
    df = df.withColumns({k: F.regexp_extract(t, p, 0) for k, p in pats.items()})
    months = F.array(*[F.lit(m.lower()) for m in rules.MONTHS])

    def grp(k, i):
        return _nz(F.regexp_extract(F.col(k), pats[k], i)).try_cast("int")

    df = df.withColumns({
        "_dny": grp("_dn", 3), "_dnd": grp("_dn", 1),
        "_dnm": F.array_position(months, F.lower(F.regexp_extract(F.col("_dn"), DEADLINE_NAMED, 2))).cast("int"),
        "_dsy": grp("_ds", 3), "_dsm": grp("_ds", 2), "_dsd": grp("_ds", 1),
        "_diy": grp("_di", 1), "_dim": grp("_di", 2), "_did": grp("_di", 3)})
    res = F.coalesce(ymd_date(F.col("_dny"), F.col("_dnm"), F.col("_dnd")),
                     ymd_date(F.col("_dsy"), F.col("_dsm"), F.col("_dsd")),
                     ymd_date(F.col("_diy"), F.col("_dim"), F.col("_did")))
    return df.withColumn(out, res).drop(*pats, "_dny", "_dnd", "_dnm", "_dsy", "_dsm", "_dsd", "_diy", "_dim", "_did")


def deadline_defaults(extracted_date, as_of) -> Column:
    """EX-11: struct(deadline, next_deadline, frequency, deadline_is_default) relative to the crawl date."""
    as_of = F.to_date(_c(as_of)) if not isinstance(as_of, str) else F.to_date(F.lit(as_of))
    d = _c(extracted_date)
    return F.struct(
        F.coalesce(d, F.date_add(as_of, rules.DEFAULT_DEADLINE_DAYS)).alias("deadline"),
        F.date_add(as_of, rules.DEFAULT_NEXT_DEADLINE_DAYS).alias("next_deadline"),
        F.lit(rules.DEFAULT_FREQUENCY).alias("frequency"),
        d.isNull().alias("deadline_is_default"),
    )


def first_email(text) -> Column:
    """EX-13: first e-mail address in the text, else ''. Texts without '@' skip the regex."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.when(t.contains("@"), F.regexp_extract(t, rules.EMAIL_PATTERN, 0)).otherwise(F.lit(""))


def career_stage(text) -> Column:
    """EX-6: first stage whose keyword occurs in the lowercased text; else 'All Stages'."""
    lt = F.lower(F.coalesce(_c(text), F.lit("")))
    out = None
    for stage, kws in rules.CAREER_STAGE_RULES:
        cond = None
        for kw in kws:
            cond = lt.contains(kw) if cond is None else (cond | lt.contains(kw))
        out = F.when(cond, F.lit(stage)) if out is None else out.when(cond, F.lit(stage))
    return out.otherwise(F.lit(rules.DEFAULT_CAREER_STAGE))


def keyword_council(lowered: Column) -> Column:
    """The first council with a keyword in the lowered text; null if none."""
    out = None
    for cid, kws in rules.COUNCIL_KEYWORDS:
        cond = None
        for kw in kws:
            cond = lowered.contains(kw) if cond is None else (cond | lowered.contains(kw))
        out = F.when(cond, F.lit(cid)) if out is None else out.when(cond, F.lit(cid))
    return out


def classify_source(url, text=None) -> Column:
    """EX-16: first council (rule order) with a keyword in lower(url); else the same test on the
    page text (only evaluated for url misses, since CASE/COALESCE are lazy); else the default."""
    by_url = keyword_council(F.lower(F.coalesce(_c(url), F.lit(""))))
    parts = [by_url]
    if text is not None:
        parts.append(keyword_council(F.lower(F.coalesce(_c(text), F.lit("")))))
    parts.append(F.lit(rules.DEFAULT_COUNCIL))
    return F.coalesce(*parts)


def with_source_class(df, url_col: str, text_col: str | None, out: str = "council", default: str | None = rules.DEFAULT_COUNCIL):
    """EX-16 as a staged DataFrame transform: the lowered url and text are computed once each, and the
    text chain runs only for url misses. ``default=None`` leaves undecided rows null."""
    df = df.withColumn("_scu", keyword_council(F.lower(F.coalesce(F.col(url_col), F.lit("")))))
    if text_col is None:
        return df.withColumn(out, F.coalesce(F.col("_scu"), F.lit(default))).drop("_scu")
    df = df.withColumn("_sct", F.when(F.col("_scu").isNull(), F.lower(F.coalesce(F.col(text_col), F.lit("")))))
    res = F.coalesce(F.col("_scu"), keyword_council(F.col("_sct")), F.lit(default))
    return df.withColumn(out, res).drop("_scu", "_sct")


def generate_tags(source, title, description) -> Column:
    """EX-17: [source] followed by the tag of every keyword found in lower(title + ' ' + description)."""
    t = F.lower(F.concat_ws(" ", F.coalesce(_c(title), F.lit("")), F.coalesce(_c(description), F.lit(""))))
    found = F.array(*[F.when(t.contains(kw), F.lit(tag)) for kw, tag in rules.TAG_KEYWORDS])
    return F.concat(F.array(_c(source).cast("string")), F.filter(found, lambda x: x.isNotNull()))
