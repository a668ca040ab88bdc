"""Column -> Column scalar derivations (SC-1 .. SC-15) and the browser date semantics.

Clock reads are replaced by an explicit ``as_of`` (a 'yyyy-MM-dd' string, a date Column, or for
the batch rule a timestamp string) so every result is reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_date(as_of) -> Column:
    return F.to_date(F.lit(as_of)) if isinstance(as_of, str) else F.to_date(as_of)


# ---------------------------------------------------------------- identity


def content_id(organization, title) -> Column:
    """SC-1: slug(lower(org + '_' + title)) + '_' + md5(org + '_' + title) (md5 of the un-lowered text)."""
    combined = F.concat(F.coalesce(_c(organization), F.lit("None")), F.lit("_"),
                        F.coalesce(_c(title), F.lit("None")))
    slug = F.regexp_replace(F.regexp_replace(F.lower(combined), r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", "")
    return F.concat(slug, F.lit("_"), F.md5(combined))


def record_key(source, subcategory, rid) -> Column:
    """SNK-1: the per-record file key '{source}_{subcategory}_{id}' kept as a column."""
    return F.concat_ws("_", _c(source), _c(subcategory), _c(rid))


# ---------------------------------------------------------------- dates


def iso_date(s) -> Column:
    """Lenient 'yyyy-m-d' parse of a deadline string (strptime('%Y-%m-%d') semantics); else null."""
    s = _c(s)
    return F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(s, "yyyy-M-d"))


def js_date(s) -> Column:
    """Date the browser's ``new Date(x)`` gives for a stored deadline: ISO date -> that day (UTC);
    a bare 4-digit year -> Jan 1; null -> the epoch (1970-01-01); anything else -> null (Invalid Date)."""
    s = _c(s)
    return (F.when(s.isNull(), F.to_date(F.lit("1970-01-01")))
            .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))
            .when(s.rlike(r"^\d{4}$"), F.try_to_date(F.concat(s, F.lit("-01-01")), "yyyy-MM-dd")))


def next_deadline(deadline, frequency) -> Column:
    """SC-2: 'Annual' in frequency -> +1 year; 'Bi-annual' -> +180 days; else +365 days (ISO string)."""
    d = iso_date(deadline)
    f = F.coalesce(_c(frequency), F.lit(""))
    nd = (F.when(f.contains("Annual"), F.add_months(d, 12))
          .when(f.contains("Bi-annual"), F.date_add(d, 180))
          .otherwise(F.date_add(d, 365)))
    return F.date_format(nd, "yyyy-MM-dd")


def days_left(deadline_date, as_of) -> Column:
    """SC-14: ceil((deadline UTC midnight - now) / 1 day) == datediff(deadline, as_of date)."""
    return F.datediff(_c(deadline_date), as_date(as_of))


def days_floor_from_ts(deadline_date, as_of_ts: str) -> Column:
    """AG-1d: floor((deadline midnight - now) / 1 day) for a 'now' with a time of day.

    With now = A + f (A a date, 0 <= f < 1 day) this is datediff(deadline, A) - (f > 0); computed on
    dates only, so it does not depend on the session time zone.
    """
    day, _, clock = as_of_ts.replace("T", " ").partition(" ")
    past_midnight = 1 if clock.strip("0:. ") else 0
    return F.datediff(_c(deadline_date), F.to_date(F.lit(day))) - F.lit(past_midnight)


def format_deadline(d) -> Column:
    """SC-11: en-GB short date 'd MMM yyyy'; an invalid date prints 'Invalid Date'."""
    return F.coalesce(F.date_format(_c(d), "d MMM yyyy"), F.lit("Invalid Date"))


# ---------------------------------------------------------------- levels


def _threshold_chain(x: Column, thresholds, floor: str) -> Column:
    out = None
    for bound, label in thresholds:
        out = F.when(x >= bound, F.lit(label)) if out is None else out.when(x >= bound, F.lit(label))
    return out.otherwise(F.lit(floor))


def priority_level(max_amount, variant: str = "A") -> Column:
    """SC-3 (variant A) / SC-4 (variant B): level by the maximum amount."""
    th = rules.PRIORITY_A if variant == "A" else rules.PRIORITY_B
    return F.when(_c(max_amount).isNull(), F.lit(None)).otherwise(_threshold_chain(_c(max_amount), th,
                                                                                   rules.PRIORITY_FLOOR))


def priority_by_category(category, max_amount) -> Column:
    """Priority as each source sets it: ukri constant, academies variant A, foundations variant B."""
    cat = _c(category)
    return (F.when(cat == "ukri", F.lit(rules.UKRI_PRIORITY))
            .when(cat == "academies", priority_level(max_amount, "A"))
            .when(cat == "foundations", priority_level(max_amount, "B")))


def success_rate(stage) -> Column:
    """SC-5: success rate by career stage; unknown -> 18%."""
    m = F.create_map(*[x for k, v in rules.SUCCESS_RATES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, _c(stage)), F.lit(rules.DEFAULT_SUCCESS_RATE))


def rate_percent(rate) -> Column:
    return F.replace(_c(rate), F.lit("%"), F.lit("")).try_cast("int")


def competition_level(rate) -> Column:
    """SC-6: level from '<n>%'; a non-numeric rate (raised in the source) gives null."""
    p = rate_percent(rate)
    out = None
    for bound, label in rules.COMPETITION_LEVELS:
        out = F.when(p <= bound, F.lit(label)) if out is None else out.when(p <= bound, F.lit(label))
    return F.when(p.isNull(), F.lit(None)).otherwise(out.otherwise(F.lit(rules.COMPETITION_FLOOR)))


def _array_map(table: dict) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])


def standard_requirements(stage, variant: str = "A") -> Column:
    """SC-7: requirement list by career stage; unknown stage -> the 'All Stages' list."""
    table = rules.REQUIREMENTS_A if variant == "A" else rules.REQUIREMENTS_B
    default = F.array(*[F.lit(i) for i in table["All Stages"]])
    return F.coalesce(F.try_element_at(_array_map(table), _c(stage)), default)


def funding_covers(title) -> Column:
    """SC-8: covers by title keyword: fellowship > training > equipment > default."""
    t = F.lower(F.coalesce(_c(title), F.lit("")))
    out = None
    for kw, items in rules.COVERS_RULES:
        arr = F.array(*[F.lit(i) for i in items])
        out = F.when(t.contains(kw), arr) if out is None else out.when(t.contains(kw), arr)
    return out.otherwise(F.array(*[F.lit(i) for i in rules.COVERS_DEFAULT]))


def source_email(base_url) -> Column:
    """SC-9: contact e-mail by the source base URL; default ''."""
    m = F.create_map(*[x for k, v in rules.FOUNDATION_EMAILS for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, _c(base_url)), F.lit(""))


# ---------------------------------------------------------------- display


def format_amount(x) -> Column:
    """SC-12: above 1,000,000 divide by 100 (display guess); en-GB grouping, at most 3 decimals."""
    v = _c(x).cast("double")
    v = F.when(v > rules.DISPLAY_PENCE_ABOVE, v / 100).otherwise(v)
    return F.call_function("format_number", v, F.lit("#,##0.###"))


def amount_text(amin, amax) -> Column:
    """SC-13: '£max' when min == max, else '£min - £max'."""
    return F.when(_c(amin) == _c(amax), F.concat(F.lit("£"), format_amount(amax))).otherwise(
        F.concat(F.lit("£"), format_amount(amin), F.lit(" - £"), format_amount(amax)))


def falsy_to(x, default) -> Column:
    """JavaScript ``x || default`` for strings: null and '' fall through."""
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(default) if not isinstance(default, Column) else default)
