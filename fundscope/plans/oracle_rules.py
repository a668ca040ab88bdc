"""DuckDB CASE expressions for the rule tables, used by the oracles only."""

from __future__ import annotations

from .. import rules
from ..sources.records import dimension_rows


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def requirements_sql(stage: str, variant: str) -> str:
    table = rules.REQUIREMENTS_A if variant == "A" else rules.REQUIREMENTS_B
    whens = " ".join(f"WHEN {q(k)} THEN {q('; '.join(v))}" for k, v in table.items())
    return f"(CASE {stage} {whens} ELSE {q('; '.join(table['All Stages']))} END)"


def success_sql(stage: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in rules.SUCCESS_RATES.items())
    return f"COALESCE(CASE {stage} {whens} END, {q(rules.DEFAULT_SUCCESS_RATE)})"


def priority_sql(x: str, variant: str) -> str:
    th = rules.PRIORITY_A if variant == "A" else rules.PRIORITY_B
    whens = " ".join(f"WHEN {x} >= {b} THEN {q(lv)}" for b, lv in th)
    return f"(CASE WHEN {x} IS NULL THEN NULL {whens} ELSE {q(rules.PRIORITY_FLOOR)} END)"


def competition_sql(rate: str) -> str:
    p = f"try_cast(replace({rate}, '%', '') AS INTEGER)"
    whens = " ".join(f"WHEN {p} <= {b} THEN {q(lv)}" for b, lv in rules.COMPETITION_LEVELS)
    return f"(CASE WHEN {p} IS NULL THEN NULL {whens} ELSE {q(rules.COMPETITION_FLOOR)} END)"


def covers_sql(title: str) -> str:
    whens = " ".join(f"WHEN contains(lower({title}), {q(kw)}) THEN {q(', '.join(v))}" for kw, v in rules.COVERS_RULES)
    return f"(CASE {whens} ELSE {q(', '.join(rules.COVERS_DEFAULT))} END)"


def email_sql(url: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in rules.FOUNDATION_EMAILS)
    return f"COALESCE(CASE {url} {whens} END, '')"


def next_deadline_sql(iso_d: str, freq: str) -> str:
    return (f"strftime(CASE WHEN contains({freq}, 'Annual') THEN CAST({iso_d} + INTERVAL 12 MONTH AS DATE) "
            f"WHEN contains({freq}, 'Bi-annual') THEN {iso_d} + 180 ELSE {iso_d} + 365 END, '%Y-%m-%d')")


def content_id_sql(org: str, title: str) -> str:
    c = f"({org} || '_' || {title})"
    return f"(trim(regexp_replace(lower({c}), '[^a-zA-Z0-9]+', '_', 'g'), '_') || '_' || md5({c}))"


def dims_sql() -> str:
    """The source dimension as a VALUES relation (source_id, kind, name, base_url, disciplines_text)."""
    rows = ", ".join(f"({q(r[0])}, {q(r[1])}, {q(r[2])}, {q(r[3])}, {q(', '.join(r[5]))})" for r in dimension_rows())
    return f"(VALUES {rows}) AS dims(source_id, kind, name, base_url, disciplines_text)"


def pick_sql(values, idx: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values))
    return f"(CASE {idx} {whens} END)"
