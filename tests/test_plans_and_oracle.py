"""Plan checks and every registered query against its DuckDB oracle at sf0.001."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as E
from fundscope.plans import catalog
from fundscope.sources.tables import TABLES

SF_SMALL = "/root/testdata/sf0.001"

PYTHON_STAGE_QUERIES = {"page_text", "extract_title", "drop_non_records", "extract_description",
                        "extract_requirements", "application_url", "extract_links", "resolve_url", "dated_cards",
                        "frontier_dedup", "pagination_cut", "assemble_page_record", "assemble_detail_page",
                        "rejected_pages", "classify_links", "scheme_records", "detail_fields", "detail_non_records",
                        "dated_card_fields", "teaser_card_fields", "block_fields"}
#: Their one parse feeds two branches; adaptive execution reuses its exchange, so the plan that ran counts.
REUSED = {"pagination_cut"}
STREAMING = {"stream_upsert", "stream_counts"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["category", "n", "total", "pct", "first_ord"]


def test_registry_consistent():
    qs, ors = catalog.QUERIES, catalog.ORACLE
    assert set(ors) <= set(qs)
    assert len(qs) >= 75 and set(qs) <= set(E.queries()) and set(ors) <= set(E.oracle_sql())
    for name in qs:
        assert not re.match(r"op\d+_", name)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - STREAMING))
def test_plan_shape(spark, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    if name in REUSED:
        df.collect()
    plan = _plan(df).split("== Initial Plan ==")[0]
    # the only Python stage is the HTML facts pass, at most once per query
    n_py = plan.count("MapInPandas") + plan.count("BatchEvalPython") + plan.count("ArrowEvalPython")
    assert n_py == (1 if name in PYTHON_STAGE_QUERIES else 0), plan
    assert "CartesianProduct" not in plan
    # no window without a partition spec (that would put every row in one task)
    for m in re.finditer(r"Window \[.*?\], \[(.*?)\], \[", plan):
        assert m.group(1).strip(), plan


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    d_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert {c: SPARK_TO_DUCK.get(t) for c, t in sdf.dtypes} == d_types
    cur = duck.execute(E.oracle_sql()[name])
    d_cols = [c[0] for c in cur.description]
    assert sorted(sdf.columns) == sorted(d_cols)
    assert _rows(sdf.columns, s_rows) == _rows(d_cols, cur.fetchall())
