"""DuckDB twins of the test-binding views, as CTE bodies for ``oracle_sql()``.

They are flat (no structs) so the oracle computes answers from plain columns, independently of
the Spark operators. ``with_views(sql, *names)`` prefixes the needed CTEs.
"""

from __future__ import annotations

BASE = """
base AS (
  SELECT o.o_orderkey AS k,
         CAST(o.o_orderdate AS DATE) AS d,
         o.o_orderdate AS o_orderdate,
         CASE o.o_orderkey % 5 WHEN 0 THEN 'fellowship' WHEN 1 THEN 'grant' WHEN 2 THEN 'equipment'
              WHEN 3 THEN 'training' ELSE 'network' END AS kind,
         CASE WHEN o.o_orderkey % 11 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(o.o_totalprice) AS BIGINT) END AS lo,
         n.n_name, c.c_nationkey, c.c_mktsegment, o.o_orderstatus, o.o_orderpriority,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Early Career' WHEN '2-HIGH' THEN 'Mid Career'
              WHEN '3-MEDIUM' THEN 'Senior' WHEN '4-NOT SPECIFIED' THEN 'All Stages' END AS career_stage,
         CAST(1 + o.o_orderkey % 5 AS INTEGER) AS dur
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
),
base2 AS (
  SELECT *,
         CASE WHEN k % 17 = 0 THEN CAST(0 AS BIGINT) ELSE lo * (1 + k % 3) END AS hi,
         'Scheme ' || CAST(k % 997 AS VARCHAR) || ' ' || kind AS title,
         COALESCE(CASE career_stage WHEN 'Early Career' THEN 'early career researchers'
                  WHEN 'Mid Career' THEN 'fellowship holders' WHEN 'Senior' THEN 'senior professors'
                  WHEN 'All Stages' THEN 'all researchers' END, 'everyone') AS phrase
  FROM base
)"""

OPPORTUNITIES = """
opportunities AS (
  SELECT k AS ord, d, kind, lo, hi, dur, title,
         trim(regexp_replace(lower(n_name || '_' || title), '[^a-zA-Z0-9]+', '_', 'g'), '_') || '_'
             || md5(n_name || '_' || title) AS id,
         n_name AS organization,
         lower(n_name) AS subcategory,
         CASE WHEN k % 101 = 0 THEN NULL ELSE CASE c_nationkey % 3 WHEN 0 THEN 'ukri' WHEN 1 THEN 'academies'
              ELSE 'foundations' END END AS category,
         'Support for ' || kind || ' work in ' || n_name || ' for the ' || lower(c_mktsegment) || ' sector'
             AS description,
         career_stage,
         c_mktsegment AS discipline,
         CASE WHEN k % 13 = 0 THEN 'N/A' WHEN k % 13 = 1 THEN 'Rolling' WHEN k % 13 = 2 THEN NULL
              WHEN k % 13 = 3 THEN '' ELSE strftime(d, '%Y-%m-%d') END AS deadline,
         CASE k % 3 WHEN 0 THEN 'Annual' WHEN 1 THEN 'Bi-annual' ELSE 'Multiple rounds' END AS frequency,
         'https://apply.example.org/scheme/' || CAST(k AS VARCHAR) AS application_url,
         CASE WHEN k % 7 = 0 THEN (CASE WHEN k % 2 = 0 THEN '' ELSE 'N/A' END)
              ELSE CAST(5 * (k % 7 + 1) AS VARCHAR) || '%' END AS success_rate,
         kind AS tag1, lower(c_mktsegment) AS tag2,
         o_orderdate AS last_updated,
         CASE WHEN c_nationkey % 5 = 4 THEN 'https://www.ukri.org/opportunity/scheme-' || CAST(k AS VARCHAR) || '/'
              WHEN c_nationkey % 5 = 0 THEN 'https://wellcome.org'
              WHEN c_nationkey % 5 = 1 THEN 'https://www.leverhulme.ac.uk'
              WHEN c_nationkey % 5 = 2 THEN 'https://www.nuffieldfoundation.org'
              ELSE 'https://www.wolfson.org.uk' END AS scraped_from,
         CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'active' END AS status
  FROM base2
),
opps AS (
  SELECT *,
         CASE WHEN deadline IS NULL THEN DATE '1970-01-01'
              WHEN regexp_matches(deadline, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_cast(deadline AS DATE)
              WHEN regexp_matches(deadline, '^[0-9]{4}$') THEN try_cast(deadline || '-01-01' AS DATE) END AS js_d,
         CASE WHEN regexp_matches(deadline, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$')
              THEN try_cast(deadline AS DATE) END AS iso_d
  FROM opportunities
)"""

NOTICES = """
notices AS (
  SELECT k AS notice_id, title, n_name AS organization, lower(n_name) AS subcategory, k, d, lo, hi, dur,
         career_stage, phrase, CAST(1 + k % 9 AS BIGINT) AS a,
         CASE WHEN k % 4 = 0 THEN 'Award of £' || CAST(lo AS VARCHAR) || ' - £' || CAST(hi AS VARCHAR) || ' for '
                   || CAST(dur AS VARCHAR) || ' years to ' || phrase || '. Closing ' || strftime(d, '%Y-%m-%d') || '.'
              WHEN k % 4 = 1 THEN 'Grants of ' || CAST(CAST(floor(lo / 1000) AS BIGINT) AS VARCHAR) || '-'
                   || CAST(CAST(floor(hi / 1000) AS BIGINT) AS VARCHAR) || 'k over ' || CAST(dur AS VARCHAR)
                   || ' years to ' || phrase || ', closing ' || CAST(day(d) AS VARCHAR) || '/'
                   || CAST(month(d) AS VARCHAR) || '/' || CAST(year(d) AS VARCHAR)
              WHEN k % 4 = 2 THEN 'Up to ' || CAST(1 + k % 9 AS VARCHAR) || ' million over ' || CAST(dur AS VARCHAR)
                   || ' years to ' || phrase || '; deadline ' || CAST(day(d) AS VARCHAR) || ' ' || monthname(d)
                   || ' ' || CAST(year(d) AS VARCHAR)
              ELSE 'Funding, known in advance, for ' || CAST(dur AS VARCHAR) || ' years to ' || phrase || '.'
                   || CASE WHEN k % 8 = 7 THEN ' Deadline ' || CAST(year(d) AS VARCHAR) || '-'
                           || CAST(month(d) AS VARCHAR) || '-' || CAST(day(d) AS VARCHAR) ELSE '' END
         END AS text
  FROM base2
)"""

LEAFLETS = """
leaflets AS (
  SELECT k AS leaflet_id, k, d, lo, hi, dur, title, phrase, CAST(1 + k % 9 AS BIGINT) AS a,
         CASE k % 3 WHEN 0 THEN 'Annual' WHEN 1 THEN 'Bi-annual' ELSE 'Multiple rounds' END AS frequency
  FROM base2
)"""

TEASERS = """
teasers AS (
  SELECT k AS card_id, k, lo, dur, title, CAST(1 + k % 9 AS BIGINT) AS a FROM base2
)"""

_VIEWS = {"opportunities": OPPORTUNITIES, "notices": NOTICES, "leaflets": LEAFLETS, "teasers": TEASERS}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the base CTEs and the named view CTEs (``sql`` may open with its own WITH)."""
    parts = [BASE.strip()] + [_VIEWS[n].strip() for n in names]
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(parts) + ",\n" + body[4:].strip()
    return "WITH " + ",\n".join(parts) + "\n" + body
