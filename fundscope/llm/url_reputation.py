"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted per host, registered domain and suffix. The rate of good
pages is shrunk down that tree: the suffix towards the overall rate, the domain towards its suffix, the
host towards its domain. Each step is a beta-binomial update whose prior has the parent's mean and a
strength estimated from the spread of the children's rates (method of moments). A page is allowed if the
lower bound of its host's posterior reaches a threshold. Rules (host and path prefix) come first.

Null url, or one without ``://``: empty host and path, no rule, judged by the overall rate. Hosts without
labels are judged by their domain, suffix or the overall rate. Null labels are left out. No labels at all:
the prior (PRIOR_GOOD, PRIOR_BAD) decides. Repeated rows are judged one by one. Other columns are kept out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The prior of the overall rate, as pages seen.
PRIOR_GOOD, PRIOR_BAD = 1.0, 1.0
#: Range of a level's prior strength, and its value where the rates show no spread to estimate it by.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 200.0
#: Standard deviations below the posterior mean, and the least bound that is allowed.
BOUND_Z, ALLOW_FROM = 1.0, 0.6
#: Suffixes of two labels; every other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": host, "path": path})


def with_domains(df: DataFrame) -> DataFrame:
    """Adds domain and suffix of the host (port and user part dropped); empty where there is no dot."""
    name = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2).isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return df.withColumns({"suffix": suffix, "domain": domain})


def rule_of(rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule (verdict, "host/path") as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def reputation(labelled: DataFrame) -> DataFrame:
    """Posterior of each labelled host: host, domain, suffix, and the beta parameters of every level
    (host_a, host_b, domain_a, ..., all_a, all_b). ``labelled`` has host, domain, suffix and good (0/1)."""
    counts = (labelled.where(F.col("good").isNotNull()).groupBy("suffix", "domain", "host")
              .agg(F.sum("good").cast("double").alias("k"), F.count("*").cast("double").alias("n")))
    domains = counts.groupBy("suffix", "domain").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    total = suffixes.agg(F.coalesce(F.sum("k"), F.lit(0.0)).alias("k"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"))
    total = total.select((F.col("k") + PRIOR_GOOD).alias("all_a"), (F.col("n") - F.col("k") + PRIOR_BAD).alias("all_b"))

    def strength(level: DataFrame, name: str) -> DataFrame:
        """Method of moments: the spread of the children's rates beyond binomial noise."""
        p = F.sum("k") / F.sum("n")
        spread = F.sum(F.pow("k", F.lit(2.0)) / F.col("n")) - F.pow(F.sum("k"), F.lit(2.0)) / F.sum("n")
        groups, n = F.count("*") - 1, F.sum("n")
        noise = p * (1 - p)
        share = n - F.sum(F.col("n") * F.col("n")) / n
        between = (spread - groups * noise) / share
        found = F.when((between > 0) & (share > 0), noise / between - 1)
        return level.agg(F.greatest(F.lit(LEAST_STRENGTH), F.least(F.lit(MOST_STRENGTH), F.coalesce(found, F.lit(MOST_STRENGTH)))).alias(name))

    def shrink(level: DataFrame, up: str, own: str, s: str) -> DataFrame:
        mean = F.col(f"{up}_a") / (F.col(f"{up}_a") + F.col(f"{up}_b"))
        return level.withColumns({f"{own}_a": F.col("k") + F.col(s) * mean, f"{own}_b": F.col("n") - F.col("k") + F.col(s) * (1 - mean)}).drop("k", "n", s)

    # one-row frames: the overall rate and the strength of each level
    scalars = total.crossJoin(strength(suffixes, "s1")).crossJoin(strength(domains, "s2")).crossJoin(strength(counts, "s3"))
    out = shrink(suffixes.crossJoin(F.broadcast(scalars)), "all", "suffix", "s1")
    out = shrink(domains.join(out, "suffix"), "suffix", "domain", "s2")
    return shrink(counts.join(out, ["suffix", "domain"]), "domain", "host", "s3")


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], url: str = "url",
          bound_z: float = BOUND_Z, allow_from: float = ALLOW_FROM) -> DataFrame:
    """Adds host, path, rule, verdict, level and bound to ``pages``; ``labelled`` has a url and good (0/1)."""
    seen = with_domains(with_host_path(labelled.select(F.col(url).alias("url"), "good")))
    hosts = reputation(seen)

    def level(names: list[str], keep: str) -> DataFrame:
        return hosts.groupBy(*names).agg(F.max(f"{keep}_a").alias("a"), F.max(f"{keep}_b").alias("b"))

    overall = hosts.agg(F.coalesce(F.max("all_a"), F.lit(PRIOR_GOOD)).alias("all_a"), F.coalesce(F.max("all_b"), F.lit(PRIOR_BAD)).alias("all_b"))
    named = with_host_path(pages, url)
    sites = with_domains(named.groupBy("host").agg(F.count("*").alias("n_pages")))
    by_host = hosts.select("host", F.struct(F.lit("host").alias("level"), F.col("host_a").alias("a"), F.col("host_b").alias("b")).alias("of_host"))
    by_domain = level(["domain"], "domain").select("domain", F.struct(F.lit("domain").alias("level"), "a", "b").alias("of_domain"))
    by_suffix = level(["suffix"], "suffix").select("suffix", F.struct(F.lit("suffix").alias("level"), "a", "b").alias("of_suffix"))
    # a row per host meets the levels; the pages then meet the hosts
    found = (sites.join(by_host, "host", "left").join(by_domain, "domain", "left").join(by_suffix, "suffix", "left")
             .crossJoin(F.broadcast(overall)))
    post = F.coalesce("of_host", "of_domain", "of_suffix", F.struct(F.lit("all").alias("level"), F.col("all_a").alias("a"), F.col("all_b").alias("b")))
    a, b = F.col("post.a"), F.col("post.b")
    bound = a / (a + b) - bound_z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    scores = found.withColumn("post", post).select("host", F.col("post.level").alias("level"), F.round(bound, 9).alias("bound"))
    found = named.join(scores, "host").withColumn("hit", rule_of(rules))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("bound") >= allow_from, "allow").otherwise("block"))
    return found.withColumns({"rule": F.col("hit.rule"), "verdict": verdict}).drop("hit")


#: The same over pages(page_id, url) and labels(doc_id, quality), for DuckDB; labels belong to the page of that id.
ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
                       THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
              regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
named AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS p FROM hp),
two AS (SELECT *, array_to_string(p[-2:], '.') IN ({two}) AS t FROM named),
names AS (SELECT page_id, host, path, CASE WHEN t THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix,
                 CASE WHEN t THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain FROM two),
lab AS (SELECT n.*, l.quality AS good FROM names n JOIN labels l ON l.doc_id = n.page_id WHERE l.quality IS NOT NULL),
c3 AS (SELECT suffix, domain, host, sum(good)::DOUBLE AS k, count(*)::DOUBLE AS n FROM lab GROUP BY ALL),
c2 AS (SELECT suffix, domain, sum(k) AS k, sum(n) AS n FROM c3 GROUP BY ALL),
c1 AS (SELECT suffix, sum(k) AS k, sum(n) AS n FROM c2 GROUP BY ALL),
lv AS (SELECT 1 AS lv, k, n FROM c1 UNION ALL SELECT 2, k, n FROM c2 UNION ALL SELECT 3, k, n FROM c3),
mom AS (SELECT lv, (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) AS noise,
               sum(k * k / n) - sum(k) * sum(k) / sum(n) AS spread, count(*) - 1 AS groups,
               sum(n) - sum(n * n) / sum(n) AS share FROM lv GROUP BY lv),
st AS (SELECT lv, greatest({least}, least({most}, coalesce(CASE WHEN share > 0 AND (spread - groups * noise) / share > 0
              THEN noise / ((spread - groups * noise) / share) - 1 END, {most}))) AS s FROM mom),
al AS (SELECT coalesce(sum(k), 0) + {good} AS a, coalesce(sum(n) - sum(k), 0) + {bad} AS b FROM c1),
p1 AS (SELECT suffix, k + s * (a / (a + b)) AS a, n - k + s * (1 - a / (a + b)) AS b FROM c1, al, st WHERE lv = 1),
p2 AS (SELECT suffix, domain, k + s * (a / (a + b)) AS a, n - k + s * (1 - a / (a + b)) AS b FROM c2 JOIN p1 USING (suffix), st WHERE lv = 2),
p3 AS (SELECT host, k + s * (a / (a + b)) AS a, n - k + s * (1 - a / (a + b)) AS b FROM c3 JOIN p2 USING (suffix, domain), st WHERE lv = 3),
po AS (SELECT n.page_id, n.host, n.path, coalesce(p3.a, p2.a, p1.a, al.a) AS a, coalesce(p3.b, p2.b, p1.b, al.b) AS b,
              CASE WHEN p3.a IS NOT NULL THEN 'host' WHEN p2.a IS NOT NULL THEN 'domain' WHEN p1.a IS NOT NULL THEN 'suffix' ELSE 'all' END AS level
       FROM names n LEFT JOIN p3 USING (host) LEFT JOIN p2 ON p2.domain = n.domain LEFT JOIN p1 ON p1.suffix = n.suffix, al),
bo AS (SELECT *, round(a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9) AS bound FROM po),
ru AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM bo)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN bound >= {allow} THEN 'allow' ELSE 'block' END AS verdict, level, bound FROM ru
""".format(two=", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES), least=LEAST_STRENGTH, most=MOST_STRENGTH,
           good=PRIOR_GOOD, bad=PRIOR_BAD, z=BOUND_Z, allow=ALLOW_FROM)
