"""URL resolution (EX-15) as a Catalyst expression: relative reference against a base URL, with the
standard library's join rules (absolute, network-path, absolute-path, query-only, fragment-only and
relative references; dot segments removed with higher-order array functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _remove_dots(segs: Column, collapse_empty: bool) -> Column:
    """Resolve '.' and '..' over an array of path segments; returns the joined path ('/' if empty).
    For a relative reference (``collapse_empty``) empty middle segments collapse (a//b -> a/b)."""
    n = F.size(segs)
    if collapse_empty:
        mid = F.when(n > 2, F.filter(F.slice(segs, 2, F.greatest(n - 2, F.lit(1))), lambda s: s != "")) \
            .otherwise(F.array().cast("array<string>"))
        segs2 = F.when(n >= 2, F.concat(F.slice(segs, 1, 1), mid, F.slice(segs, n, 1))).otherwise(segs)
    else:
        segs2 = segs
    res = F.aggregate(
        segs2, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    last = F.element_at(segs2, -1)
    res = F.when(last.isin(".", ".."), F.concat(res, F.array(F.lit("")))).otherwise(res)
    p = F.array_join(res, "/")
    # with an authority the path is rooted ('..' may have popped the leading empty segment)
    return F.when(p == "", F.lit("/")).when(~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)


def resolve_url(base, href) -> Column:
    """urljoin(base, href)."""
    b, h0 = F.coalesce(_c(base), F.lit("")), F.coalesce(_c(href), F.lit(""))
    # '//' with an empty authority is not a network path: the rest resolves against the base
    h = F.when(h0.rlike(r"^//([/?#].*)?$"), F.regexp_replace(h0, r"^//", "")).otherwise(h0)
    scheme = F.regexp_extract(b, _SCHEME, 1)
    authority = F.regexp_extract(b, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    prefix = F.concat(scheme, F.lit("://"), authority)
    bpath = F.regexp_extract(b, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    hpath = F.regexp_extract(h, r"^([^?#]*)", 1)
    hrest = F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
    bparts = F.split(bpath, "/")
    bdir = F.when(F.element_at(bparts, -1) != "", F.slice(bparts, 1, F.greatest(F.size(bparts) - 1, F.lit(0)))) \
        .otherwise(bparts)
    abs_path = _remove_dots(F.split(hpath, "/"), collapse_empty=False)
    rel_path = _remove_dots(F.concat(bdir, F.split(hpath, "/")), collapse_empty=True)
    return (F.when(h0 == "", b)
            .when(h == "", F.regexp_replace(b, "#.*$", ""))
            .when(F.regexp_extract(h, _SCHEME, 1) != "", h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("/"), F.concat(prefix, abs_path, hrest))
            .when(h.startswith("?"), F.concat(prefix, bpath, h))
            .when(h.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), h))
            .otherwise(F.concat(prefix, rel_path, hrest)))
