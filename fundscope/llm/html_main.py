"""Main text of web pages: site template removal by subtree hashes counted per host.

Two passes over the pages. The first parses each page and hashes its container subtrees (tag, class, id and
text of everything below); Spark counts in how many pages of a host each hash occurs, pages with the same text
around it once, and those in at least MIN_PAGES are its template, however large the host. What may be text of
an article (lists and figures inside it, and subtrees of LONG characters that hold over half of the page's text) must
also be on MIN_SHARE of the host's pages. The second pass drops, on each page, the
subtrees found in the template, together with elements that are furniture by their tag, role or class, and
writes the remaining blocks of the article (of the body, if there is none). Text blocks of an article
(paragraphs, headings, list items, quotations, tables) are never template, however often they recur.

Null html: empty text. Null url: the empty host. Broken markup is read as browsers do where it matters: a
block tag ends an open paragraph, unknown end tags are skipped, the end of the text closes everything.
Repeated page ids and rows: each row gets its own text. Other columns
pass through unless they have the names of the new ones. An empty table gives no rows.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: A subtree is template if it is on so many pages of the host; if it may be an article's text, also on this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.3
#: Characters from which over half of a page's text may be its article.
LONG = 400
LISTS = frozenset("ul ol dl details figure center address".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that never hold main text.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe object select button textarea dialog menu head title svg math canvas audio video input label fieldset noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert".split())
#: Words of a class or id that mark furniture.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended comment comments disqus reply replies cookie cookies consent notice notices popup modal newsletter subscribe subscription signup login share sharing social toolbar pagination pager".split())
#: Of these, marks of headers (an article's own header is kept), and those that also rule out an article.
HEAD_MARKS = frozenset("header masthead banner".split())
ARTICLE_MARKS = frozenset("ad ads advert promo promoted sponsored teaser related recommended comment comments reply widget".split())
CONTAINERS = frozenset("div section nav ul ol dl aside header footer form menu figure fieldset center dialog address details".split())
CLOSES_P = BLOCK - {"html", "body"}
#: What a new start tag closes if it is open, looking no further up than the second set.
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
                "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    __slots__ = ("tag", "mark", "role", "hidden", "kids", "digest")

    def __init__(self, tag: str, mark: str = "", role: str = "", hidden: bool = False) -> None:
        self.tag, self.mark, self.role, self.hidden, self.kids, self.digest = tag, mark, role, hidden, [], None


def parse(text: str) -> Node:
    """A tree of elements and character data (strings)."""
    root = Node("#page")
    stack = [root]
    at, n = 0, len(text)
    while at < n:
        m = TOKEN.search(text, at)
        if not m:
            stack[-1].kids.append(text[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(text[at : m.start()])
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if m[1]:
            _close(stack, tag)
            continue
        if tag in CLOSES_P:
            _close_until(stack, {"p"}, BLOCK - {"p"})
        if tag in SELF_CLOSING:
            _close_until(stack, *SELF_CLOSING[tag])
        node = _element(tag, m[3])
        stack[-1].kids.append(node)
        if tag in RAW:
            end = RAW[tag].search(text, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    return root


def _element(tag: str, rest: str) -> Node:
    if not rest or rest.isspace():
        return Node(tag)
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)}
    hidden = re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", rest) is not None or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    return Node(tag, f"{found.get('class', '')} {found.get('id', '')}".lower(), found.get("role", "").lower(), hidden)


def _close(stack: list[Node], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in ("article", "main", "body") and tag not in ("html", "body", "main", "article"):
            return


def _close_until(stack: list[Node], tags: set, limit: frozenset | set) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in limit:
            return


def hashes(root: Node) -> list[tuple[int, Node]]:
    """The digest of every container subtree, computed from the leaves up (no recursion)."""
    order, found = [root], []
    for node in order:
        order.extend(k for k in node.kids if isinstance(k, Node))
    for node in reversed(order):
        h = blake2b(f"{node.tag}|{node.mark}|{node.role}".encode(), digest_size=8)
        size = 0
        for k in node.kids:
            data = k.digest if isinstance(k, Node) else " ".join(k.split()).encode()
            size += len(data)
            h.update(data + b"\0")
        node.digest = h.digest()
        if size and node.tag in CONTAINERS:
            found.append((int.from_bytes(node.digest, "little", signed=True), node))
    return found


def _furniture(node: Node, in_main: bool) -> bool:
    if node.hidden or node.tag in DROPPED and not (in_main and node.tag == "header") or node.role in ROLES:
        return True
    if not node.mark.strip() or node.tag in ("body", "html", "main"):
        return False
    words = set(re.split(r"[^a-z0-9]+", node.mark))
    if node.tag == "article":
        return not words.isdisjoint(ARTICLE_MARKS)
    return not words.isdisjoint(MARKS - HEAD_MARKS if in_main else MARKS)


def main_text(root: Node, template: set[int]) -> str:
    """Blocks of the main article, in order, joined by an empty line."""
    drop: set[int] = set()
    if template:
        drop = {id(node) for h, node in hashes(root) if h in template}

    def keep(node: Node, in_main: bool) -> bool:
        return not (_furniture(node, in_main) or id(node) in drop)

    tops = _find(root, ("article",), keep) or _find(root, ("main",), keep) or [root]
    blocks: list[str] = []
    waiting: list[str] = []

    def flush() -> None:
        text = " ".join("".join(waiting).split())
        if text:
            blocks.append(text)
        waiting.clear()

    for top in tops:
        work: list = [top]
        while work:
            item = work.pop()
            if isinstance(item, str):
                waiting.append(htmllib.unescape(item))  # piece by piece: a reference does not reach over a tag
            elif item is None:
                flush()
            else:
                if item is not top and not keep(item, top is not root):
                    if item.tag in BLOCK:
                        flush()
                    continue
                if item.tag == "br":
                    waiting.append(" ")
                if item.tag in BLOCK or item is top:
                    flush()
                    work.append(None)
                work.extend(reversed(item.kids))
        flush()
    return "\n\n".join(blocks)


def _find(root: Node, tags: tuple[str, ...], keep) -> list[Node]:
    """Outermost elements of these tags outside dropped subtrees, in page order."""
    out, work = [], [root]
    while work:
        node = work.pop()
        if node.tag in tags and (node is root or keep(node, False)):
            out.append(node)
        elif node is root or keep(node, False):
            work.extend(reversed([k for k in node.kids if isinstance(k, Node)]))
    return out


def _texts(pages: DataFrame, html: str, *columns):
    return pages.select(*columns, F.coalesce(F.col(html).cast("string"), F.lit("")).alias("__html"))


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))


def subtrees(root: Node) -> set[tuple[int, int, bool]]:
    """Digest, hash of the text around, and whether it may be text of an article, of the container subtrees that the
    main text may hold."""
    digests = {id(node): h for h, node in hashes(root)}
    keep = lambda node, in_main: not _furniture(node, in_main)
    tops = {id(t) for t in _find(root, ("article",), keep) or _find(root, ("main",), keep) or [root]}
    nodes, above, within = [root], [-1], [id(root) in tops]
    for k, node in enumerate(nodes):
        for kid in node.kids:
            if isinstance(kid, Node) and not _furniture(kid, True):
                nodes.append(kid), above.append(k), within.append(within[k] or id(kid) in tops)
    held, size = [0] * len(nodes), [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        for text in (" ".join(t.split()) for t in nodes[k].kids if isinstance(t, str)) if within[k] else ():
            if text:
                held[k] += int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little")
                size[k] += len(text)
        if k:
            held[above[k]] += held[k]
            size[above[k]] += size[k]
    out = set()
    for k, node in enumerate(nodes):
        if size[k] and id(node) in digests:
            article = size[k] >= LONG and 2 * size[k] > size[0] or within[k] and node.tag in LISTS and id(root) not in tops
            out.add((digests[id(node)], ((held[0] - held[k]) & ((1 << 64) - 1)) - (1 << 63), article))
    return out


def subtree_rows(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, page (hash of its html), subtree, around, article: one row per distinct container subtree of each page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                found = [(k, *f) for k, text in enumerate(part.column(2).to_pylist()) for f in subtrees(parse(text))]
                at, subtree, around, article = zip(*found, strict=True) if found else ((), (), (), ())
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(subtree, pa.int64()), pa.array(around, pa.int64()), pa.array(article, pa.bool_())],
                                                 names=["host", "page", "subtree", "around", "article"])

    work = _texts(pages, html, host_of(url).alias("host")).select("host", F.xxhash64("__html").alias("page"), "__html")
    return work.mapInArrow(rows, "host string, page long, subtree long, around long, article boolean")


def templates(rows: DataFrame, pages_per_host: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, subtree of the template; counted map-side first, so one host may hold any share of the pages."""
    texts = rows.groupBy("host", "subtree", "around").agg(F.count("*").alias("n"), F.bool_or("article").alias("article"))
    counted = texts.groupBy("host", "subtree").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.bool_or("article").alias("article"))
    often = counted.where(F.col("n") >= min_pages).join(pages_per_host, "host")
    return often.where(F.when(F.col("article"), F.col("n") >= min_share * F.col("pages")).otherwise(F.col("texts") >= min_pages)).select("host", "subtree")


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html",
            min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``pages`` without its html, with text and n_chars. Pages are known by host and html, so ``id_col`` only passes through."""
    rows = written(subtree_rows(pages, url, html), "page-subtrees")
    per_host = pages.select(host_of(url).alias("host")).groupBy("host").agg(F.count("*").alias("pages"))
    found = templates(rows, per_host, min_pages, min_share)
    # a page gets its own part of the template, as a host's grows with its pages
    per_page = rows.join(found, ["host", "subtree"]).groupBy("host", "page").agg(F.sort_array(F.collect_set("subtree")).alias("__drop"))
    per_page = per_page.withColumnsRenamed({"host": "__host", "page": "__page"})
    passed = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    work = _texts(pages, html, *passed, host_of(url).alias("__host")).withColumn("__page", F.xxhash64("__html"))
    work = work.join(per_page, ["__host", "__page"], "left").select("__html", "__drop", *passed)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                out = [main_text(parse(t), set(d or ())) for t, d in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[*passed, "text", "n_chars"])

    schema = T.StructType([pages.schema[c] for c in passed] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return work.mapInArrow(texts, schema)

