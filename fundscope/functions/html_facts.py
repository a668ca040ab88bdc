"""Per-page HTML facts (the E-0 helper): a small tree built with the stdlib ``html.parser``.

The tree follows the rules of a lenient DOM builder over ``html.parser`` events: void elements never
nest, an end tag closes the most recent open element of that name (and is ignored when there is
none), nothing is closed implicitly. The character data between two tags or comments is one text node; if
it is all white space, it counts as one newline (if it holds one) or one space. Text anywhere inside
script/style/template/rt/rp and comments are not page text; the doctype is not text. Entities are decoded by
the tokenizer.

Pages of plain markup (lower-case tags, quoted attributes without references, text without '<' before a letter or mark) are read by one
regular expression that gives the same tree in a fraction of the time; any other page goes to ``html.parser`` whole.

Only the facts the Spark operators need are emitted; everything else (cleaning, selection,
regexes, URL resolution) is done afterwards by Catalyst expressions.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param",
        "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer"}
NON_TEXT_PARENTS = {"script", "style", "template", "rt", "rp"}
BLANKS = " \t\n\f\r"
ELIGIBILITY = re.compile(r"eligibility", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "hidden", "_classes")

    def __init__(self, tag, attrs, parent):
        self.tag = tag
        self.attrs = attrs
        self.children = []
        self.parent = parent
        self.hidden = tag in NON_TEXT_PARENTS or (parent is not None and parent.hidden)
        self._classes = None

    @property
    def classes(self):
        if self._classes is None:
            self._classes = (self.attrs.get("class") or "").split()
        return self._classes


class Text:
    __slots__ = ("value", "kind", "parent")

    def __init__(self, value, kind, parent):
        self.value = value
        self.kind = kind  # 'text', 'nontext' (inside script, style, template), 'comment'
        self.parent = parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {}, None)
        self.cur = self.root
        self.pending = []

    def updatepos(self, i, j):
        """Line numbers are not used."""
        return j

    def flush(self):
        """Ends the text node: the tokenizer gives its data in pieces, cut at a lone '<' or '&'."""
        if self.pending:
            data = "".join(self.pending)
            self.pending.clear()
            if not data.strip(BLANKS):
                data = "\n" if "\n" in data else " "
            self.cur.children.append(Text(data, "nontext" if self.cur.hidden else "text", self.cur))

    def _open(self, tag, attrs):
        self.flush()
        node = Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.cur)
        self.cur.children.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        node = self._open(tag, attrs)
        if tag not in VOID:
            self.cur = node

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs)

    def handle_endtag(self, tag):
        self.flush()
        n = self.cur
        while n is not None and n is not self.root and n.tag != tag:
            n = n.parent
        if n is not None and n is not self.root:
            self.cur = n.parent

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self.flush()
        self.cur.children.append(Text(data, "comment", self.cur))

    def handle_decl(self, decl):
        self.flush()

    def handle_pi(self, data):
        self.flush()

    def unknown_decl(self, data):
        self.flush()
        if data[:6].upper() == "CDATA[":
            self.pending.append(data[6:])
            self.flush()


#: A text (in which a space, digit or '=' follows a '<'), then one piece of plain markup: end tag, start tag and its attributes, comment, doctype, or nothing.
_PLAIN = re.compile(r"""([^<]*(?:<(?=[\ 0-9=])[^<]*)*)(?:</([a-z][a-z0-9]*)>|<([a-z][a-z0-9]*)((?:\ [a-z][a-z-]*="[^"&<>]*")*)>|<!--([^<>-]+)-->|<!(?:DOCTYPE|doctype)\ ([a-z]+)>|\Z)""", re.VERBOSE)
_ATTRIBUTE = re.compile(r' ([a-z][a-z-]*)="([^"]*)"')
#: Elements whose content html.parser may take literally (which ones is up to its version): plain only if they hold text alone.
_LITERAL = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}


def _parse_plain(html: str):
    """The tree of a page of plain markup, or None if some of it is not."""
    root = cur = Node("[document]", {}, None)
    match, at, size, literal = _PLAIN.match, 0, len(html), None
    pending = ""  # a text node's data: a doctype, tag or comment ends it
    while at < size:
        m = match(html, at)
        if m is None:
            return None
        data, end, start, attrs, comment, _ = m.groups()
        if literal is not None and end != literal:
            return None
        if data:
            if literal is None or literal == "title":
                pending = "<".join(map(unescape, data.split("<"))) if "&" in data else data
            elif "&" in data and literal != "script" and literal != "style":
                return None
            else:
                pending = data
            if not pending.strip(BLANKS):
                pending = "\n" if "\n" in pending else " "
            cur.children.append(Text(pending, "nontext" if cur.hidden else "text", cur))
        literal = None
        if start is not None:
            node = Node(start, dict(_ATTRIBUTE.findall(attrs)) if attrs else {}, cur)
            cur.children.append(node)
            if start not in VOID:
                cur = node
            if start in _LITERAL:
                literal = start
        elif end is not None:
            n = cur
            while n is not root and n.tag != end:
                n = n.parent
            if n is not root:
                cur = n.parent
        elif comment is not None:
            cur.children.append(Text(comment, "comment", cur))
        at = m.end()
    return None if literal is not None else root


def parse(html: str) -> Node:
    root = _parse_plain(html or "")
    return parse_any(html) if root is None else root


def parse_any(html: str) -> Node:
    """The tree by ``html.parser``, whatever the markup."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    b.flush()
    return b.root


def iter_nodes(node):
    """Elements in document order (pre-order), excluding ``node`` itself."""
    stack = list(reversed(node.children))
    while stack:
        n = stack.pop()
        if isinstance(n, Node):
            yield n
            stack.extend(reversed(n.children))


def strings(node):
    """Page-text strings under ``node`` in document order."""
    stack = list(reversed(node.children))
    while stack:
        n = stack.pop()
        if isinstance(n, Node):
            stack.extend(reversed(n.children))
        elif n.kind == "text":
            yield n.value


def get_text(node, sep: str = "", strip: bool = False) -> str:
    if strip:
        return sep.join(s.strip() for s in strings(node) if s.strip())
    return sep.join(strings(node))


def sole_string(node):
    """The single string of an element (descending through single-child elements), else None."""
    while True:
        if len(node.children) != 1:
            return None
        c = node.children[0]
        if isinstance(c, Text):
            return c.value
        node = c


def _simple_match(n: Node, sel: str) -> bool:
    tag, _, cls = sel.partition(".")
    if tag and n.tag != tag:
        return False
    return not cls or cls in n.classes


def _under(n: Node, ancestors: list, root: Node) -> bool:
    """Whether the element lies in a chain of ancestors ('A B' of 'A B C')."""
    anc, i = n.parent, len(ancestors) - 1
    while i >= 0 and anc is not None:
        if anc is not root and _simple_match(anc, ancestors[i]):
            i -= 1
        anc = anc.parent
    return i < 0


def select_one(root: Node, selector: str):
    """First element (document order) matching 'tag', '.class', 'tag.class' or a descendant chain 'A B'."""
    parts = selector.split()
    return next((n for n in iter_nodes(root) if _simple_match(n, parts[-1]) and _under(n, parts[:-1], root)), None)


def select_firsts(root: Node, elements: list, selectors) -> dict:
    """selector -> ``select_one`` of the selectors that hit, by the elements of each tag and class."""
    named = {}
    for n in elements:
        named.setdefault(n.tag, []).append(n)
        if "class" in n.attrs:
            for cls in dict.fromkeys(n.classes):
                named.setdefault("." + cls, []).append(n)
    out = {}
    for s in selectors:
        parts = s.split()
        tag, dot, cls = parts[-1].partition(".")
        for n in named.get("." + cls if dot else tag, ()):
            if (not tag or n.tag == tag) and _under(n, parts[:-1], root):
                out[s] = n
                break
    return out


def _find(node: Node, tag: str, cls: str | None = None):
    for n in iter_nodes(node):
        if n.tag == tag and (cls is None or cls in n.classes):
            return n
    return None


ALL_FACTS = ("text_raw", "text", "text_lines", "selectors", "first_ps", "anchors", "elig_items", "base_href",
             "teaser_cards", "dated_cards", "cards")


def page_facts(html: str, selectors, fields=ALL_FACTS) -> dict:
    """The requested facts of one page; see ``operators.pages.FACTS_SCHEMA`` for the field list."""
    root = parse(html)
    elements = list(iter_nodes(root))
    out = {}
    if "text_raw" in fields:
        out["text_raw"] = get_text(root)
    if "text" in fields:
        out["text"] = get_text(root, strip=True)
    if "text_lines" in fields:
        out["text_lines"] = get_text(root, sep="\n", strip=True)
    if "selectors" in fields:
        out["selectors"] = {s: get_text(n) for s, n in select_firsts(root, elements, selectors).items()}
    if "first_ps" in fields:
        out["first_ps"] = [get_text(n) for n in elements if n.tag == "p"][:3]
    if "anchors" in fields:
        anchors, pos = [], 0
        for n in elements:
            if n.tag == "a":
                href = n.attrs.get("href")
                pos += href is not None
                anchors.append({"pos": pos if href is not None else None, "href": href, "text": get_text(n), "sole": sole_string(n)})
        out["anchors"] = anchors
    if "elig_items" in fields:
        out["elig_items"] = _eligibility_items(elements)
    if "base_href" in fields:
        out["base_href"] = next((n.attrs["href"] for n in elements if n.tag == "base" and "href" in n.attrs), None)
    if "teaser_cards" in fields:
        out["teaser_cards"] = _teasers(elements)
    if "dated_cards" in fields:
        out["dated_cards"] = _dated(elements)
    if "cards" in fields:
        none = dict.fromkeys(("meta", "href", "calendar"))
        out["cards"] = [none | {"kind": "teaser", "title": c["title"], "body": c["summary"], "meta": c["meta"]} for c in _teasers(elements)]
        out["cards"] += [{"kind": "dated", "title": c["title"], "body": c["intro"], "meta": c["subheading"], "href": c["href"], "calendar": c["calendar"]} for c in _dated(elements)]
    return out


def _eligibility_items(elements):
    elig = None
    for n in elements:
        if n.tag in ("div", "section"):
            s = sole_string(n)
            if s is not None and ELIGIBILITY.search(s):
                elig = n
                break
    items = []
    if elig is not None and elig.parent is not None:
        sibs = elig.parent.children
        for sib in sibs[sibs.index(elig) + 1:]:
            if isinstance(sib, Node) and sib.tag in ("ul", "ol"):
                items.extend(get_text(li) for li in iter_nodes(sib) if li.tag == "li")
    return items


def _teasers(elements):
    out = []
    for n in elements:
        if n.tag == "div" and "teaser-grant" in n.classes:
            t, s, m = _find(n, "h3", "teaser-grant__title"), _find(n, "p", "teaser-grant__summary"), \
                _find(n, "p", "teaser-grant__meta")
            out.append({"title": get_text(t).strip() if t else "", "summary": get_text(s).strip() if s else "",
                        "meta": get_text(m).strip() if m else ""})
    return out


DATED_CARD_CLASSES = ("tool-card date-card fund-card bg-area", "tool-card date-card fund-card bg-area bg-dark-blue")


def _dated(elements):
    out = []
    for n in elements:
        if n.tag == "div" and " ".join(n.classes) in DATED_CARD_CLASSES:
            t, i = _find(n, "h3", "tool-card__title"), _find(n, "div", "tool-card__intro")
            a = _find(n, "a", "btn-secondary")
            c, h = _find(n, "div", "select-county-box__calendar-top"), _find(n, "div", "tool-card__subheading")
            out.append({"title": get_text(t, strip=True) if t else "", "intro": get_text(i, strip=True) if i else "",
                        "href": (a.attrs.get("href") if a is not None else None),
                        "calendar": get_text(c, strip=True) if c else "",
                        "subheading": get_text(h, strip=True) if h else ""})
    return out
