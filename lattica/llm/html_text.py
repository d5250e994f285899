"""Main text of web pages by composite text density.

Every DOM node gets its link-adjusted characters per tag; a node's density sum is that of its children. The node of
the largest sum is where the article's blocks hang. The threshold is the least density on the path from it up to the
body, itself included; siblings that reach it belong to the same article, so the subtree grows to the lowest ancestor
that holds them, and to an article or main element around it. Above that only what is not mostly links is added: siblings
that reach the threshold and, where no such element stands around, headings and their wrappers, paragraphs, and text that
stands there by itself. A page without any node of positive density, such as one of links alone, has no main text.

Only structure is taken out before anything is counted: scripts and the like, hidden elements, and navigation, footers,
asides and forms by element or role. Words of a class or id never take out the densest subtree or what it hangs in. An
element that they hint at is left out beside it; within it the element stays if it holds blocks of its own that are half as
dense as the subtree, unless it holds readers' replies.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg canvas object select button xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "body", "html", "head", "legend"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
HOMES = frozenset("article main section".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# What marks boilerplate.
JUNK_TAGS = frozenset("head nav footer aside form menu dialog search".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
JUNK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidenav nav navbar navigation "
    "menu breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies respond cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe signup share sharing social related recommended widget pagination pager toolbar".split()
)
#: Words for readers' replies, which are not the article however long they are.
REPLY_WORDS = frozenset("comment comments disqus reply replies respond".split())
NONE: frozenset[str] = frozenset()
_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _is_junk(tag: str, attributes: str) -> tuple[bool, frozenset[str]]:
    """Whether an element is boilerplate for sure, and the words of its class and id that hint at it."""
    words: frozenset[str] = frozenset()
    if tag in JUNK_TAGS:
        return True, words
    if not attributes or tag in ("body", "html", "article", "main"):
        return False, words
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, words
        if name == "role" and value.lower() in JUNK_ROLES:
            return True, words
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True, words
        if name in ("class", "id"):
            words |= JUNK_WORDS & {w.lower() for w in _WORD.findall(value)}
    return False, words


class _Dom:
    """Nodes in document order; ``items`` is the text and block breaks in page order as (node, string)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.junk, self.items = [-1], ["#"], [False], []
        self.words: dict[int, frozenset[str]] = {}
        stack, at = [0], 0

        def text(s: str) -> None:
            if s:
                self.items.append((stack[-1], html.unescape(s) if "&" in s else s))

        def pop_to(k: int) -> None:
            for n in stack[k:]:
                if self.tag[n] in BLOCKS:
                    self.items.append((self.parent[n], None))
            del stack[k:]

        while True:
            m = _TAG.search(source, at)
            if m is None:
                text(source[at:])
                break
            text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    open_ = self.tag[stack[k]]
                    if open_ == tag:
                        pop_to(k)
                        break
                    if tag not in BLOCKS and open_ in BLOCKS:
                        break
                    if tag == "p" and open_ in ("article", "div", "section", "main", "body", "td", "li"):
                        break
                if tag in BLOCKS:
                    self.items.append((stack[-1], None))
                continue
            if tag in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == "p":
                        pop_to(k)
                        break
                    if self.tag[stack[k]] in BLOCKS:
                        break
            if tag in SAME:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] in SCOPE[tag]:
                        break
                    if self.tag[stack[k]] in SAME[tag]:
                        pop_to(k)
                        break
            if tag in ("body", "main", "article") and self.tag[stack[-1]] == "head":
                pop_to(len(stack) - 1)
            node = len(self.tag)
            if tag in BLOCKS or tag == "br":
                self.items.append((stack[-1], None))
            if tag == "br" or tag == "html":
                if tag == "html" and len(stack) == 1:
                    self._add(stack[-1], tag, False)
                    stack.append(node)
                continue
            junk, words = _is_junk(tag, attributes)
            junk |= tag == "header" and not any(self.tag[k] in HOMES for k in stack)  # of the page, not of an article
            self._add(stack[-1], tag, tag in RAW or junk)
            if words and not self.junk[node]:
                self.words[node] = words
            if tag in RAW and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif tag not in VOID:
                stack.append(node)

    def _add(self, parent: int, tag: str, junk: bool) -> None:
        self.parent.append(parent)
        self.tag.append(tag)
        self.junk.append(junk or self.junk[parent])


def below(parent: list[int], node: int, top: int) -> bool:
    while node > top:  # children come after their parents
        node = parent[node]
    return node == top


def main_text(source: str | None) -> str:
    """The article's text: character references decoded, white space collapsed, blocks joined by one space."""
    if not source:
        return ""
    dom = _Dom(source)
    n, parent, tag, junk, words = len(dom.tag), dom.parent, dom.tag, dom.junk, dom.words
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[parent[i]] or tag[i] == "a"
    for i, s in dom.items:
        if s is not None and not junk[i]:
            c = sum(map(len, s.split()))
            chars[i] += c
            if linked[i]:
                link_chars[i] += c
    for i in range(n - 1, 0, -1):  # children come after their parents
        if not junk[i]:
            p = parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tag[i] == "a")
    if not chars[0]:
        return ""
    share = link_chars[0] / chars[0]
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        if chars[i] and not junk[i]:
            c, lc, t, lt = chars[i], link_chars[i] or 1, tags[i] or 1, link_tags[i] or 1
            base = math.log(c / ((c - link_chars[i]) or 1) * link_chars[i] + share * c + math.e)
            density[i] = max(0.0, c / t * math.log(c / lc * t / lt) / base) if link_chars[i] < c else 0.0
            if i and i not in words:
                total[parent[i]] += density[i]
    reply = [False] * n
    for i in range(1, n):
        reply[i] = reply[parent[i]] or bool(words.get(i, NONE) & REPLY_WORDS)
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    candidates = [i for i in range(n) if density[i] > 0]
    if not candidates:
        return ""
    best = max([i for i in candidates if not reply[i]] or candidates, key=lambda i: (total[i], chars[i], -i))
    path = [best]
    while path[-1] not in (0, body) and tag[path[-1]] != "html":
        path.append(parent[path[-1]])
    threshold = min(density[i] for i in path)
    for i in range(1, n):  # what class words hint at, now that densities are known
        hint = i in words and i not in path and (reply[i] or not total[i] or 2 * density[i] < density[best] or not below(parent, i, best))
        junk[i] |= hint or junk[parent[i]]
    children: dict[int, list[int]] = {}
    for i in range(1, n):
        if not junk[i] and chars[i]:
            children.setdefault(parent[i], []).append(i)
    outer = [x for x in path if tag[x] == "article"] or [x for x in path if tag[x] == "main"]
    at = path.index(outer[-1]) if outer else 0
    for k in range(at + 1, len(path) - 1):
        if any(x != path[k - 1] and density[x] >= threshold for x in children[path[k]]):
            at = k
    above, chosen = {*path[at + 1 :]}, {path[at]}
    title = [t == "h1" and not j for t, j in zip(tag, junk, strict=True)]
    for i in range(n - 1, 0, -1):
        title[parent[i]] |= title[i]
    for upper in above:
        blocks = [x for x in children[upper] if tag[x] in BLOCKS]
        rest, links = (a[upper] - sum(a[x] for x in blocks) for a in (chars, link_chars))
        if 2 * links < rest and not outer:
            chosen |= {upper, *children[upper]} - {*blocks} - (above - {upper})
        chosen |= {x for x in blocks if x not in above and (tag[x] in TITLES or (2 * link_chars[x] < chars[x] and (tag[x] == "p" or title[x] or density[x] >= threshold))) and (not outer or density[x] >= threshold)}
    keep = [False] * n
    for i in range(n):
        keep[i] = i in chosen or (i > 0 and parent[i] not in above and keep[parent[i]] and not junk[i])
    return " ".join("".join(s if s is not None else " " for i, s in dom.items if keep[i] or (s is None and i in above)).split())


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row. Null or empty html, and pages without text, give ''."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(source).cast("string").alias("html"))

    def run(batches):
        for b in slices(batches, "html"):
            text = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
