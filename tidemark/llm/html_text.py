"""Main text of web pages by tree scoring.

A page is read once into a small tree of its elements (end tags may be missing, as HTML allows) and runs of text, a
run being what no block boundary divides. Chrome goes by its element, role, class or id. Every run left passes
points for its length and commas to its ancestors, less with every level; an element's points are discounted by the
share of its text that lies in links. The best container is kept, widened to the article around it, and those
siblings that look like parts of the same text.

Edge cases: a null, empty or textless page has the empty text; a page cut anywhere is read as far as it goes; rows that
repeat are read one by one; other columns stay, but for ``text`` and ``n_chars``, which the result's own replace.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Element names of HTML and the words that pages use for their chrome.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head script style title textarea xmp iframe noembed noframes noscript template svg canvas object audio video button input select dialog nav aside footer menu search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Runs in these belong to the element around them; in any other block they are its own.
LEAVES = HEADINGS | frozenset("p li pre blockquote dd dt figcaption caption td th summary address".split())
#: A start tag of the first closes an open element of the second, up to the third.
CLOSES = {
    "li": ("li", "ul ol menu dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tr td th thead tbody tfoot", "table"), "tfoot": ("tr td th thead tbody tfoot", "table"), "option": ("option", "select"), "optgroup": ("option optgroup", "select"),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
CLOSES_P = BLOCKS - frozenset("body head html tbody td tfoot th thead tr caption legend option optgroup select".split())
SCOPE = frozenset("html table td th caption button object template".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promoted promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager "
    "masthead topbar toolbar header footer colophon sidebar rail widget widgets cookie cookies consent gdpr notice notices disclaimer popup modal overlay toast newsletter subscribe subscription signup "
    "login paywall comment comments commentlist respond discussion disqus replies share sharing social related recommended recommendations outbrain taboola teaser hidden search".split()
)
#: The word before one of these names what a wrapper has or lacks, not what it is.
ABOUT = frozenset("with has no without is".split())
TEXTUAL = frozenset("article articlebody content post entry story text body main".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\t\n\f\r />]*+)((?:[^>"'=]++|=[\t\n\f\r ]*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_ATTR = re.compile(r"""(?<![^\t\n\f\r /"'])(class|id|role|itemprop|style|aria-hidden|hidden)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|([^\t\n\f\r >"']+)))?(?![^\t\n\f\r =/>])""", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NEVER_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Points of a run: one, one for every comma, one for every LENGTH characters up to MOST; LEVELS ancestors get some.
LENGTH, MOST, LEVELS = 100, 3.0, 6
#: Added to an element that says it holds the text, once it has any points.
SAYS_ARTICLE, SAYS_CONTENT = 25.0, 10.0
#: A sibling is kept at this share of the best container's points; a list of links is a menu at this share of link text.
SIBLING, MENU = 0.2, 0.8


class _Page:
    """Elements in page order, a parent always before its children: parallel lists, the root at 0."""

    def __init__(self) -> None:
        self.tag, self.parent, self.words, self.role, self.shown = ["#root"], [-1], [()], [""], [True]
        self.runs: list[tuple[int, str, int]] = []  # (element, text, characters in links)

    def add(self, tag: str, parent: int, attrs: str) -> int:
        words, role, shown = (), "", True
        if attrs:
            for m in _ATTR.finditer(attrs):
                name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
                if name in ("class", "id", "itemprop"):
                    words += tuple(w.lower() for w in _WORDS.findall(value))
                elif name == "role":
                    role = value.strip().lower()
                elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _NEVER_SHOWN.search(value)):
                    shown = False
        self.tag.append(tag), self.parent.append(parent), self.words.append(words), self.role.append(role), self.shown.append(shown)
        return len(self.tag) - 1


def _tree(html: str) -> _Page:
    page, at, size = _Page(), 0, len(html)
    stack, names, links = [0], {"#root": 1}, 0
    parts: list[str] = []
    linked: list[str] = []

    def write(text: str) -> None:
        if text:
            text = unescape(text)
            parts.append(text)
            if links:
                linked.append(text)

    def flush() -> None:
        """Ends the run; it is the innermost open block's."""
        if parts:
            block = len(stack) - 1
            while block and page.tag[stack[block]] not in BLOCKS and page.tag[stack[block]] not in DROPPED:
                block -= 1
            text = " ".join("".join(parts).split())
            if text:
                page.runs.append((stack[block], text, len(" ".join("".join(linked).split()))))
            parts.clear()
            linked.clear()

    def pop_to(depth: int) -> None:
        """Closes all that lies at this depth of the stack and above; a block among it ends the run."""
        nonlocal links
        if any(page.tag[e] in BLOCKS for e in stack[depth:]):
            flush()
        for e in stack[depth:]:
            names[page.tag[e]] -= 1
            links -= page.tag[e] == "a"
        del stack[depth:]

    def find(wanted: frozenset | str, until: frozenset) -> int:
        """Depth of the innermost such open element, 0 where ``until`` comes first."""
        if isinstance(wanted, str):
            wanted = frozenset((wanted,))
        if not any(names.get(w) for w in wanted):
            return 0
        for depth in range(len(stack) - 1, 0, -1):
            tag = page.tag[stack[depth]]
            if tag in wanted:
                return depth
            if tag in until:
                return 0
        return 0

    while at < size:
        open_at = html.find("<", at)
        if open_at < 0:
            write(html[at:])
            break
        write(html[at:open_at])
        after = html[open_at + 1 : open_at + 2]
        if html.startswith("<!--", open_at):
            end = html.find("-->", open_at + 2)
            at = size if end < 0 else end + 3
            continue
        if after in ("!", "?") or (after == "/" and not html[open_at + 2 : open_at + 3].isalpha()):
            end = html.find(">", open_at)
            at = size if end < 0 else end + 1
            continue
        if not (after == "/" or (after.isascii() and after.isalpha())):
            write("<")
            at = open_at + 1
            continue
        m = _TAG.match(html, open_at)
        if not m:  # the page ends within a tag
            break
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag in BLOCKS or tag in DROPPED:
                depth = find(tag, frozenset() if tag in ("body", "html", "table") else SCOPE - {tag})
            else:
                depth = find(tag, BLOCKS)
            if depth:
                pop_to(depth)
            elif tag in BLOCKS:
                flush()
            continue
        if tag == "br":
            write(" ")
            continue
        if tag in CLOSES_P and (depth := find("p", SCOPE)):
            pop_to(depth)
        if tag in CLOSES and (depth := find(*CLOSES[tag])):
            pop_to(depth)
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I).search(html, at)
            if not end:
                break
            close = html.find(">", end.end())
            at = size if close < 0 else close + 1
            continue
        if m[3].endswith("/") and tag in ("svg", "path", "use"):
            continue
        stack.append(page.add(tag, stack[-1], m[3]))
        names[tag] = names.get(tag, 0) + 1
        links += tag == "a"
    flush()
    return page


def _named_chrome(words: tuple[str, ...]) -> bool:
    return any(w in CHROME and not (i and words[i - 1] in ABOUT) for i, w in enumerate(words))


def _summed(parent: list[int], own: list[float]) -> list[float]:
    """Sums over subtrees; children come after their parents."""
    out = list(own)
    for e in range(len(out) - 1, 0, -1):
        out[parent[e]] += out[e]
    return out


def main_text(html: str | None) -> str:
    """The page's main text: its blocks joined by two line feeds."""
    if not html:
        return ""
    page = _tree(html)
    n, tag, parent = len(page.tag), page.tag, page.parent

    text, own_links, anchors = [0.0] * n, [0.0] * n, [0.0] * n
    for e, t, k in page.runs:
        text[e] += len(t)
        own_links[e] += k
    bodies = [float(tag[e] in ("article", "main") or page.role[e] == "main") for e in range(n)]
    for e in range(n):
        anchors[e] = float(tag[e] == "a")
    text, own_links, anchors, holds = (_summed(parent, x) for x in (text, own_links, anchors, bodies))

    # what goes: chrome by element, role and name, hidden parts, menus by their links; heading: only headings stay
    gone, heading, inside = [False] * n, [False] * n, [False] * n
    for e in range(1, n):
        p = parent[e]
        inside[e] = inside[p] or bool(bodies[e])
        t = tag[e]
        whole = holds[e] > bodies[e] or t in ("html", "body") or (t == "form" and 2 * text[e] > text[0])
        header = t in ("header", "hgroup") or (_named_chrome(page.words[e]) and "header" in page.words[e])
        if header and inside[p]:
            heading[e] = True
        elif not page.shown[e] or t in DROPPED:
            gone[e] = True
        elif not whole and not bodies[e] and (t == "form" or header or page.role[e] in ROLES or _named_chrome(page.words[e])):
            gone[e] = True
        elif bodies[e] and holds[e] == 1 and not whole and _named_chrome(page.words[e]) and not set(page.words[e]) & TEXTUAL:
            gone[e] = True
        elif t in ("ul", "ol", "dl", "div", "table", "section") and anchors[e] >= 3 and own_links[e] >= MENU * text[e] and not whole:
            gone[e] = True
        gone[e] = gone[e] or gone[p]
        heading[e] = heading[e] or heading[p]
    kept = [(e, t, k) for e, t, k in page.runs if not gone[e] and not (heading[e] and not _in_heading(page, e))]
    if not kept:
        return ""

    # points
    text, own_links, points = [0.0] * n, [0.0] * n, [0.0] * n
    for e, t, k in kept:
        text[e] += len(t)
        own_links[e] += k
        worth = 1.0 + t.count(",") + min(len(t) / LENGTH, MOST)
        up = parent[e] if tag[e] in LEAVES else e
        for level in range(LEVELS):
            if up <= 0:
                break
            points[up] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up = parent[up]
    text, own_links = _summed(parent, text), _summed(parent, own_links)
    score = [0.0] * n
    for e in range(1, n):
        if points[e] and text[e]:
            says = SAYS_ARTICLE if bodies[e] or "articlebody" in "".join(page.words[e]) else SAYS_CONTENT if set(page.words[e]) & TEXTUAL and tag[e] not in LEAVES and tag[e] != "body" else 0.0
            score[e] = (points[e] + says) * (1 - own_links[e] / text[e])
    best = max(range(n), key=lambda e: (score[e], -e))

    # the article around it, or else the main part
    around, e = {}, best
    while e > 0:
        around["article" if tag[e] == "article" else "main" if bodies[e] else ""] = e
        e = parent[e]
    best = around.get("article", around.get("main", best))
    chosen = {best}
    if tag[best] not in ("body", "html", "main", "#root"):
        least = SIBLING * score[best]
        for e in range(1, n):
            if parent[e] != parent[best] or e == best or gone[e] or not text[e]:
                continue
            density = own_links[e] / text[e]
            alike = score[e] >= least > 0 or (page.words[e] and page.words[e] == page.words[best])
            if density < 0.5 and (alike or tag[e] in LEAVES and tag[e] not in ("td", "th") and tag[best] != "article"):
                chosen.add(e)
    member = [False] * n
    for e in range(n):
        member[e] = e in chosen or (e > 0 and member[parent[e]])
    return "\n\n".join(t for e, t, _ in kept if member[e] or (e == parent[best] and tag[best] != "article"))


def _in_heading(page: _Page, e: int) -> bool:
    while e > 0:
        if page.tag[e] in HEADINGS:
            return True
        e = page.parent[e]
    return False


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without ``column``, with text (its main text, empty if none) and n_chars (code points of it)."""
    names = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    rows = pages.select(*[f"`{c}`" for c in names], f"`{column}`")
    fields = [f for f in rows.schema.fields if f.name != column]

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [main_text(h.as_py()) for h in part.column(len(names))]
            more = [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *more], names=[*names, "text", "n_chars"])

    return rows.mapInArrow(read, StructType([*fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
