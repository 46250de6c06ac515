"""Operator 1: main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block element. The sums of the lines' effective lengths over
a sliding window of lines rise above a threshold at the surge points of the text and fall under it at its dive points;
what lies in between is the text. Effective is a line's text but for what is linked; tags weigh it:

- lines in menus, headers, footers, sidebars, notices, adverts, forms and comment sections, told by the names,
  roles, classes and ids of the elements around them, weigh nothing and never belong to the text;
- a form, or an element whose class, id or role may name boilerplate but need not, is one of these only if it holds less than
  most of the text on the page that is not linked: a page that stands in one form as a whole, or in a ``menu-page``, keeps its article.
  What is hidden, ``nav``, ``aside`` and ``footer`` elements, comments and sure names (``sidebar``, ``cookie``) stay out whatever they hold;
- where ``article`` or ``main`` elements hold the better part of the other text, lines outside of the large ones
  weigh nothing and do not belong to it; otherwise these elements (teasers) weigh as little;
- headings, paragraphs, list items and the like, and every line in a large ``article`` or ``main``, get an allowance, so
  that a short one among them counts.

A line with effective length belongs to the text where the window that starts or the one that ends with it
reaches the threshold; one without (a line of links, a short line without a text element) only where both do, that is, amid text.

Null or empty html, and pages with nothing but boilerplate, give an empty text. An empty table gives an empty result. Repeated rows give
repeated results. Quoted attributes may hold markup; a quote that is never closed quotes nothing. The work grows with the page's length, however deeply elements nest
and whatever is left unclosed. Markup cut off at the end of a page is dropped; a cut-off character reference stays
as it is. Buttons, drawings and the like that are never closed hide nothing. Columns other than the key
columns and html are ignored, whatever they are called.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

WINDOW = 3
#: The least window sum of a text; on a page whose sums all stay below it, their maximum.
SURGE = 60
#: What a text element adds to its line's length, and a large article; the least length of a line without either.
ELEMENT, SCOPE, BARE = 20, 60, 20
#: The share of the largest article's text that another one needs to count as text.
LARGE = 0.25
#: The share of the page's text that makes a possible boilerplate element the page itself: with a first heading or an article in it, and without; and what a form
#: needs for each field that is shown.
MOST, NEARLY_ALL, EACH_FIELD = 0.5, 0.8, 60

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    # a quote opens a value only behind "=", as in a browser
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^"'=>]++|=\s*+(?:"[^"]*"|'[^']*')?|["'])*+)>"""
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Elements without text of their own: those whose end is looked for by its name alone, to the page's end, and those that hide their content only if they are closed.
RAW = frozenset("script style noscript iframe title textarea".split())
CLOSED = frozenset("template svg math head select button object canvas audio video".split())
CONTAINERS = frozenset("html body div section article main nav aside header footer form ul ol dl table menu dialog fieldset details figure blockquote".split())
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd caption pre figcaption blockquote td th".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr caption thead tbody tfoot pre address hr figcaption summary legend center option".split())
SPACES = frozenset("br td th img input".split())
SURE_TAGS = frozenset("nav aside footer menu dialog".split())
LIKELY_TAGS = frozenset("form fieldset".split())
FIELDS = frozenset("input select textarea".split())
SURE_ROLES = frozenset("navigation banner contentinfo complementary dialog alertdialog alert menu menubar toolbar".split())
LIKELY_ROLES = frozenset("search form".split())
NOT, LIKELY, SURE = 0, 1, 2
#: Words of a class or id that name boilerplate whatever stands beside them.
SURE_WORDS = frozenset(
    "advert adverts advertisement advertisements advertising adsbygoogle sidebar sidebars nav navbar navigation breadcrumb breadcrumbs footer cookie cookies gdpr newsletter popup modal "
    "comment comments disqus replies pagination pager masthead topbar menubar sponsored".split()
)
#: Words that name it if all words beside them are of this kind or neutral.
LIKELY_WORDS = frozenset(
    "ad ads adv sponsor promo promos promotion banner rail menu consent notice notices overlay subscribe subscription signup signin login register social share sharing related recommended "
    "recommendations respond reply widget widgets toolbar copyright disclaimer skip search teaser teasers popular trending".split()
)
NEUTRAL_WORDS = frozenset(
    "site page main more also read next most top bottom left right upper lower inner outer side box bar block blocks list lists item items section area zone container wrapper wrap holder panel pane content group row col column unit slot space "
    "link links button buttons btn icon icons form media text user reader google dfp gpt js id sticky fixed inline small large big mini the and to of in on for post posts article articles story stories news label title head heading".split()
)
HEADER_WORDS = frozenset({"header"})
HAVING = frozenset("has with no without".split())
COMMENT_WORDS = frozenset({"comment", "comments", "disqus", "replies"})


class Line(NamedTuple):
    text: str
    boilerplate: bool
    #: Number of the outermost article or main around it, 0 for none.
    scope: int
    #: Characters in links, and whether it is the text of a text element.
    linked: int
    element: bool


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


def names_boilerplate(names: str, in_scope: bool) -> tuple[int, bool]:
    """Whether classes and ids name boilerplate, and whether a comment section."""
    found, words_of = NOT, set()
    for name in names.split():
        words = [w.lower() for w in WORDS.findall(name)]
        if not words or HAVING.intersection(words[:1]):
            continue
        words_of.update(words)
        if SURE_WORDS.intersection(words) or not in_scope and HEADER_WORDS.intersection(words):
            found = SURE
        elif LIKELY_WORDS.intersection(words) and all(w in LIKELY_WORDS or w in NEUTRAL_WORDS or w.isdigit() or len(w) < 2 for w in words):
            found = max(found, LIKELY)
    return found, found > NOT and bool(words_of & COMMENT_WORDS)


def boilerplate(tag: str, attrs: str, in_scope: bool) -> int:
    """Whether a container holds no main text, by its name, role, class and id: NOT, LIKELY (unless it holds the page's text) or SURE."""
    if tag in SURE_TAGS or tag == "header" and not in_scope:
        return SURE
    own = LIKELY if tag in LIKELY_TAGS else NOT
    if not attrs.strip() or tag in ("html", "body"):
        return own
    a = attributes(attrs)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return SURE
    role = a.get("role", "").lower()
    if role in SURE_ROLES:
        return SURE
    found, comments = names_boilerplate(f"{a.get('class', '')} {a.get('id', '')}", in_scope)
    if comments:
        return SURE
    return max(own, LIKELY if role in LIKELY_ROLES else NOT, found if tag not in ("article", "main") else NOT)


class Hidden:
    """Finds where the content of an element without text ends; each end is looked for once."""

    def __init__(self, html: str):
        self.html, self.ends, self.patterns = html, {}, {}

    def next(self, pattern: str, at: int) -> tuple[int, int]:
        """(start, end) of the next match, behind the page if there is none."""
        known = self.ends.get(pattern)
        if known is None or known[0] < at:
            own = self.patterns.setdefault(pattern, re.compile(pattern, re.I))
            m = own.search(self.html, at)
            known = self.ends[pattern] = m.span() if m else (len(self.html) + 1, len(self.html))
        return known

    def end(self, tag: str, at: int) -> int:
        """The place behind the element whose start tag ends at ``at``; ``at`` if it hides nothing."""
        start, end = self.next(rf"</{tag}\s*>", at)
        if tag == "head":
            body = self.next(r"<body\b", at)[0]
            return body if body < start else end if start <= len(self.html) else at
        if tag in CLOSED:
            # one that opens again before it closes was not closed
            return end if start <= len(self.html) and self.next(rf"<{tag}\b", at)[0] > start else at
        return end


class Containers:
    """The containers of a page in order of their start tags; number 0 is the page itself."""

    def __init__(self):
        self.parents, self.tags, self.kinds, self.sure, self.scoped, self.headed, self.fields, self.mass = [0], [""], [NOT], [False], [False], [False], [0], [0]
        self.stack, self.open = [0], defaultdict(list)

    def start(self, tag: str, attrs: str) -> None:
        top = self.stack[-1]
        kind = boilerplate(tag, attrs, self.scoped[top])
        scope = tag in ("article", "main") and kind == NOT and not self.sure[top]
        if scope:
            self.headed[top] = True
        row = (top, tag, kind, self.sure[top] or kind == SURE, self.scoped[top] or scope, False, 0, 0)
        for column, value in zip((self.parents, self.tags, self.kinds, self.sure, self.scoped, self.headed, self.fields, self.mass), row):
            column.append(value)
        self.open[tag].append(len(self.stack))
        self.stack.append(len(self.tags) - 1)

    def end(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for i in reversed(self.stack[(at := self.open[tag][-1]) :]):
            self.open[self.tags[i]].pop()
        del self.stack[at:]

    def judged(self) -> tuple[list[bool], list[int]]:
        """For each container whether it holds no main text, and the number of the outermost article or main around it, 0 for none."""
        n = len(self.tags)
        mass, headed, fields = self.mass.copy(), self.headed.copy(), self.fields.copy()
        for i in range(n - 1, 0, -1):  # those inside come later
            if self.kinds[i] != SURE:
                up = self.parents[i]
                mass[up] += mass[i]
                headed[up] = headed[up] or headed[i]
                fields[up] += fields[i]
        out, scopes, count = [False] * n, [0] * n, 0
        for i in range(1, n):
            up, kind = self.parents[i], self.kinds[i]
            if kind == LIKELY and mass[i] >= (MOST if headed[i] else NEARLY_ALL) * max(1, mass[0]) and mass[i] >= EACH_FIELD * (1 + fields[i]):
                kind = NOT
            out[i] = out[up] or kind != NOT
            scopes[i] = scopes[up]
            if self.tags[i] in ("article", "main") and not out[i] and not scopes[i]:
                count += 1
                scopes[i] = count
        return out, scopes


def page_lines(html: str) -> list[Line]:
    """Every non-empty block, in page order."""
    found: list[tuple[str, int, int, bool]] = []
    containers = Containers()
    parts: list[str] = []
    linked, links, element = 0, False, False

    def flush() -> None:
        nonlocal linked, element
        text = " ".join(unescape("".join(parts)).split())
        if text:
            own = min(linked, len(text))
            found.append((text, containers.stack[-1], own, element))
            containers.mass[containers.stack[-1]] += len(text) - own
        parts.clear()
        linked, element = 0, False

    at, hidden = 0, Hidden(html)
    while m := TOKEN.search(html, at):
        if m.start() > at:
            parts.append(html[at : m.start()])
            linked += (m.start() - at) if links else 0
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag in FIELDS and not m["end"] and attributes(m["attrs"]).get("type", "").lower() != "hidden":
            containers.fields[containers.stack[-1]] += 1
        if not m["end"] and (tag in RAW or tag in CLOSED):
            if (behind := hidden.end(tag, at)) > at or tag in RAW:
                at = behind
                parts.append(" ")
            continue
        if tag in SPACES:
            parts.append(" ")
        elif tag == "a":
            links = not m["end"]
        elif tag == "h1":
            containers.headed[containers.stack[-1]] = True
        if tag in TEXT_ELEMENTS and (tag not in BLOCKS or m["end"]):
            element = True
        if tag not in BLOCKS:
            continue
        flush()
        if not m["end"] and tag in TEXT_ELEMENTS:
            element = True
        if tag not in CONTAINERS:
            continue
        if m["end"]:
            links = False
            containers.end(tag)
        else:
            containers.start(tag, m["attrs"])
    parts.append(html[at:])
    linked += len(html) - at if links else 0
    flush()
    out, scopes = containers.judged()
    return [Line(text, out[i], scopes[i], own, element) for text, i, own, element in found]


def effective_lengths(lines: list[Line]) -> list[int | None]:
    """The effective length of each line, None for those that never belong to the text."""
    own = [len(x.text) - x.linked for x in lines]
    mass: dict[int, int] = defaultdict(int)
    for x, n in zip(lines, own):
        if not x.boilerplate:
            mass[x.scope] += n if n >= BARE or x.scope else 0
    largest = max((n for s, n in mass.items() if s), default=0)
    scoped = largest > 0 and sum(n for s, n in mass.items() if s) >= mass[0]
    out: list[int | None] = []
    for x, n in zip(lines, own):
        inside = x.scope > 0 and mass[x.scope] >= LARGE * largest
        if x.boilerplate or (not inside if scoped else x.scope > 0 and mass[x.scope] < mass[0] * LARGE):
            out.append(None)
        elif 2 * x.linked > len(x.text):
            out.append(0)
        else:
            allowance = (ELEMENT if x.element else 0) + (SCOPE if scoped else 0)
            out.append(n + allowance if allowance or n >= BARE else 0)
    return out


def main_text(html: str | None, window: int = WINDOW) -> str:
    lines = page_lines(html or "")
    effective = effective_lengths(lines)
    length = [n or 0 for n in effective]
    if not any(length):
        return ""
    sums = [sum(length[i : i + window]) for i in range(len(length))]
    threshold = min(SURGE, max(sums))
    kept = []
    for i, line in enumerate(lines):
        if effective[i] is None:
            continue
        surges = sums[i] >= threshold
        lasts = sum(length[max(0, i - window + 1) : i + 1]) >= threshold
        if surges and lasts or length[i] and (surges or lasts):
            kept.append(line.text)
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, text and n_chars (code points) of every page."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
        columns = [batch.column(i) for i in range(len(keep))]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [*keep, "text", "n_chars"]
        )

    return map_rows(pages.select(*keep, pages[html].alias("__html")), run, f"{fields}, text string, n_chars bigint")
