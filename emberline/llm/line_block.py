"""Main text of a web page by the distribution of its line blocks.

Markup is stripped in one pass into lines, one for each block of the page, with the
length of each line's text and of its links. A line weighs its text without twice its
links; lines of scripts, forms, menus and other boilerplate elements, of containers named
for such, and of hidden ones weigh nothing. Weights are summed over a sliding window of lines. Where
the sums leave nothing is a surge, where they fall back to nothing a dive; what lies
between is a stretch. A stretch is text if its highest sum reaches a threshold that comes
from the page's own distribution (a share of the window that a character of the page
lies in on average). Its short first lines, before the first heading or line of weight, are
left off, and so are its lines in windows made of links.

Where the page names an article, that is a prior and no more: the article's lines
are text whatever their sums, with their links, and stretches beside it only
if they outweigh it. Boilerplate names count on containers, not on
paragraphs, headings and items of lists, but for adverts. If they leave no text at
all of a page of several lines, the marks of names, and then those of forms, are dropped:
a form or a wrapper with an unlucky name may hold a whole page.

Character references are decoded, white space inside a block becomes one space, and
blocks are joined by a line feed. Null or empty pages, and pages without text, give
an empty text. Unclosed and misnested tags are closed by what stands around them.
Pages of any length are read whole. Repeated rows give one row each, an empty table
none; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, schema_of

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Element names of the HTML standard, by what is done with them.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav header footer aside menu dialog button select option head svg canvas object template applet audio video map".split())
CONTAINERS = frozenset("div section ul ol dl table tbody tr td span details fieldset figure center iframe ins".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NAMES = re.compile(
    r"(?:^|[^a-z])(?:nav\w*|menu\w*|sidebar\w*|side-?bar|footer\w*|foot|header|masthead|breadcrumbs?|cookies?|consent|gdpr|notices?|banner\w*|ads?|adverts?|advertisement\w*|adsense|promo\w*|sponsor\w*|comments?|commentlist|comment-?\w+|reply|replies|respond|disqus\w*|share|sharing|social\w*|related\w*|recommend\w*|newsletter|subscribe|subscription|popup|pop-up|modal|overlay|widgets?|login|signup|pagination|pager|toolbar|alert|warning|disclaimer|copyright|skip-?link|tags|outbrain|taboola)(?:$|[^a-z])"
)
ADVERTS = re.compile(r"(?:^|\s)(?:ads?|adverts?|advertisement|adsense|ad-?(?:box|slot|banner|unit)|sponsored)(?:$|\s)")
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
WINDOW = 3
#: Share of the page's mean window that a stretch must reach.
REACH = 0.15
#: What stretches outside a named article must have of its length, or of LEAST code points if it has fewer.
OUTWEIGH = 2.0
LEAST = 100
#: Why a line is boilerplate: its element, a form around it, or a name.
ELEMENT, FORM, NAME = 4, 2, 1


def boilerplate(name: str, attributes: str, in_main: bool) -> int:
    """Why an element is boilerplate; 0 if it isn't."""
    if name in BOILERPLATE:
        return 0 if name == "header" and in_main else ELEMENT
    if name == "form":
        return FORM
    if not attributes or name in ("html", "body", "article", "main"):
        return 0
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id") and (NAMES if name in CONTAINERS else ADVERTS).search(value):
            return NAME
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
            return ELEMENT
    return 0


class Line(NamedTuple):
    """A block of a page: text, code points of it in links, why it is boilerplate (bits), whether it is in an article and in a heading."""

    text: str
    links: int = 0
    marks: int = 0
    inside: bool = False
    heading: bool = False


def lines(page: str) -> tuple[list[Line], bool]:
    """Blocks of the page in order, and whether it names an article."""
    out: list[Line] = []
    parts: list[str] = []
    linked: list[str] = []
    open_: list[tuple[str, int, bool]] = []  # name, mark, heads an article
    main = heads = anchors = 0
    named = False
    depth = {ELEMENT: 0, FORM: 0, NAME: 0, 0: 0}
    at = 0

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            links = " ".join(entities.unescape("".join(linked)).split())
            parts.clear()
            linked.clear()
            if text:
                heading = any(o[0] in HEADINGS for o in open_)
                marks = sum(k for k, d in depth.items() if d)
                out.append(Line(text, min(len(links), len(text)), marks | (ELEMENT if heads and not heading else 0), main > 0, heading))

    def close(n: int):
        nonlocal main, heads, anchors
        while len(open_) > n:
            name, mark, is_head = open_.pop()
            depth[mark] -= 1
            heads -= is_head
            main -= name in MAIN
            anchors -= name == "a"

    def add(text: str):
        parts.append(text)
        if anchors:
            linked.append(text)

    find = TOKEN.search
    while True:
        m = find(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                add(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, ending, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ending:
            if name not in INLINE:
                flush()
            at_open = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
            if at_open is not None and (name not in INLINE or not any(o[0] not in INLINE for o in open_[at_open + 1 :])):
                close(at_open)
            continue
        if name in RAW:
            if name not in INLINE:
                flush()
            end = re.compile(rf"</{name}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in ("br", "wbr", "img", "input"):
            add(" " if name != "wbr" else "")
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_P or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                # what may not hold this element ends here
                ends = {"p"} if name in CLOSES_P else {name, "p"} | ({"dt", "dd"} if name[0] == "d" else set()) | ({"td", "th"} if name[0] == "t" else set())
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] in ends:
                        close(k)
                        break
                    if open_[k][0] not in INLINE and open_[k][0] not in ends:
                        break
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            continue
        mark = boilerplate(name, attributes, main > 0)
        is_head = name == "header" and main > 0 and not mark
        open_.append((name, mark, is_head))
        depth[mark] += 1
        heads += is_head
        main += name in MAIN
        named = named or name in MAIN and not any(depth[k] for k in (ELEMENT, FORM, NAME))
        anchors += name == "a"
    flush()
    return out, named


def window_sums(weights: list[int], window: int = WINDOW) -> list[int]:
    """Sum of each line and the ``window - 1`` lines after it."""
    return [sum(weights[i : i + window]) for i in range(len(weights))]


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """From each surge (a weighty line after a dive) to the dive after it, where a window has nothing."""
    out, start = [], None
    for i, s in enumerate(window_sums(weights, window)):
        if start is None and weights[i]:
            start = i
        elif start is not None and s == 0:
            out.append((start, i))
            start = None
    return out + ([(start, len(weights))] if start is not None else [])


def threshold(weights: list[int], window: int = WINDOW) -> float:
    """What a window must reach: a share of the one that a character of the page lies in on average."""
    sums = window_sums(weights, window)
    return REACH * sum(s * s for s in sums) / total if (total := sum(sums)) else 0.0


def chosen(found: list[Line], named: bool = False, window: int = WINDOW) -> list[int]:
    """Lines of the main text."""
    marks = NAME | FORM | ELEMENT
    for drop in () if named else (NAME, FORM):  # marks are believed while they leave some text
        if all(f.marks & marks for f in found) and sum(not f.marks & marks & ~drop for f in found) > window:
            marks &= ~drop
    plain = [not f.marks & marks for f in found]
    weights = [max(0, len(f.text) - (0 if f.inside else 2 * f.links)) if ok else 0 for f, ok in zip(found, plain)]
    sums, least = window_sums(weights, window), threshold(weights, window)
    of_links = [sum(f.links for f, ok in zip(found[i : i + window], plain[i : i + window]) if ok) for i in range(len(found))]
    own = sum(w for f, w in zip(found, weights) if f.inside)
    out: list[int] = []
    for a, b in stretches(weights, window):
        inside = [i for i in range(a, b) if found[i].inside and plain[i]]
        if inside:
            # the article stands for the stretch; what only lies beside it is not of it
            out += inside
            continue
        if max(sums[a:b]) < least or named and sum(weights[a:b]) < OUTWEIGH * max(own, LEAST):
            continue
        first = next((i for i in range(a, b) if plain[i] and (found[i].heading or weights[i] >= least)), a)
        for i in range(first, b):
            around = range(max(a, i - window + 1), min(b, i + 1))
            menu = found[i].links and all(of_links[k] * 2 > sum(len(found[j].text) for j in range(k, min(k + window, len(found))) if plain[j]) for k in around)
            if plain[i] and not menu:
                out.append(i)
    return out


def main_text(page: str | None, window: int = WINDOW) -> str:
    found, named = lines(page or "")
    return "\n".join(found[i].text for i in chosen(found, named, window))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Of each row: id, url, text and n_chars."""
    schema = schema_of(f"{id_col} bigint, {url_col} string, text string, n_chars bigint")

    def make():
        def step(x):
            texts = [main_text(p) for p in x["html"]]
            return {id_col: x["id"], url_col: x["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    return map_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), make, schema)
