"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. A line weighs its
characters outside links, and nothing if most of it is links. What the page says of itself only changes weights: a
paragraph or heading, and a line in an article, weigh some ``BONUS`` more; a line
outside the article of a page that has one weighs ``OUTSIDE`` of its length; lines
of menus, headers and footers of the page, side bars, notices, adverts, forms and
reader comments weigh nothing. Weights are summed over sliding windows of
``WINDOW`` lines. A surge is where the sum reaches ``SURGE``; its text begins and ends where
the sum dives below ``DIVE`` on either side, and the lines between are kept, but for
those that weigh nothing. So a short line stays if it leads to a long one, and a lone short line of an
article doesn't surge. On a page that never reaches twice the surge, that is half of the
highest sum. No window reaches over an article's border.

One pass over the pages without a shuffle, in time linear in the page. Entities are
decoded as HTML does; runs of white space become one space; lines join by one space.

Defined cases: null or empty html gives an empty text; a page that ends inside a
tag, comment or entity is read as far as it goes; an element that is excluded but
never closed is an ordinary one; a mark of an article that stands in a script, a
comment or an excluded element, or holds no text, is none; repeated pages give
repeated rows; input columns named like a result are kept with ``_of_page`` behind it.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_or_empty

WINDOW = 3
#: The window sum at which text begins, and below which it has ended.
SURGE, DIVE = 80, 20
#: Characters that a kind of line, and a line of an article, weighs beyond its length. Both together don't reach a surge.
BONUS = {"p": 20, "pre": 20, "blockquote": 20, "h1": 15, "h2": 15, "h3": 15, "h4": 15, "h5": 15, "h6": 15, "li": 5, "td": 5}
IN_ARTICLE = 20
#: What a character outside the article weighs on a page that has one.
OUTSIDE = 1 / 16
#: A line at the edge of a region that weighs less than this was only reached by its neighbour's window.
EDGE = 5

# HTML's own element names by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes noscript".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img label".split())
NEVER = set("nav aside footer form script style noscript template iframe svg canvas object button select option dialog menu audio video map head".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class or id that mark what is not article text.
STRONG = set("comment comments disqus respond nav navbar navigation menu breadcrumb breadcrumbs footer ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr".split())
WEAK = set("sidebar side banner promo promotion header masthead notice notices popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations widget widgets toolbar pagination pager alert".split())
#: Words that mark a holder of the text, even if a weak word stands beside them.
HOLDER = set("content main article entry post body page layout wrapper container".split())

TAG = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
MAIN_ROLE = re.compile(r"""(?:^|\s)role\s*=\s*["']?main\b""", re.IGNORECASE)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}


class Line:
    """A block's text: ``linked`` characters of it in links, whether it is ``inside`` an article, and whether its markup says that it is ``never`` text."""

    __slots__ = ("parts", "linked", "inside", "never", "bonus", "text")

    def __init__(self, inside: bool, never: bool, bonus: int):
        self.parts, self.linked, self.inside, self.never, self.bonus, self.text = [], 0, inside, never, bonus, ""


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def excluded(name: str, attrs: str, inside: bool) -> bool | str:
    """Whether an element holds no article text; "weak" if that yields to an article inside it."""
    if name in ("html", "body", "main", "article"):
        if name != "article" or not attrs:
            return False
    if name in NEVER:
        return True
    if name == "header":
        return not inside
    if not attrs:
        return False
    found = attributes(attrs)
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    words = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower()))
    if words & STRONG:
        return True if not words & HOLDER or words & {"comment", "comments"} else "weak"
    return "weak" if words & WEAK and not words & HOLDER else False


def tags_of(html: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name, closes, attributes) of each tag and comment; the content of raw elements belongs to their tag."""
    out, at = [], 0
    while (m := TAG.search(html, at)) is not None:
        at = m.end()
        name, closes = (m[2] or m[5] or "").lower(), bool(m[1] or m[4])
        if name in RAW and not closes:
            end = RAW_END[name].search(html, at)
            at = end.end() if end else len(html)
        out.append((m.start(), at, name, closes, m[3] or m[6] or ""))
    return out


def ends_of(tags: list[tuple[int, int, str, bool, str]]) -> dict[int, int]:
    """By place of a tag that opens an element, the place of the tag that closes it. One pass; unclosed elements have none."""
    opened: dict[str, list[int]] = {}
    ends = {}
    for i, (_, _, name, closes, _) in enumerate(tags):
        if not closes:
            opened.setdefault(name, []).append(i)
        elif opened.get(name):
            ends[opened[name].pop()] = i
    return ends


def lines_of(html: str) -> list[Line]:
    """The blocks of a page in order."""
    tags = tags_of(html)
    ends = ends_of(tags)
    mains = [i for i, (_, _, name, closes, attrs) in enumerate(tags) if not closes and (name in ("article", "main") or ("role" in attrs and MAIN_ROLE.search(attrs)))]
    cache: dict[tuple[str, str, bool], bool | str] = {}
    lines = [Line(False, False, 0)]
    at = link = 0
    never_to, inside_to = -1, []

    def say(text: str) -> None:
        if text:
            lines[-1].parts.append(text)
            if link:
                lines[-1].linked += len(text)

    def cut(bonus: int = 0) -> None:
        inside, never = bool(inside_to), never_to >= 0
        if lines[-1].parts:
            lines.append(Line(inside, never, bonus))
        else:
            lines[-1].inside, lines[-1].never, lines[-1].bonus = inside, never, bonus

    for i, (start, end, name, closes, attrs) in enumerate(tags):
        say(html[at:start])
        at = end
        if not name:
            continue
        if closes:
            if i == never_to:
                never_to = -1
                cut()
            while inside_to and i >= inside_to[-1]:
                inside_to.pop()
                cut()
            if name == "a":
                link = 0
            elif name not in INLINE:
                cut()
            continue
        if name in RAW:
            continue
        last = ends.get(i, -1)
        if last >= 0 and never_to < 0 and name not in VOID:
            key = (name, attrs, bool(inside_to))
            if key not in cache:
                cache[key] = excluded(*key)
            holds_main = cache[key] == "weak" and bisect_left(mains, i + 1) < bisect_left(mains, last)
            if cache[key] and not holds_main:
                never_to = last
                cut()
        j = bisect_left(mains, i)
        if j < len(mains) and mains[j] == i and never_to < 0:
            # An article that is never closed ends with the page.
            if last >= 0 or name in ("article", "main"):
                inside_to.append(last if last >= 0 else len(tags))
            cut()
        elif name == "a":
            link = 1
        elif name not in INLINE:
            cut(BONUS.get(name, 0))
    say(html[at:])
    for x in lines:
        x.text = " ".join(entities.unescape("".join(x.parts)).split())
    return lines


def weights_of(lines: list[Line], window: int = WINDOW) -> list[tuple[int, float]]:
    """(place of the line, weight) along the page; place -1 is a gap, which keeps windows on one side of an article's border.

    Lines that are never text, or mostly links, are gaps outside an article; inside one they are passed over.
    """
    has_main = any(x.inside and x.text and not x.never for x in lines)
    out: list[tuple[int, float]] = []
    before = False
    for i, x in enumerate(lines):
        if has_main and x.inside != before:
            out += [(-1, 0.0)] * window
            before = x.inside
        if not x.text:
            if not x.inside:
                out.append((-1, 0.0))
            continue
        if x.never:
            if not x.inside:
                out.append((i, 0.0))
        else:
            free = max(0, len(x.text) - x.linked)
            own = free + x.bonus if 2 * free >= len(x.text) else 0
            if not has_main or not x.inside:
                out.append((i, own * OUTSIDE if has_main else own))
            elif own:
                out.append((i, own + IN_ARTICLE))
    return out


def sums_of(weights: list[float], window: int = WINDOW) -> list[float]:
    """The sum of each line's window, which reaches half of ``window`` to either side."""
    half = window // 2
    before = [0.0]
    for w in weights:
        before.append(before[-1] + w)
    n = len(weights)
    return [before[min(n, i + half + 1)] - before[max(0, i - half)] for i in range(n)]


def regions(weights: list[float], window: int = WINDOW, surge: float = SURGE, dive: float = DIVE) -> list[tuple[int, int]]:
    """(begin, end) of each run of lines whose window sums stay at or above ``dive`` and reach ``surge``, or half of the highest sum if that is lower."""
    sums = sums_of(weights, window)
    high = min(surge, max(sums, default=0) / 2)
    low = min(dive, high)
    out, start, surged = [], None, False
    if high <= 0:
        return out
    for i, total in enumerate([*sums, -1.0]):
        if total >= low:
            start, surged = i if start is None else start, surged or total >= high
        elif start is not None:
            if surged:
                out.append((start, i))
            start, surged = None, False
    return out


def extract_text(html: str | None, window: int = WINDOW, surge: float = SURGE, dive: float = DIVE) -> str:
    if not html:
        return ""
    lines = lines_of(html)
    line = weights_of(lines, window)
    weights = [w for _, w in line]
    edge = min(EDGE, max(weights, default=0))
    kept = []
    for a, b in regions(weights, window, surge, dive):
        while a < b and weights[a] < edge:
            a += 1
        while a < b and weights[b - 1] < edge:
            b -= 1
        kept += [lines[i].text for i, w in line[a:b] if w > 0]
    return " ".join(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The pages without their html: all other columns, then text and n_chars."""
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def main_text(html: pd.Series) -> pd.Series:
        return html.map(extract_text)

    taken = set(pages.columns) | {"text", "n_chars"}

    def kept_as(name: str) -> str:
        if name in ("text", "n_chars"):
            while name in taken:
                name += "_of_page"
        return name

    rest = [pages[f"`{c}`"].alias(kept_as(c)) for c in pages.columns if c != html_col]
    out = pages.select(*rest, main_text(text_or_empty(html_col)).alias("text"))
    return out.select("*", F.char_length("text").cast("long").alias("n_chars"))
