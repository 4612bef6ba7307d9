"""Main text of web pages by two-pass block rules.

The markup is cut into blocks at block-level tags. Pass one decides each block by its container, length, link density and
stop-word density: blocks in navigation, forms, notices and the like are bad, as are blocks that are mostly links. Where a page
has an article or main element, blocks outside are bad; inside, long blocks with enough stop words are good, and what else isn't mostly links is
ambiguous. Without one, long blocks with many stop words are good and long blocks without them bad. Pass two gives each ambiguous block the label
of its nearest decided neighbours: good if both sides are, bad if both are, and where they differ the nearer one's; in an article
with no decided neighbour a block is good.

Stop words are those of five languages. Where a page's long blocks hold almost none of them, its language is another one, and length and link
density decide alone. Characters of scripts without blanks between words count three times as long as others.

Class and id names speak for a whole token only, each part of which must be a word of unwanted things or of layout: "comments" and "comments-list" are
unwanted, "comments-open" and "has-sidebar" are not. They never speak against an element that holds an outermost article
or main or, in a page without these, most of the text, unless they are of readers' comments.

Defined cases: null and empty html give an empty text; unclosed tags, comments and scripts run to their natural end, a tag cut
off at the end of the page is dropped; character references without a semicolon are decoded as browsers do;
rows are independent, so repeated rows, ties and null ids need no rule.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, MOST_LINKS = 0.30, 0.32, 0.2
MOST_LINKS_IN_ARTICLE, STOP_IN_ARTICLE = 0.8, 0.1
#: A page whose long blocks have a smaller share of stop words is in another language.
STOP_KNOWN = 0.1

# fixed values: function words
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its
    like may more most my new no not of on one only or other our out over she so some such than that the their them then there these they this to up was we were what when which
    who will with would you your
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ont ou par pas plus pour qu que qui sa se ses son sont sur un une vous
    aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so und um
    von vor war wie wird zu zum zur über
    al como con del desde donde el ella en entre era es esta este fue ha la las lo los más mi muy no o para pero por que se ser sin sobre su sus también un una y ya
    а без бы был была были было в во вот все всё вы где да для до его ее её если есть еще ещё же за и из или им их к как ко когда кто ли мы на над не нет но ну о об он она они оно от по под
    при с со так также там то того только ты у уже что чтобы эта эти это этот я""".split()
)
# fixed values: element names
SKIPPED = frozenset("head nav footer aside form script style noscript template iframe object embed svg math canvas button select option textarea dialog menu audio video map title".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav
    ol p pre section summary table tbody td tfoot th thead title tr ul""".split()
)
#: What may stand in head; anything else ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"head", "html", "body", "title", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "legend", "summary", "dd", "dt"}
# fixed values: words in class and id names, and roles, of what isn't main text
BAD_NAMES = frozenset(
    """ad ads adv advert advertisement adverts adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr masthead menu
    menubar modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion recommended related reply replies respond share sharing sidebar signup social sponsor sponsored
    subscribe toolbar widget""".split()
)
#: Words of layout that a name of unwanted things may also have.
LAYOUT_NAMES = frozenset("area bar block body bottom box button buttons center col column container content footer header icons inner item items left line link links list main outer page panel primary right row secondary section site text title top wrap wrapper".split())
#: Those that stay unwanted even where most of a page's text stands in them.
READERS_NAMES = frozenset("comment comments disqus reply replies respond".split())
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|noscript|template|iframe|svg|title)\b(?:[^"'>]|"[^"]*"|'[^']*')*+>.*?(?:</\1\b[^>]*>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*"|'[^']*')*+)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*(>|\Z)""",
    re.I | re.S,
)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORDS = re.compile(r"\w+")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


def _unwanted(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is unwanted, whether only its names say so, and whether they are of readers' comments."""
    if tag in SKIPPED or (tag == "header" and not in_article):
        return True, False, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, False, False
    named = readers = False
    for name, a, b, c in _NAMED.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in BAD_ROLES):
            return True, False, False
        if name in ("class", "id"):
            for token in value.split():
                parts = [x.lower() for x in _PARTS.findall(token)]
                bad = BAD_NAMES if in_article else BAD_NAMES | {"header"}
                if any(x in bad for x in parts) and all(x in bad or x in LAYOUT_NAMES or x.isdigit() for x in parts):
                    named, readers = True, readers or any(x in READERS_NAMES for x in parts)
    return named, named, readers


def blocks(page: str) -> list[tuple[str, float, bool, bool]]:
    """(text, link density, unwanted, in an article or main element) of each block that has text, in page order.

    Where only names speak against elements that hold an outermost article or main or most of the text, the page is read again without these names."""
    spared: frozenset = frozenset()
    while True:
        out, holders = _read(page, spared)
        if not holders:
            return out
        spared |= holders


def _read(page: str, spared: frozenset) -> tuple[list[tuple[str, float, bool, bool]], set[int]]:
    """The blocks, and where elements start whose names shouldn't have counted."""
    out: list[tuple[str, float, bool, bool]] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, int | None]] = []  # the last: where an element starts that is unwanted for its names only
    holders: set[int] = set()
    named_only: list[int] = []  # of those in the stack, the outermost first
    under: dict[int, int] = {}  # characters in elements that only their names speak against, by where the innermost starts
    above: dict[int, int | None] = {}  # where the next such element around it starts
    firm: set[int] = set()
    count: dict[str, int] = {}  # open elements by name: what isn't open needs no look through the stack
    bad = articles = links = at = 0

    def flush() -> None:
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                size = len(" ".join("".join(linked).split())) if linked else 0
                out.append((whole, size / len(whole), bad > 0, articles > 0))
            text.clear()
            linked.clear()

    def close(i: int) -> None:
        nonlocal bad, articles, links
        if any(t in BLOCKS for t, *_ in stack[i:]):
            flush()
        for tag, unwanted, where in stack[i:]:
            count[tag] -= 1
            if unwanted and where is not None:
                named_only.pop()
            bad -= unwanted
            articles -= tag in ("article", "main")
            links -= tag == "a"
        del stack[i:]

    for m in _TOKEN.finditer(page):
        if m.start() > at and stack and stack[-1][0] == "head" and page[at : m.start()].strip():
            close(len(stack) - 1)
        if m.start() > at and not bad:
            piece = html.unescape(page[at : m.start()])
            text.append(piece)
            if links:
                linked.append(piece)
        elif m.start() > at and not links and bad == len(named_only):
            under[named_only[-1]] = under.get(named_only[-1], 0) + len(page[at : m.start()].strip())
        at = m.end()
        tag, end = m[2], m[4]
        if tag is not None:
            tag = tag.lower()
            if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
                close(len(stack) - 1)
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    text.append(" ")
                continue
            if tag in CLOSES_P and count.get("p"):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
            elif tag == "a" and count.get("a"):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "a":
                        links -= 1
                        count["a"] -= 1
                        if stack[i][1] and stack[i][2] is not None:
                            named_only.remove(stack[i][2])
                        bad -= stack[i][1]
                        del stack[i]
                        break
            if tag in ("li", "td", "th", "tr", "dd", "dt", "option") and count.get(tag):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if stack[i][0] in ("ul", "ol", "table", "dl", "article", "main", "section", "div"):
                        break
            if tag in BLOCKS:
                flush()
            if m[3].endswith("/") and tag not in BLOCKS:
                continue
            unwanted, named, readers = _unwanted(tag, m[3], articles > 0)
            if readers:
                firm.add(m.start())
            if named and m.start() in spared:
                unwanted = named = False
            if tag in ("article", "main") and not articles and bad and bad == len(named_only):
                holders.update(named_only)
            stack.append((tag, unwanted, m.start() if named else None))
            count[tag] = count.get(tag, 0) + 1
            if unwanted and named:
                above[m.start()] = named_only[-1] if named_only else None
                named_only.append(m.start())
            bad += unwanted
            articles += tag in ("article", "main")
            links += tag == "a"
        elif end is not None:
            end = end.lower()
            if count.get(end):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == end:
                        close(i)
                        break
            elif end in BLOCKS:
                flush()
    if not holders and under and not any(article for *_, article in out):
        holders = _most(under, above, firm, sum(under.values()) + sum(len(t) for t, *_ in out) + sum(map(len, text)), not {"article", "main"} & set(count))
    if holders:
        return out, holders
    if at < len(page) and stack and stack[-1][0] == "head" and page[at:].strip():
        close(len(stack) - 1)
    if at < len(page) and not bad:
        text.append(html.unescape(page[at:]))
    flush()
    return out, set()


def _most(under: dict[int, int], above: dict[int, int | None], firm: set[int], total: int, all_of_them: bool) -> set[int]:
    """Of elements inside each other, from the outside in, those that hold more than half of a page's text each, or only the first; none that is of readers' comments, nor what is
    in it. Where a page has an article or main, what is in the first may be read as such, and decides whether there are more."""
    held: dict[int, int] = {}
    inside: dict[int | None, list[int]] = {}
    for where in sorted(above, reverse=True):  # an element starts after those around it
        held[where] = held.get(where, 0) + under.get(where, 0)
        around = above[where]
        inside.setdefault(around, []).append(where)
        if around is not None:
            held[around] = held.get(around, 0) + held[where]
    found: set[int] = set()
    at: int | None = None
    while at in inside:
        at = max(inside[at], key=lambda where: (held[where], -where))
        if at in firm or 2 * held[at] <= total:
            break
        found.add(at)
        if not all_of_them:
            break
    return found


def _size(text: str) -> int:
    """Length, where a character of a script without blanks between words counts three."""
    return len(text) if text.isascii() else len(text) + 2 * len(_UNSPACED.findall(text))


def _density(text: str) -> float:
    words = _WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def labels(found: list[tuple[str, float, bool, bool]]) -> list[bool]:
    """Both passes: True for each block of the main text."""
    inside = any(article and not bad for _, _, bad, article in found)
    counted = [(t, bad or (inside and not article), links) for t, links, bad, article in found]
    sizes = [0 if out else _size(t) for t, out, _ in counted]
    stops = [_density(t) if n >= SHORT and links <= MOST_LINKS_IN_ARTICLE else 0.0 for (t, _, links), n in zip(counted, sizes)]
    long = [(n, d) for n, d, (_, _, links) in zip(sizes, stops, counted) if n >= SHORT and links <= MOST_LINKS]
    known = sum(n * d for n, d in long) >= STOP_KNOWN * sum(n for n, _ in long)
    first: list[bool | None] = []
    for (text, out, links), size, density in zip(counted, sizes, stops):
        if out:
            first.append(False)
        elif inside:
            good = size >= SHORT and links <= MOST_LINKS and (density >= STOP_IN_ARTICLE or not known)
            first.append(False if links > MOST_LINKS_IN_ARTICLE else True if good else None)
        elif links > MOST_LINKS:
            first.append(False)
        elif size < SHORT:
            first.append(None)
        elif known:
            first.append(True if density >= STOP_HIGH and size > LONG else None if density >= STOP_LOW else False)
        else:
            first.append(True if size > LONG else None)
    scope = [i for i, b in enumerate(found) if not inside or (b[3] and not b[2])]
    out = [bool(x) for x in first]
    before: list[int | None] = []
    last = None
    for i in scope:
        last = i if first[i] is not None else last
        before.append(last)
    last = None
    for k in range(len(scope) - 1, -1, -1):
        i = scope[k]
        last = i if first[i] is not None else last
        if first[i] is not None:
            continue
        near = [j for j in (before[k], last) if j is not None]
        if not near:
            out[i] = inside
        elif len({first[j] for j in near}) == 1:
            out[i] = bool(first[near[0]])
        else:  # they differ: the nearer, and the good one of two as near
            out[i] = bool(first[min(near, key=lambda j: (abs(j - i), not first[j]))])
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b[0] for b, good in zip(found, labels(found)) if good).strip()


def text_column(page: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in s], dtype=object)

    return run(F.coalesce(page, F.lit("")))


def extract(pages: DataFrame) -> DataFrame:
    d = pages.select("page_id", "url", text_column(F.col("html")).alias("text"))
    return d.withColumn("n_chars", F.length("text").cast("long"))
