"""Main text of web pages by tag-path ratios.

A page becomes a list of text nodes, each with its path of tags from the root. Nodes
with one path are taken together: a path's ratio is its text length per node, and
its punctuation per node; link text counts against it. Ratios are smoothed along the
page with a Gaussian window, fused to one number per path and cut at a threshold, a
share of the best: the nodes of the paths above it are the main text. Class, id and role
names that tell of adverts, menus and the like lower a path's score, unless the element
holds the page's article or most of its punctuated text. A heading before main
text, and a short line beside it that is not mostly links, stay with it; so do tables,
code, captions, short paragraphs and lists of sources of the article around it.

Pages are read by a tolerant scanner: unclosed and stray tags, raw text in scripts and
styles, comments, and a page that breaks off are all fine; the cost is linear in the
page at any depth.

Defined results: a null or empty page has an empty text, so has one without any text
outside menus and the like; repeated rows get equal answers; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED = frozenset("script style noscript template head title iframe svg annotation annotation-xml object canvas select option datalist".split())
RAW = frozenset("script style noscript template title textarea iframe svg canvas object xmp noembed noframes".split())
BOILERPLATE = frozenset("nav footer aside form button menu dialog textarea input label fieldset legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header "
    "hgroup hr legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
) - {"br"}
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th".split())
# Words of class, id and role names that tell what an element is for.
MARKED = re.compile(
    r"(?:^|[\s_-])(?<!with[_-])(?<!has[_-])(?<!no[_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|"
    r"comments?|disqus|replies|reply|respond|discussion|sidebars?|side|widgets?|related|recommend(?:ed|ations?)?|nav|navbar|navigation|menu|breadcrumbs?|"
    r"footer|topbar|share|sharing|social|subscribe|newsletter|signup|login|search|pagination|pager|tags|toolbar|complementary|contentinfo|"
    r"topnav|sidenav|subnav|mainnav|mainmenu|adsbygoogle|commentlist|cookiebar|sitefooter|pagefooter)(?=\d*(?:$|[\s_-]))",
    re.I,
)
# Those that also name parts of an article.
AMBIGUOUS = re.compile(r"(?:notice|notification|alert|replies|reply|respond|discussion|side|related|recommend(?:ed|ations?)?|navigation|share|sharing|social|consent|search|tags|promotions?)\Z", re.I)
TEXTUAL = frozenset("section blockquote p li dd dt dl ul ol figure figcaption pre table td th details h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements through which a short line lies beside the text around them.
STRUCTURE = PARAGRAPHS | frozenset("ul ol dl table tbody thead tfoot blockquote figure figcaption pre section header hgroup details summary".split())
# Names of a page's head; an article's own heading is text.
HEAD = re.compile(r"(?:^|[\s_-])(?<!article[_-])(?<!post[_-])(?<!entry[_-])(?<!story[_-])(?<!content[_-])(?:header|masthead|siteheader|pageheader)(?=\d*(?:$|[\s_-]))", re.I)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")  # within a name such as siteFooter
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|=)*+)(?:>|\Z)""", re.S)  # a quote opens a value only after =
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies)(?=$|[\s_-])", re.I)
SENTENCE = tuple(".?!:…。？！")  # what a sentence ends with
PUNCTUATION = re.compile(r"[.,;:!?\"'()…、。，¿¡«»“”-]")


class _Element:
    """An open element, with what its place in the tree says of the text below it."""

    __slots__ = ("number", "tag", "parent", "place", "block", "path", "bad", "skipped", "link", "factor", "stated", "holder", "textual", "named")

    def __init__(self, number: int, tag: str, parent: _Element | None, path: int, bad: bool, factor: float, named: bool):
        self.number, self.tag, self.parent, self.path, self.factor = number, tag, parent, path, factor
        self.place = parent.place + 1 if parent else 0  # on the stack
        self.bad = bad or (parent is not None and parent.bad)  # in a menu or the like
        self.skipped = tag in SKIPPED or (parent is not None and parent.skipped)
        self.link = tag == "a" or (parent is not None and parent.link)
        article = tag in ("article", "main")
        self.stated: _Element | None = self if article else parent.stated if parent else None  # innermost article or main
        self.block: _Element = self if parent is None or tag in BLOCK else parent.block
        # Innermost block that isn't part of the structure of a text.
        self.holder: _Element = self if parent is None or (tag in BLOCK and tag not in STRUCTURE) else parent.holder
        self.textual = not article and (tag in TEXTUAL or (parent is not None and parent.textual))
        self.named = named

    @property
    def article(self) -> bool:
        return self.stated is self


class _Node:
    """A block of text."""

    __slots__ = ("element", "parts", "linked", "whole")

    def __init__(self, element: _Element):
        self.element = element
        self.parts: list[str] = []
        self.linked = 0
        self.whole: str | None = None

    def text(self) -> str:
        """The text of the finished block."""
        if self.whole is None:
            self.whole = " ".join(html.unescape("".join(self.parts)).split())
        return self.whole


def blocks(page: str) -> tuple[list[_Node], list[_Element]]:
    """The blocks of text of a page in order, and its elements, each after its parent."""
    root = _Element(0, "", None, 0, False, 1.0, False)
    elements, stack = [root], [root]
    places: dict[str, list[int]] = {}  # on the stack, of each tag
    barriers: list[int] = []  # places that a stray inline end tag doesn't reach beyond
    paths: dict[tuple[int, str], int] = {}
    out: list[_Node] = []
    now: _Node | None = None
    at = 0

    def put(text: str) -> None:
        nonlocal now
        top = stack[-1]
        if not text or top.skipped:
            return
        if now is None:
            if not text.strip():
                return
            now = _Node(top)
            out.append(now)
        now.parts.append(text)
        if top.link:
            now.linked += len(text.strip())

    def close(place: int) -> None:
        nonlocal now
        while len(stack) > place:
            e = stack.pop()
            places[e.tag].pop()
            if barriers and barriers[-1] == e.place:
                barriers.pop()
            if not e.skipped and (e.tag in BLOCK or e.bad or e.factor < 1):
                now = None

    while m := TAG.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            put(" ")
            continue
        if m[1]:
            if places.get(tag) and (tag in BLOCK or not barriers or places[tag][-1] >= barriers[-1]):
                close(places[tag][-1])
            continue
        if tag in VOID:
            if tag in ("hr",):
                now = None
            continue
        if tag in BLOCK and places.get("head"):
            close(places["head"][-1])
        if tag in BLOCK:  # a block ends the paragraph that it would lie in
            inner = stack[-1].block
            other = inner.tag
            if other == "p" or (other == tag and tag in PARAGRAPHS) or (other in ("dt", "dd") and tag in ("dt", "dd")) or (other in ("td", "th") and tag in ("td", "th", "tr")):
                close(inner.place)
        names = ids = ""
        hidden = False
        for a in ATTRIBUTE.finditer(m[3]):
            key, value = a[1].lower(), (a[2] or "").strip("\"'")
            if key == "hidden":
                hidden = True
            elif key in ("class", "role"):
                names += " " + value
            elif key == "id":
                ids += " " + value
        top = stack[-1]
        inside = top.stated is not None
        factor = 1.0
        if tag not in ("html", "body", "article", "main"):
            factor = _factor(tag, HUMP.sub("-", names), HUMP.sub("-", ids), inside)
        names = HUMP.sub("-", names + ids)
        bad = hidden or tag in BOILERPLATE or tag in SKIPPED or (tag == "header" and not inside)
        bad = bad or (tag == "article" and bool(COMMENTS.search(names)))
        if not top.skipped and tag not in SKIPPED and (tag in BLOCK or factor < 1 or (bad and not top.bad)):
            now = None  # what isn't shown, such as a script, parts no sentence
        if m[3].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        path = top.path
        if tag in BLOCK:
            label = tag if tag in PARAGRAPHS or not names else f"{tag}.{' '.join(sorted(names.split()))}"
            path = paths.setdefault((path, label), len(paths) + 1)
        e = _Element(len(elements), tag, top, path, bad, factor, bool(names.strip()))
        elements.append(e)
        stack.append(e)
        places.setdefault(tag, []).append(e.place)
        if tag in ("article", "main", "body", "section", "table"):
            barriers.append(e.place)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if tag == "textarea" or tag == "title":
                put(page[at : end.start() if end else len(page)])
            at = end.start() if end else len(page)
    put(page[at:])
    return [n for n in out if n.text()], elements


def _factor(tag: str, names: str, ids: str, inside: bool) -> float:
    """What the names of an element leave of its score."""
    if tag in HEADINGS:
        ids = ""  # they name what follows
    found = [m[0].strip(" -_") for m in MARKED.finditer(names)]
    slugs = [m[0].strip(" -_") for m in MARKED.finditer(ids)]
    if not inside and (HEAD.search(names) or HEAD.search(ids)):
        return 1e-4
    if not found and not slugs:
        return 1.0
    if tag in TEXTUAL and inside:
        slugs = []  # parts of an article are named by their titles
    if not all(AMBIGUOUS.match(x) for x in found + slugs):
        return 1e-4
    return 0.5 if tag in TEXTUAL else 0.02


def _factors(nodes: list[_Node], elements: list[_Element]) -> list[float]:
    """Of each node, by the names around it; those of an element that holds the text itself don't count."""
    marks = [len(PUNCTUATION.findall(n.text())) * (1 - min(1.0, n.linked / len(n.text()))) for n in nodes]
    held = [0.0] * len(elements)
    own = [0] * len(elements)  # nodes within the element
    around = [0] * len(elements)  # nodes of an article or main within the element
    for n, k in zip(nodes, marks):
        held[n.element.number] += k
        own[n.element.number] += 1
    for e in reversed(elements[1:]):
        p = e.parent.number
        held[p] += held[e.number]
        own[p] += own[e.number]
        around[p] += own[e.number] if e.article else around[e.number]
    anywhere, half = any(n.element.stated for n in nodes), sum(marks) / 2
    least = [1.0] * len(elements)
    for e in elements[1:]:
        spared = around[e.number] or (not anywhere and held[e.number] > half)
        least[e.number] = min(least[e.parent.number], 1.0 if spared else e.factor)
    return [least[n.element.number] for n in nodes]


def _smoothed(x: np.ndarray, radius: int = 2) -> np.ndarray:
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / 1.0) ** 2)
    if len(x) == 1:
        return x
    padded = np.pad(x, radius, mode="edge")
    return np.convolve(padded, weights / weights.sum(), mode="valid")


def content(nodes: list[_Node], elements: list[_Element], share: float = 0.2) -> list[_Node]:
    """The blocks that belong to the main text."""
    good = [n for n in nodes if not n.element.bad]
    if not good:
        return []
    factor = _factors(good, elements)
    paths: dict[tuple, list[int]] = {}
    for i, n in enumerate(good):
        paths.setdefault((n.element.path, factor[i]), []).append(i)
    length = np.array([len(n.text()) for n in good], dtype=np.float64)
    plain = np.maximum(length - [n.linked for n in good], 0)
    marks = np.array([len(PUNCTUATION.findall(n.text())) for n in good], dtype=np.float64)
    of = np.empty(len(good), dtype=np.int64)
    for j, rows in enumerate(paths.values()):
        of[rows] = j
    many = np.bincount(of)
    text, total, points = (np.bincount(of, weights=x) for x in (plain, length, marks))
    ratio, pointed = (text / many)[of], (points / many + 1)[of]  # text to tag path ratio, and that of punctuation
    fused = _smoothed(ratio) * _smoothed(pointed)
    middle = np.array([np.median(fused[rows]) if len(rows) > 1 else fused[rows[0]] for rows in paths.values()])
    own = np.minimum(middle[of], ratio * pointed)  # a short path isn't lifted by its neighbours
    score = np.array(factor) * own * (text / np.maximum(1.0, total))[of]
    chosen = score >= share * share * score.max()
    kept = chosen | _beside(good, elements, chosen, factor, plain >= 0.5 * length)
    return [n for n, k in zip(good, kept) if k]


def _beside(nodes: list[_Node], elements: list[_Element], chosen: np.ndarray, factor: list[float], unlinked: np.ndarray) -> np.ndarray:
    """Short lines in an element that holds chosen text itself, parts of the article around it, and headings before what is kept."""
    holders = {n.element.holder.number for n, c in zip(nodes, chosen) if c}
    region = _region([n for n, c in zip(nodes, chosen) if c], elements)
    within = [e is region or region is None for e in elements]
    for e in elements[1:]:
        within[e.number] = within[e.number] or within[e.parent.number]
    out = np.zeros(len(nodes), dtype=bool)
    follows = False
    for i in range(len(nodes) - 1, -1, -1):
        e = nodes[i].element
        plain_name = factor[i] >= 0.5 and within[e.number]
        beside = e.holder.number in holders
        if e.block.tag in HEADINGS:
            out[i] = plain_name and (follows or beside)
        else:
            part = region is not None and region.article and _is_part(nodes[i], region, factor[i], bool(unlinked[i]))
            out[i] = plain_name and ((bool(unlinked[i]) and beside) or part)
            follows = bool(chosen[i] or out[i])
    return out


def _is_part(node: _Node, region: _Element, factor: float, unlinked: bool) -> bool:
    """Whether a block that the ratios left out is a part of the article all the same.

    Tables, code, captions, questions and short paragraphs are; so are lists of links
    without a telling name. A line of an element without a name that is no sentence
    isn't, nor is a link that lies in no paragraph or list.
    """
    e = node.element
    if unlinked:
        return e.textual or e.holder.named or node.text().endswith(SENTENCE)
    return e.textual and factor == 1.0 and region.tag == "article"


def _region(chosen: list[_Node], elements: list[_Element]) -> _Element | None:
    """The article or main around all chosen text, else what holds its lowest common ancestor; None for the page."""
    below = [0] * len(elements)
    for n in chosen:
        below[n.element.block.number] += 1
    for e in reversed(elements[1:]):
        below[e.parent.number] += below[e.number]
    common = [e for e in elements[1:] if below[e.number] == len(chosen) and e.tag in BLOCK]  # each within the one before
    stated = [e for e in common if e.article]
    if stated:
        return stated[-1]
    return common[-2] if len(common) > 1 else None


def extract(page: str | None, share: float = 0.2) -> str:
    """Main text of a page, one line per block."""
    return "\n".join(n.text() for n in content(*blocks(page), share)) if page else ""


def extracted(pages: DataFrame, id_col: str, url_col: str, html_col: str, share: float = 0.2) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row."""

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([extract(x, share) for x in part], dtype=object)

    text: Column = texts.asNondeterministic()(F.col(html_col))
    found = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text.alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
