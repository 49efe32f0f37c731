"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  Pass one decides blocks by stop-word density, length and link
density; blocks too short to tell, and long ones of middling density, are left open.  Pass two gives each open block
the label of its nearest decided neighbour on either side.

Where the blocks stand is one more feature.  Elements made for menus, footers, forms and the like are boilerplate.
A class, id or role that names boilerplate lowers its element's prior: the element is left out, unless it holds an
article or main element, or a heading with blocks that pass one calls good.  Article and main elements, or else elements
named so, are candidates for the main text; the weight of pass one's labels decides among several, and a
candidate without a good block gives way to good text outside that far outweighs it.  Inside the main text all is kept
that isn't boilerplate: its neighbours are those of the main text, and menus are told by runs of links.

Pages are read by a tolerant scanner of our own that never fails: end tags may be left out where HTML allows
it, cut-off pages and unknown entities are read as far as they go, and elements nested deeper than MAX_DEPTH are taken
as siblings, so the time is linear in the page.  A null or empty page has no text; repeated rows are read each for
itself; ids of any type are kept as they are; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from locuspark.llm.workers import lean

# Thresholds of the two passes.
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
MAX_LINK_DENSITY = 0.2
#: Below this density in every known language, a page's language is taken as unknown, and length decides alone.
STOP_UNKNOWN = 0.1
#: What a character of a block weighs that isn't good; of the heaviest candidate, the share that others need; and how
#: far good text outside must outweigh a candidate without any.
OPEN_WEIGHT, LEAST_SHARE, OUTVOTES = 0.1, 0.25, 3.0
#: So many neighbouring blocks that are links and nothing else are a menu.
MENU_RUN = 3
#: Open elements that are looked at one by one before their places by name are.
NEAR = 8

# Elements.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button head title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BOILERPLATE = frozenset("nav footer header aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CONTENT = frozenset("article main".split())
KINDS = dict.fromkeys(CONTENT, "article") | dict.fromkeys(BOILERPLATE, "boilerplate") | dict.fromkeys(SKIPPED, "skip")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Start tags that end an open paragraph, and what other start tags end, up to which element.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
P_SCOPE = frozenset("table td th caption button object template body html".split())
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["body"])),
    **{h: (HEADINGS, BLOCKS - HEADINGS) for h in HEADINGS},
}
# End tags that don't reach out of a table.
IN_TABLE, TABLE = frozenset("p li div span b a".split()), frozenset(["table"])
# Words of class, id and role attributes that name boilerplate.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
# Words that make a name speak of a layout, not of the element itself, as in has-sidebar.
LAYOUT = frozenset("has have with without no not is non show hide hides".split())
# Words of the same attributes that name the main text, where no element does.
CONTENT_NAMES = frozenset("article articlebody content entry main post story".split())
# Common words.
STOP_WORDS = {
    "en": frozenset("a an and are as at be been but by for from had has have he her his i in is it its no not of on or our she so that the their them there they this to was we were what when which who will with would you your".split()),
    "fr": frozenset("à au aux avec ce ces comme dans de des du elle en est et être il ils je la le les leur lui mais me ne nous on ont ou où par pas plus pour qu que qui sa se ses si son sont sur tout un une vous".split()),
    "de": frozenset("als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sein sich sie sind so über um und von vor war was wenn werden wie wird zu zum zur".split()),
    "es": frozenset("a al como con de del desde donde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por que se ser si sin sobre son su sus también un una y ya yo".split()),
}

_CLOSES = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|lang|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HREF = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_FIRST_HREF = re.compile(r'\s+href="([^"]*)"', re.I)
_PIECES = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Node:
    """An open element that matters: what it is, and what was found inside it."""

    kind: str  # "skip", "boilerplate", "named", "article", "content" or ""
    holds_content: bool = False
    holds_heading: bool = False


#: What an element is that doesn't matter: nothing is ever found inside it.
PLAIN = Node("")


@dataclass
class Block:
    text: str
    linked: int
    boilerplate: bool
    named: tuple[Node, ...] = ()  # elements around it with a boilerplate name
    article: Node | None = None  # innermost article or main element
    content: Node | None = None  # innermost element named so
    label: str = ""  # "good", "bad" or "" while open
    alone: bool = field(default=False)  # a link and nothing else


def said(value: str) -> set[str]:
    """The words of a class, id or role attribute; a name that speaks of the layout says nothing."""
    out: set[str] = set()
    for name in value.split():
        pieces = [p for p in _PIECES.split(name) if p]
        if not LAYOUT & set(pieces):
            out.update(pieces)
    return out


def _kind(name: str, attributes: str) -> tuple[str, str]:
    """What an element is, and its language."""
    kind, lang = KINDS.get(name, ""), ""
    for key, *values in _ATTRIBUTE.findall(attributes) if attributes and not attributes.isspace() else ():
        value, key = "".join(values).lower(), key.lower()
        if key == "lang":
            lang = value[:2]
        elif key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value)):
            kind = "skip"
        elif key in ("class", "id", "role") and name not in ("html", "body") and kind in ("", "article", "content"):
            words = said(value)
            if NAMES & words and kind != "article":
                kind = "named"
            elif kind == "article" and "comment" in words | {w.removesuffix("s") for w in words}:
                kind = "named"  # readers' comments are often articles of their own
            elif not kind and CONTENT_NAMES & words:
                kind = "content"
    return kind, lang


@dataclass
class Marks:
    """What a page says beside its text: its first title, and where its links lead, in page order."""

    title: str | None = None
    links: list[str] = field(default_factory=list)


def target(attributes: str) -> str | None:
    """The first href of a tag's attributes, None without one."""
    if m := _FIRST_HREF.match(attributes):
        return html.unescape(m[1]) if "&" in m[1] else m[1]
    return next((html.unescape("".join(values)) for name, *values in _HREF.findall(attributes) if name.lower() == "href"), None)


def blocks(page: str, marks: Marks | None = None) -> tuple[list[Block], str]:
    """The blocks with text, in page order, and the page's language.  Time is linear in the page, however deep it is."""
    out: list[Block] = []
    parts: list[str] = []
    lang = ""
    stack: list[tuple[str, Node]] = []
    where: dict[str, list[int]] = defaultdict(list)  # open elements' places in the stack, by name
    depth = {"skip": 0, "boilerplate": 0}
    marked: dict[str, list[Node]] = {"named": [], "article": [], "content": []}
    linked = links = 0

    named, articles, contents = marked["named"], marked["article"], marked["content"]

    def close_block() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, depth["boilerplate"] > 0, tuple(named), articles[-1] if articles else None, contents[-1] if contents else None, alone=linked >= len(text)))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not depth["skip"]:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    def pop(i: int) -> None:
        """Closes the open elements from the i-th on; a link ends with the element around it."""
        nonlocal links
        while len(stack) > i:
            name, node = stack.pop()
            where[name].pop()
            if name == "a":
                links = 0
            if node is not PLAIN:
                if node.kind in depth:
                    depth[node.kind] -= 1
                elif node.kind:
                    marked[node.kind].pop()

    def innermost(names: frozenset[str]) -> int:
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    def end(closes: frozenset[str], scope: frozenset[str]) -> None:
        for i in range(len(stack) - 1, max(-1, len(stack) - 1 - NEAR), -1):
            if stack[i][0] in closes:
                return pop(i)
            if stack[i][0] in scope:
                return None
        i = innermost(closes)
        if i >= 0 and i >= innermost(scope):
            pop(i)

    paragraph = frozenset(["p"])
    at, stop = 0, len(page)
    while at < stop:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in BLOCKS:
            if parts:
                close_block()
        elif name == "br":
            parts.append(" ")
        if name == "a":
            led = None if closing else target(m[3])
            links = int(led is not None)  # an anchor that leads nowhere is text
            if marks is not None and led is not None:
                marks.links.append(" ".join(led.split()))
        if closing:
            if stack and stack[-1][0] == name:
                pop(len(stack) - 1)
                continue
            i = where[name][-1] if where.get(name) else -1
            if i >= 0 and not (name in IN_TABLE and i < innermost(TABLE)):
                pop(i)
            continue
        if name in ENDS_P:
            end(paragraph, P_SCOPE)
        if name in ENDS:
            end(*ENDS[name])
        if name in VOID:
            continue
        kind, own = _kind(name, m[3])
        lang = own if own and name == "html" else lang
        if name in RAW and not m[0].endswith("/>"):
            close = _CLOSES[name].search(page, at)
            if name == "title" and marks is not None and marks.title is None:
                marks.title = " ".join(html.unescape(page[at : close.start() if close else stop]).split())
            at = close.end() if close else stop
            continue
        if kind == "article" or name in HEADINGS:
            for node in marked["named"]:
                node.holds_content |= kind == "article"
                node.holds_heading |= name == "h1"
        node = Node(kind) if kind else PLAIN
        where[name].append(len(stack))
        stack.append((name, node))
        if kind in depth:
            depth[kind] += 1
        elif kind:
            marked[kind].append(node)
    if parts:
        close_block()
    return out, lang


def stop_density(text: str, known: frozenset[str] | None) -> float:
    """The share of common words; 0 for a page in no known language."""
    words = _WORDS.findall(text.lower())
    return sum(w in known for w in words) / len(words) if words and known else 0.0


def common_words(found: list[Block], lang: str) -> frozenset[str] | None:
    """The common words of the page's language: of the one that it names, else of the one that fits best; None if none does."""
    if lang in STOP_WORDS:
        return STOP_WORDS[lang]
    words = [w for b in found if not b.boilerplate for w in _WORDS.findall(b.text.lower())]
    best = max(STOP_WORDS.values(), key=lambda known: sum(w in known for w in words))
    return best if sum(w in best for w in words) >= STOP_UNKNOWN * len(words) else None


def classify(found: list[Block], lang: str) -> None:
    """Pass one: labels by density, length and links alone, but for elements made for boilerplate."""
    known = common_words(found, lang)
    for b in found:
        n = len(b.text)
        if b.boilerplate or b.linked > MAX_LINK_DENSITY * n:
            b.label = "bad"
        elif n < LENGTH_LOW:
            b.label = ""
        elif known is None:
            b.label = "good"
        else:
            density = stop_density(b.text, known)
            if density >= STOP_HIGH or (n > LENGTH_HIGH and density >= STOP_LOW):
                b.label = "good"
            elif density < STOP_LOW:
                b.label = "bad"
    # A name is outvoted by an article inside it, or by a heading with good blocks.
    good = {id(node) for b in found if b.label == "good" for node in b.named}
    for b in found:
        if any(not (x.holds_content or (x.holds_heading and id(x) in good)) for x in b.named):
            b.boilerplate, b.label = True, "bad"


def main_parts(found: list[Block]) -> list[bool] | None:
    """Which blocks stand in the page's main text; None where no element holds it."""
    for tier in ("article", "content"):
        held = [None if b.boilerplate else getattr(b, tier) for b in found]
        weight: dict[int, float] = {}
        for b, node in zip(found, held, strict=True):
            if node is not None:
                weight[id(node)] = weight.get(id(node), 0.0) + len(b.text) * (1.0 if b.label == "good" else OPEN_WEIGHT)
        if not weight:
            continue
        most = max(weight.values())
        main = [node is not None and weight[id(node)] >= LEAST_SHARE * most for node in held]
        inside = sum(len(b.text) for b, x in zip(found, main, strict=True) if x)
        outside = sum(len(b.text) for b, x in zip(found, main, strict=True) if not x and b.label == "good")
        if outside > max(OUTVOTES * inside, LENGTH_HIGH) and not any(b.label == "good" for b, x in zip(found, main, strict=True) if x):
            return None
        return main
    return None


def _menus(found: list[Block]) -> None:
    """Runs of blocks that are links and nothing else stay bad; a single one is left open."""
    i = 0
    while i < len(found):
        j = i
        while j < len(found) and found[j].alone and not found[j].boilerplate:
            j += 1
        for b in found[i:j]:
            b.label = "bad" if j - i >= MENU_RUN else ""
        i = max(j, i + 1)


def inherit(found: list[Block]) -> None:
    """Pass two: open blocks take their nearest decided neighbours' label; where these differ, the nearer one's, and good on a tie.

    In the main text, links and long blocks of low density are open too, and only good neighbours count: a menu or
    an advert says nothing of the sentence that stands beside it.  Without any decided neighbour a block is good.
    """
    main = main_parts(found)
    groups = [(None, found)] if main is None else [(inside, [b for b, x in zip(found, main, strict=True) if x == inside]) for inside in (True, False)]
    for inside, group in groups:
        if inside:
            for b in group:
                b.label = b.label if b.boilerplate or b.label == "good" else ""
            _menus(group)
        decided = [(i, b.label) for i, b in enumerate(group) if b.label and (not inside or b.label == "good")]
        k = 0
        for i, b in enumerate(group):
            if b.label:
                continue
            while k < len(decided) and decided[k][0] < i:
                k += 1
            near = [x for x in (decided[k - 1] if k else None, decided[k] if k < len(decided) else None) if x]
            best = min((abs(x[0] - i) for x in near), default=0)
            labels = {x[1] for x in near if abs(x[0] - i) == best}
            b.label = "good" if "good" in labels or not near else "bad"
        if inside is False:
            for b in group:
                b.label = "bad"
        elif inside is None and not any(b.label == "good" for b in group):
            for b in group:  # nothing is long enough to tell: what isn't boilerplate or links is all there is
                b.label = "bad" if b.boilerplate or b.linked > MAX_LINK_DENSITY * len(b.text) else "good"


def main_text(page: str | None) -> str:
    """The page's main text: good blocks, one on a line."""
    if not page:
        return ""
    found, lang = blocks(page)
    classify(found, lang)
    inherit(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))
    return rows.mapInArrow(lean(run), StructType([StructField("page_id", rows.schema["page_id"].dataType), StructField("url", StringType()), StructField("text", StringType()), StructField("n_chars", LongType())]))
