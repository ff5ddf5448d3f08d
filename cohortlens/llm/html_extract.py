"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements (inline elements only mark links).
Blocks of templates (navigation, headers, footers, sidebars, notices, adverts,
forms, reader comments, hidden parts) are pruned by element, role and the words
of class and id. Forms, and blocks that only such words mark, stay where they
hold more than half of the page's prose, with a title or nearly all of it, and
no article stands beside them: then they wrap the article. Inside an article, words that as often name a topic
(legal, rating, warning) only cost a block points: it stays where its own prose
earns more. Lists of links are menus, but not inside an article under a heading
or where the links are titles. Every remaining paragraph, that is a block's own run of
text, passes points for its length and its commas to its ancestors, all to the
parent and half as much with each level further up. A container's points are
discounted by the share of its text that stands in links. The best container is
kept with all its siblings that are no templates and not mostly links, in page
order; a container that holds all the text of its parent stands for the parent.

Defined cases: null and empty pages, and pages without text, give the empty
text; unclosed and misnested tags are closed as browsers do; a comment, script
or style that never ends reaches to the end of the page; character references
are decoded (also without a semicolon, as browsers do); repeated pages give
equal texts; extra columns are ignored. Pages are read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import map_batches

TAG = re.compile(r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|[!?/])""")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "select", "svg", "object", "canvas", "audio", "video", "annotation", "annotation-xml"}
#: Where raw text ends: in any case of ASCII letters, whatever other letters the page has.
ENDS = {tag: re.compile(f"<(/?){tag}(?=[\\s/>])", re.IGNORECASE | re.ASCII) for tag in RAW}
#: Of these an inner one ends before the outer one does.
NESTED = {"svg", "object", "template", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "picture", "map", "nobr", "center", "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "mpadded", "mphantom", "menclose", "mtable", "mtr", "mtd", "semantics"}
#: What a start tag closes, and where the search for it ends.
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"})}
PRUNED = {"nav", "footer", "aside", "menu", "dialog", "button", "fieldset", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist", "note", "status"}
#: Words of class and id that mark templates.
TEMPLATE = set("ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion promoted sidebar sidebars rail aside nav navbar navigation menu submenu topbar toolbar breadcrumb breadcrumbs footer foot colophon masthead header comment comments commentlist discussion disqus leaderboard skyscraper mpu reply replies respond responses notice notices cookie cookies consent gdpr alert warning popup modal overlay dialog newsletter subscribe subscription signup login register form search related recommended recommendations share sharing social follow widget widgets tags tagcloud pagination pager copyright legal disclaimer skip hidden outbrain taboola paywall teaser shoutbox feedback rating ratings".split())
#: Words that keep a block although a template word stands beside them.
BODY = set("article articlebody main content post entry story body text page wrapper container layout".split())
#: Words beside which an id still marks a template.
NEUTRAL = set("area bar block bottom box bottoms container global inner item left links list main my new outer page panel right section site the top view wrap wrapper".split())
#: What follows such a word in a class is not what the block is.
NOT_ITSELF = {"with", "has", "no", "without", "hide"}
#: Words of reader comments: a block of these does not become the article by its length.
READERS = set("comment comments commentlist discussion disqus reply replies respond responses shoutbox feedback rating ratings".split())
#: Of those, words that may also wrap an article.
RATED = {"discussion", "feedback", "rating", "ratings"}
#: Template words that as often name a topic: inside an article each block of them has to earn its place.
TOPICS = set("alert feedback follow hidden legal overlay discussion rating ratings recommendations recommended register related search share sharing skip social tags warning".split())
#: What such a word costs: no share bar or list of tags earns it, a paragraph does.
COST = 2.5
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: From this many characters an item on, a list of links is one of titles.
TITLE = 25
#: How sure it is that a block is a template.
NO, TOPIC, SOFT, HARD = 0, 1, 2, 3


class Node:
    __slots__ = ("tag", "up", "down", "pruned", "points", "chars", "linked", "inside")

    def __init__(self, tag: str, up: Node | None, pruned: int = NO, inside: bool = False):
        self.tag, self.up, self.pruned, self.inside = tag, up, pruned, inside  # inside an article or main
        self.down: list[Node | tuple[str, bool]] = []  # child blocks and (text, in a link) runs
        self.points, self.chars, self.linked = 0.0, 0, 0


def words(value: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", value)]


def named(value: str) -> list[str]:
    """The words of the names in a class, each up to one that says what stands beside it."""
    out: list[str] = []
    for name in value.split():
        for w in words(name):
            if w in NOT_ITSELF:
                break
            out.append(w)
    return out


def is_template(tag: str, attributes: str, inside: bool = False) -> int:
    """Whether a block belongs to the page's frame rather than its article; ``inside`` an article some words tell less."""
    if tag in PRUNED:
        return HARD
    if tag in ("html", "body"):
        return NO
    sure = SOFT if tag == "form" else NO
    if not attributes:
        return sure
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return HARD
    if found.get("role", "").lower() in ROLES:
        return HARD
    if tag == "main":
        return sure
    kind, own = named(found.get("class", "")), [] if tag in HEADINGS else words(found.get("id", ""))
    if any(w not in TEMPLATE and w not in NEUTRAL for w in own):  # an id often names a topic
        own = [w for w in own if w in READERS or w in BODY]
    names = kind + own
    marked = [w for w in names if w in TEMPLATE]
    if marked and not (any(w in BODY for w in names) and not {"comment", "comments", "sidebar", "ad", "ads", "advert", "related", "footer", "nav", "notice"} & set(marked)):
        if sure == NO and inside and set(marked) <= TOPICS:
            return TOPIC
        return HARD if (READERS - RATED) & set(marked) else max(sure, SOFT)
    return sure


def parse(page: str) -> Node:
    """The tree of blocks of a page."""
    root = at = Node("#page", None)
    place, link = 0, 0
    for_text: list[str] = []
    opened: Counter[str] = Counter()  # tags of the blocks that are open, so that no search for one goes in vain

    def open_block(node: Node) -> Node:
        node.up.down.append(node)
        opened[node.tag] += 1
        return node

    def closed_up_to(node: Node, at: Node) -> Node:
        while at is not node:
            opened[at.tag] -= 1
            at = at.up
        return at

    def flush() -> None:
        if for_text:
            at.down.append(("".join(for_text), link > 0))
            for_text.clear()

    size = len(page)
    while place < size:
        start = page.find("<", place)
        if start < 0:
            for_text.append(html.unescape(page[place:]))
            break
        if start > place:
            for_text.append(html.unescape(page[place:start]))
        m = TAG.match(page, start)
        if m is None:
            if page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] == "/":  # a tag that never ends
                break
            for_text.append("<")
            place = start + 1
            continue
        if m[2] is None:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                place = size if end < 0 else end + 3
            else:
                end = page.find(">", start)
                place = size if end < 0 else end + 1
            continue
        place = m.end()
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if closing or m[3].rstrip().endswith("/"):
                continue
            end, depth = ENDS[tag].search(page, place), 1
            while end is not None:
                depth += 0 if tag not in NESTED and not end[1] else -1 if end[1] else 1
                if depth == 0:
                    break
                end = ENDS[tag].search(page, end.end())
            if end is None:
                break
            stop = page.find(">", end.start())
            place = size if stop < 0 else stop + 1
            for_text.append(" ")
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input"):
                if tag != "wbr":
                    for_text.append(" ")
            elif tag == "hr":
                flush()
                at.down.append(Node("hr", at))
            continue
        if tag in INLINE:
            if tag == "a":
                flush()
                link = 0 if closing else 1
            if not closing and m[3] and is_template(tag, m[3]):
                flush()
                at = open_block(Node(tag, at, HARD))
            elif closing and at.tag == tag:
                flush()
                at = closed_up_to(at.up, at)
            continue
        flush()
        if closing:
            if opened[tag]:
                node = at
                while node.tag != tag:
                    node = node.up
                at = closed_up_to(node.up, at)
            continue
        link = 0
        while at.tag in INLINE:  # a block ends inline parts that were left open
            at = closed_up_to(at.up, at)
        if tag in ("html", "body"):
            if at is not root and at.tag != "html" and at.tag != "head":
                continue
            if at.tag == "head":
                at = closed_up_to(at.up, at)
        elif tag in CLOSED_BY:
            closed, stop = CLOSED_BY[tag]
            if any(opened[t] for t in closed):
                node = at
                while node.tag not in closed and node.tag not in stop:
                    node = node.up
                if node.tag in closed:
                    at = closed_up_to(node.up, at)
        if at.tag == "p" or at.tag in HEADINGS and tag in HEADINGS:  # a block ends an open paragraph
            at = closed_up_to(at.up, at)
        inside = opened["article"] + opened["main"] > 0
        at = open_block(Node(tag, at, max(is_template(tag, m[3], inside), HARD if tag == "header" and not opened["article"] else NO), inside))
    flush()
    return root


def paragraph_points(text: str, chars: int, linked: int, weight: float = 1.0) -> float:
    """Points of a run of text: one, one for each comma, one for every 100 characters up to three; less by its links."""
    commas = text.count(",") + text.count("、") + text.count("，")
    return (weight + commas + min((chars - linked) / 100, 3)) * (1 - linked / chars)


def keep_wrapping(root: Node) -> None:
    """Blocks that are templates by their words alone, or forms, stay where they wrap the article.

    A wrapper holds more than half of the prose, and a title or nearly all of it.
    A block of a topic's word stays where its prose earns more than the word costs.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.pruned != HARD:
            order.append(node)
            stack += [x for x in node.down if isinstance(x, Node)]
    if not any(n.pruned for n in order):
        return
    prose, holds, side = {id(n): 0 for n in order}, {id(n): False for n in order}, set()
    earned, linked = {id(n): 0.0 for n in order}, {id(n): 0 for n in order}
    for node in order:  # parents come before children
        if node.pruned > TOPIC or node.up is not None and id(node.up) in side:
            side.add(id(node))
    total = beside = 0
    for node in reversed(order):
        for t, a in (x for x in node.down if isinstance(x, tuple)):
            t = SPACE.sub(" ", t).strip()
            if a:
                linked[id(node)] += len(t)
            elif t:
                prose[id(node)] += len(t)
                total += len(t)
                earned[id(node)] += paragraph_points(t, len(t), 0, 0.0)
        if id(node) not in side and prose[id(node)] and node.tag in ("article", "main"):
            beside += 1
        if node.up is not None:
            up = id(node.up)
            prose[up] += prose[id(node)]
            earned[up] += earned[id(node)]
            linked[up] += linked[id(node)]
            holds[up] |= holds[id(node)] or node.tag in ("article", "main", "h1")
    for node in order:
        own = prose[id(node)]
        if node.pruned == TOPIC:
            if earned[id(node)] * own > COST * (own + linked[id(node)]):
                node.pruned = NO
        elif node.pruned and own > 0.5 * total and not beside and (own > 0.9 * total or holds[id(node)] or node.tag in ("article", "main")):
            node.pruned = NO


def is_menu(node: Node, place: int) -> bool:
    """A list of links that nobody marked as a menu; ``place``: among its parent's parts."""
    items = sum(isinstance(x, Node) for x in node.down) if node.tag in ("ul", "ol") and node.linked > 0.9 * node.chars else 0
    return node.chars > 0 and items >= 3 and not (node.inside and is_listing(node, place, items))


def is_listing(node: Node, place: int, items: int) -> bool:
    """Whether a list of links in an article is of the article: under a heading, after a colon, or one of titles."""
    for x in reversed(node.up.down[max(place - 3, 0) : place]):
        if isinstance(x, Node):
            if x.tag in HEADINGS and not x.pruned or x.tag == "p" and "".join(blocks_of(x)[-1:]).endswith(":"):
                return True
            break
        if x[0].strip():
            if x[0].rstrip().endswith(":"):
                return True
            break
    return node.chars >= TITLE * items


def blocks_of(node: Node, kept: set[int] | None = None) -> list[str]:
    """The texts of the runs of a block and of all below it, in page order; of its own child blocks only those ``kept``."""
    out: list[str] = []
    stack: list[tuple[Node, int]] = [(node, 0)]
    run: list[str] = []

    def end() -> None:
        if run and (text := SPACE.sub(" ", "".join(run)).strip()):
            out.append(text)
        run.clear()

    while stack:
        at, i = stack.pop()
        if i == len(at.down) or at.pruned:
            if at.tag not in INLINE:
                end()
            continue
        stack.append((at, i + 1))
        x = at.down[i]
        if isinstance(x, tuple):
            run.append(x[0])
        elif not (x.pruned and x.tag in INLINE):
            end()
            if not x.pruned and not is_menu(x, i) and (kept is None or at is not node or id(x) in kept):
                stack.append((x, 0))
    return out


def score(root: Node) -> list[Node]:
    """Points of every block, from its paragraphs up; the blocks in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.pruned:
            continue
        order.append(node)
        stack += [x for x in reversed(node.down) if isinstance(x, Node)]
    passed = {id(n): 0.0 for n in order}  # what a block got from below
    for node in reversed(order):
        own = [(SPACE.sub(" ", t).strip(), linked) for t, linked in (x for x in node.down if isinstance(x, tuple))]
        chars, linked = sum(len(t) for t, _ in own), sum(len(t) for t, a in own if a)
        points = paragraph_points("".join(t for t, a in own if not a), chars, linked, 0.2 if node.tag in HEADINGS else 1.0) if chars else 0.0
        node.chars += chars
        node.linked += linked
        node.points += passed[id(node)]
        if node.tag not in ("p", "pre", "blockquote", "td", "li", "dd", "dt", *HEADINGS) or node.up is None:
            node.points += points
            points /= 2
        if (up := node.up) is not None:
            passed[id(up)] += points + passed[id(node)] / 2
            up.chars += node.chars
            up.linked += node.linked
    return order


def extract(page: str | None) -> str:
    """The main text of a page, its blocks joined by line ends."""
    if not page:
        return ""
    root = parse(page)
    keep_wrapping(root)
    order = [n for n in score(root) if n.chars]
    if not order:
        return ""
    bonus = {"article": 1.5, "main": 1.3, "section": 1.05}

    def value(node: Node) -> float:
        return node.points * bonus.get(node.tag, 1.0) * (1 - node.linked / node.chars)

    containers = [n for n in order if n.tag not in ("p", "li", *HEADINGS)] or order
    best = max(containers, key=value)
    # an article is taken whole: the best part of it stands for all of it
    at = best
    while at.up is not None:
        if at.tag in ("article", "main") and 1 - at.linked / at.chars >= 0.5:
            best = at
        at = at.up
    if best.up is None or best.tag == "article" and not any(isinstance(x, Node) and x is not best and x.tag == "article" for x in best.up.down):
        return "\n".join(blocks_of(best))
    while best.up.up is not None and best.up.chars == best.chars:  # a wrapper of nothing else
        best = best.up
    kept = {id(x) for x in best.up.down if isinstance(x, Node) and not x.pruned and x.chars and (x is best or x.linked < 0.5 * x.chars)}
    return "\n".join(blocks_of(best.up, kept))


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per page the kept columns, ``text`` and ``n_chars``."""
    source = pages.select(*[F.col(c) for c in keep], F.col(html_col).alias("_html"))
    schema = source.drop("_html").schema.add("text", "string")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([extract(p) for p in b.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], names=[*keep, "text"])

    return map_batches(source, extracted, schema).withColumn("n_chars", F.char_length("text").cast("long"))
