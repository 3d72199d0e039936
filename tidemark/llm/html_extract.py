"""Main text of web pages by tree scoring.

Paragraphs give points for length and commas to their ancestors, which link density discounts; the best container and the
siblings that look like it are kept.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import bounded_batches

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
DROPPED = frozenset("nav header footer aside form script style noscript template iframe head button select option textarea input svg math canvas audio video object embed map dialog menu search title".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
CLOSES_P = BLOCK - frozenset("body html option optgroup tbody td tfoot th thead tr caption legend summary dd dt li".split())
SCORED = frozenset("p pre td blockquote li dd h2 h3 h4 h5 h6 figcaption".split())
#: An opening tag ends an open element of the first set, up to the nearest element of the second.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
#: Words of class and id values. A name counts only as a whole: each of its words is of one of these sets. A firm word marks a
#: container that isn't the article; a loose one marks what is mostly links or a row of signed posts.
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
FIRM = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot promo promos promotion promotions sponsor sponsored breadcrumb breadcrumbs cookie cookies consent gdpr notice notices disclaimer copyright newsletter newsletters subscribe subscription signup popup modal overlay lightbox menubar navbar navigation topnav sidebar sidenav footer colophon masthead related recommended recommendations pagination pager outbrain taboola tagcloud banner menu toolbar nav share sharing social recommend tags teaser teasers".split()
)
LOOSE = frozenset("login rail widget widgets foot header response responses reply discussion skip hidden".split())
#: Words that say what part of a page a name means, not what is in it.
PLAIN = frozenset(
    "list box area section container wrapper wrap block bar inner outer body item items link links button buttons form top bottom left right main site page global post posts article articles entry blog user reader readers story stories news feed thread slot unit panel message messages text content title primary secondary large small".split()
)
_SIGNED = frozenset("author avatar byline date datetime timestamp username commenter posted".split())
_REPLY = frozenset("reply répondre antworten responder rispondi".split())
_CONTAINERS = frozenset("div section article aside main center details fieldset table td".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of its letters in links from which an element is mostly links.
MANY_LINKS = 0.4
#: Points from which siblings of the best container stay, and from which text can be an article.
ARTICLE = 10.0

#: A tag's attributes: a quote opens a value only right after an equals sign; elsewhere it is a character like others.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+|))*+)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_SELF_CLOSED = re.compile(r"""(?:\A|[\s"'])/\Z""")
_PARTS = re.compile(r"[^\W\d_]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element. ``letters``, ``linked``, ``commas``: of the text below it that isn't clutter; ``linked``: within links below it."""

    __slots__ = ("children", "clutter", "commas", "letters", "linked", "named", "parent", "score", "signed", "tag")

    def __init__(self, tag: str, parent: Node | None, clutter: bool, named: str = "", signed: bool = False):
        self.tag, self.parent, self.clutter, self.named, self.signed, self.score = tag, parent, clutter, named, signed or tag == "time", 0.0
        self.letters = self.linked = self.commas = 0
        self.children: list[Node | str] = []

    def density(self) -> float:
        """Share of the letters that are in links."""
        return (1.0 if self.tag == "a" else self.linked / self.letters) if self.letters else 0.0


def _name(value: str) -> tuple[str, bool]:
    """The strongest clutter that the names of a class or id value mean (``comments, firm, loose`` or none), and whether one of
    them is that of an author or a date."""
    found, signed = "", False
    for name in value.split():
        words = [w.lower() for w in _PARTS.findall(_HUMP.sub("-", name))]
        signed = signed or not _SIGNED.isdisjoint(words)
        if all(w in FIRM or w in LOOSE or w in PLAIN for w in words):
            own = "comments" if not COMMENTS.isdisjoint(words) else "firm" if not FIRM.isdisjoint(words) else "loose" if not LOOSE.isdisjoint(words) else ""
            found = min(found, own, key=("comments", "firm", "loose", "").index)
    return found, signed


def _marks(tag: str, attributes: str, by_name: bool) -> tuple[bool, str, bool]:
    """Whether an element is clutter by its tag, role or hiding, what clutter a class or id names, and whether it signs a post."""
    if tag in DROPPED:
        return True, "", False
    if not by_name or not attributes or attributes.isspace() or tag in ("html", "body", "main"):
        return False, "", False
    named, signed = "", False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            meant, author = _name(value)
            signed = signed or author
            if meant and tag not in HEADINGS and (tag != "article" or meant == "comments"):
                named = min(named or "loose", meant, key=("comments", "firm", "loose").index)
        elif name == "role":
            if value.lower() in DROPPED_ROLES:
                return True, "", False
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True, "", False
    return False, named, signed


def parse(page: str, by_name: bool = True) -> Node:
    """A tree of elements and text. Unclosed elements end with their parents; end tags without a start are passed over;
    inline elements don't outlive the block they began in. Classes, ids and roles mark clutter only ``by_name``."""
    root = Node("", None, False)
    path, open_tags = [root], Counter()
    pos = 0

    def text(raw: str) -> None:
        if raw:
            path[-1].children.append(_html.unescape(raw) if "&" in raw else raw)

    def close(depth: int) -> None:
        for n in path[depth:]:
            open_tags[n.tag] -= 1
        del path[depth:]

    while (m := _TOKEN.search(page, pos)) is not None:
        text(page[pos : m.start()])
        pos = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            if open_tags[tag]:
                depth = len(path) - 1
                while path[depth].tag != tag and (tag in BLOCK or path[depth].tag not in BLOCK):  # an inline end tag reaches no further than its block
                    depth -= 1
                if path[depth].tag == tag:
                    close(depth)
            continue
        if tag in CLOSES_P and open_tags["p"]:
            depth = len(path) - 1
            while depth and path[depth].tag not in BLOCK:
                depth -= 1
            if path[depth].tag == "p":
                close(depth)
        if tag in IMPLIED and any(open_tags[t] for t in IMPLIED[tag][0]):
            ends, within = IMPLIED[tag]
            depth, last = len(path) - 1, 0
            while depth and path[depth].tag not in within:
                if path[depth].tag in ends:
                    last = depth
                depth -= 1
            if last:
                close(last)
        node = Node(tag, path[-1], *_marks(tag, m[3], by_name))
        path[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else len(page)
        elif tag not in VOID and (tag in BLOCK or not _SELF_CLOSED.search(m[3])):
            path.append(node)
            open_tags[tag] += 1
    text(page[pos:])
    return root


def _in_order(root: Node) -> list[Node]:
    """Elements below ``root`` that aren't clutter nor in it, parents before children, in page order."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node) and not c.clutter)
    return order


def weigh(order: list[Node]) -> None:
    """Fill in letters, link letters and commas, each element from its children, in one pass."""
    for n in reversed(order):
        n.letters = n.linked = n.commas = 0
        for c in n.children:
            if isinstance(c, str):
                n.letters += len(c.strip())
                n.commas += c.count(",") + c.count("、") + c.count("，")
            elif not c.clutter:
                n.letters += c.letters
                n.linked += c.letters if c.tag == "a" else c.linked
                n.commas += c.commas


def _is_paragraph(n: Node) -> bool:
    return n.tag in SCORED or n.tag in ("div", "section", "article", "main", "body", "") and any(isinstance(c, str) and len(c.strip()) > 24 for c in n.children)


def _points(n: Node) -> float:
    return (1.0 + n.commas + min(n.letters / 100.0, 3.0)) * (1.0 - n.linked / n.letters) if n.letters else 0.0


def _posts(order: list[Node]) -> tuple[set[Node], set[Node]]:
    """Elements with an author or a date at or below them, and those with a link that says "reply"."""
    signed, answered = set(), set()
    for n in reversed(order):
        below = [c for c in n.children if isinstance(c, Node) and not c.clutter]
        if n.signed or any(c in signed for c in below):
            signed.add(n)
        if any(c in answered for c in below) or n.tag == "a" and n.letters < 20 and " ".join(c.strip() for c in n.children if isinstance(c, str)).lower() in _REPLY:
            answered.add(n)
    return signed, answered


def _alike(n: Node, of: set[Node]) -> list[Node]:
    """Children of one tag, two at least, that are all in ``of``."""
    below = [c for c in n.children if isinstance(c, Node) and not c.clutter and c.tag in ("div", "li", "article", "section", "blockquote", "tr", "dd")]
    tags = Counter(c.tag for c in below if c in of)
    return [c for c in below if tags[c.tag] > 1 and c in of]


def _is_clutter(n: Node, signed: set[Node]) -> bool:
    """A named element, by what it is: a container that a firm word names, whatever its length; what is mostly links; a row of signed
    posts; a list of comments. A single paragraph, heading or list is clutter only where it is mostly links."""
    if n.density() > MANY_LINKS or n.named != "firm" and _alike(n, signed):
        return True
    if n.named in ("firm", "comments") and n.tag in _CONTAINERS:
        return True
    return n.named == "comments" and n.tag in ("ul", "ol", "dl") and any(isinstance(x, Node) and x.tag in BLOCK for c in n.children if isinstance(c, Node) for x in c.children)


def judge_names(root: Node) -> list[Node]:
    """Marks readers' comments and named elements that ``_is_clutter`` says so of, and gives the outermost of the other named ones,
    which take no part in the search for the article but belong to it where they lie in it.

    Comments need no name where two posts or more of one tag each have an author or date and a link to reply. A named element
    with more points and letters than all that its like would leave of the page loses its mark, unless what is left has
    text in <article> or <main> or is an article itself (by its points; with a twentieth of the other's at least, if that is
    no comments). So does a named one within it that has more than half of its letters."""
    order = _in_order(root)
    weigh(order)
    signed, answered = _posts(order)
    if both := signed & answered:
        for n in order:
            for post in _alike(n, both):
                post.clutter = True
        order = _in_order(root)
        weigh(order)
    if not any(n.named for n in order):
        return []
    points: dict[Node, float] = {}
    left: dict[Node, tuple[float, int, int]] = {}  # points, letters, letters in <article> or <main>, without named elements below
    for n in reversed(order):
        below = [c for c in n.children if isinstance(c, Node) and not c.clutter]
        own = _points(n) if _is_paragraph(n) else 0.0
        points[n] = own + sum(points[c] for c in below)
        rest = [left[c] for c in below if not c.named]
        letters = n.letters - sum(c.letters for c in below) + sum(x[1] for x in rest)
        left[n] = own + sum(x[0] for x in rest), letters, letters if n.tag in ("article", "main") else sum(x[2] for x in rest)

    def outermost(top: Node) -> list[Node]:
        found, stack = [], [c for c in top.children if isinstance(c, Node) and not c.clutter]
        while stack:
            n = stack.pop()
            if n.named:
                found.append(n)
            else:
                stack.extend(c for c in n.children if isinstance(c, Node) and not c.clutter)
        return found

    named, (score, letters, article) = outermost(root), left[root]
    while named and not article:
        top = max(named, key=points.__getitem__)
        if points[top] <= score or top.letters <= letters or score >= ARTICLE and (top.named == "comments" or points[top] < 20 * score):
            break
        named.remove(top)
        wrappers = [top]
        while wrappers:
            n = wrappers.pop()
            n.named = ""
            score, letters, article = score + left[n][0], letters + left[n][1], article + left[n][2]
            for c in outermost(n):
                (wrappers if 2 * c.letters > n.letters else named).append(c)
    for n in order:
        if n.named and _is_clutter(n, signed):
            n.clutter = True
    return [n for n in named if not n.clutter]


def _title(best: Node, kept: list[Node]) -> list[Node]:
    """The last <h1> before ``best`` among the children of its ancestors, where nothing kept has one."""
    if any(n.tag == "h1" for top in kept for n in _in_order(top)):
        return []
    node = best
    while node.parent is not None:
        found = None
        for c in node.parent.children:
            if c is node:
                break
            if isinstance(c, Node) and not c.clutter and not c.named and c.tag == "h1" and c.letters:
                found = c
        if found is not None:
            return [] if found in kept else [found]
        node = node.parent
    return []


def best_containers(root: Node) -> list[Node]:
    """The container with most points, its siblings worth keeping, the blocks between them and its title, in page order."""
    named = judge_names(root)
    for n in named:
        n.clutter = True
    order = _in_order(root)
    weigh(order)
    candidates: dict[Node, None] = {}
    for p in order:
        if not p.letters or not _is_paragraph(p):
            continue
        points = _points(p)
        own = p.tag not in SCORED  # a container with text of its own gets its points itself
        node, level = (p if own else p.parent), 0
        while node is not None and level < 4:
            node.score += points / (1.0, 2.0, 6.0, 9.0)[level]
            candidates[node] = None
            node, level = node.parent, level + 1
    best, top = root, -1.0
    for node in candidates:
        score = node.score * (1.0 - node.density())
        if score > top:
            best, top = node, score
    for n in named:
        n.clutter = False
    if not candidates:
        return [root]
    weigh(_in_order(root))
    # an article is one piece, also where a part of it has most of the points
    node = best
    while node.parent is not None:
        node = node.parent
        if node.tag in ("article", "main"):
            best = node
            break
    if best.parent is None:
        return [best]
    around = [c for c in best.parent.children if isinstance(c, Node) and not c.clutter]
    kept, blocks = [], []
    for k, c in enumerate(around):
        length, links = c.letters, c.density()
        if c is best or not c.named and (c.score * (1.0 - links) >= max(ARTICLE, 0.2 * top) or c.tag == best.tag == "article" or c.tag == "p" and length > 80 and links < 0.25 or c.tag in ("h1", "h2") and length):
            kept.append(k)
        elif length and (c.tag in HEADINGS or c.tag in BLOCK and links <= MANY_LINKS):
            blocks.append(k)
    found = [around[k] for k in sorted([*kept, *(k for k in blocks if kept[0] < k < kept[-1])])]
    return [*_title(best, found), *found]


def _blocks(root: Node) -> list[str]:
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            if line := " ".join("".join(run).split()):
                blocks.append(line)
            run.clear()

    for top in best_containers(root):
        stack: list[Node | str | None] = [top]
        while stack:
            n = stack.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                run.append(n)
            elif n.tag == "br":
                run.append(" ")
            elif not n.clutter:
                if n.tag in BLOCK or n is top:
                    flush()
                    stack.append(None)
                stack.extend(reversed(n.children))
    flush()
    return blocks


def main_text(page: str | None) -> str:
    """Text of the page's article: blocks in page order, white space within a block as one blank, two line feeds between.

    A class or id names clutter as a whole name and where structure agrees (see ``judge_names``), alike at every length; where
    names, roles and hiding leave nothing of a page, they are passed over."""
    if not page:
        return ""
    return "\n\n".join(_blocks(parse(page)) or _blocks(parse(page, by_name=False)))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` of every row. Null, empty and textless pages: the empty text. Repeated rows
    stay; other columns, also one named ``text``, are ignored; an empty table gives no rows. Pages of any length are read whole."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p) for p in batch], dtype=object)

    bounded_batches(pages.sparkSession)
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], extracted(F.col(f"`{html_col}`")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
