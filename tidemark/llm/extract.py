"""Main text of web pages by minimum-cut labelling of blocks.

A page becomes blocks (runs of text between block-level tags) below a tree of containers. A linear classifier on a
block's ancestors, names, link share and wording gives the cost of calling it content and of calling it boilerplate;
the difference is its capacity to the source or the sink. Blocks that follow each other and blocks that share a
container are tied by smoothness edges, the latter over a node for the container. The minimum cut of this graph is
the labelling of least total cost; blocks on the source side are the text.

Most nodes are settled before any flow runs: one whose terminal capacity is at least the sum of its edges takes
its own side in some minimum cut, and its edges then become terminal capacity of its neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_small_batches

# Where a comment, declaration or tag may begin.
_OPENS = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOPS = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")
# Names that say how a box is laid out rather than what it is.
_LAYOUT = re.compile(r"\b(?:with|without|has|no|show|hide|is)[-_][\w-]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

# Element kinds of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is text up to their end tag, or to the end of the page without one.
RAW = frozenset("script style textarea title iframe".split())
# Elements whose content isn't shown as text; they stand in a line and end no block.
UNSHOWN = frozenset("svg object select template noscript".split())
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW | UNSHOWN}
# Block-level elements that stand in no select and no svg: one left open ends where they begin.
BREAKS_OUT = frozenset("p h1 h2 h3 h4 h5 h6 article main section header footer nav aside ul ol dl table blockquote pre form body".split())
CLOSED_BY_SELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table tbody thead tfoot menu section article div".split())

# Costs in hundredths: what an element or a word of its class, id or role says for (+) or against (-) content.
ELEMENTS = {
    "article": 300, "main": 300, "nav": -600, "footer": -600, "aside": -600, "form": -600, "button": -600, "menu": -500, "dialog": -600,
    "fieldset": -500, "header": -350, "address": -150, "figcaption": 0, "blockquote": 50, "pre": 50,
}
NAMES = {
    w: cost
    for cost, words in {
        -600: "nav navbar navigation menu footer sidebar aside ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo "
        "promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login comment comments "
        "commentlist disqus reply replies respond discussion share sharing social breadcrumb breadcrumbs pagination pager toolbar search "
        "related recommend recommended recommendations copyright disclaimer widget skip paywall complementary contentinfo "
        "kommentar kommentare leserkommentare werbung anzeige anzeigen seitenleiste fusszeile fußzeile hinweis teilen anmelden suche verwandte datenschutz "
        "commentaire commentaires publicité publicite annonce annonces bandeau pied partager partage recherche abonnement connexion "
        "comentario comentarios publicidad anuncio anuncios aviso compartir buscar búsqueda busqueda suscripción suscripcion relacionados relacionadas",
        -350: "header masthead topbar top bottom tags taglist byline legal links rail outbrain taboola "
        "kopfzeile cabecera encabezado",
        250: "article articlebody content main post entry story body text artikel inhalt beitrag contenu contenido articulo artículo",
    }.items()
    for w in words.split()
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REST = 20
ADJACENT, ACROSS, SHARED, NESTED = 60, 25, 50, 30


class Tags:
    """Comments, declarations and tags of a page in order, in time linear in its length, however broken it is.

    A tag ends at the first `>` outside quotes or, where a quote is never closed, at the first `>` of all. A quote from
    which no end of a tag was reached is remembered, so no stretch is gone over once per tag. Without a `>` all is text.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.lost: set[int] = set()

    def _end(self, at: int) -> int:
        """Place after the `>` that ends the tag whose name ends at `at`; one exists."""
        page, tried, here = self.page, [], at
        while stop := _STOPS.search(page, here):
            if stop[0] == ">":
                return stop.end()
            quote = stop.start()
            closed = -1 if quote in self.lost else page.find(stop[0], quote + 1)
            tried.append(quote)
            if closed < 0:
                break
            here = closed + 1
        self.lost.update(tried)
        return page.find(">", at) + 1

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether an end tag, name in lower case, attributes) of the first at or after `at`; no name: no tag."""
        while m := _OPENS.search(self.page, at):
            if m[0] == "<!--":
                end = self.page.find("-->", m.end())
                return m.start(), len(self.page) if end < 0 else end + 3, False, "", ""
            if m.end() > self.last:
                at = m.end()
                continue
            if not m[2]:
                return m.start(), self.page.find(">", m.end()) + 1, False, "", ""
            end = self._end(m.end())
            return m.start(), end, bool(m[1]), m[2].lower(), self.page[m.end() : end - 1]
        return None


class Block:
    __slots__ = ("pieces", "text", "linked", "cost", "parent", "heading")

    @property
    def share(self) -> float:
        """Share of the letters that stand in links."""
        return min(1.0, self.linked / len(self.text))

    def __init__(self, parent: int, heading: bool):
        self.pieces: list[str] = []
        self.text = ""
        self.linked = self.cost = 0
        self.parent, self.heading = parent, heading


class Box:
    """A container: its element, what the names cost, and whether a form is around it."""

    __slots__ = ("tag", "names", "parent", "form", "cost", "inside")

    def __init__(self, tag: str, names: int, parent: int, form: bool):
        self.tag, self.names, self.parent, self.form = tag, names, parent, form
        self.cost, self.inside = 0, False


def _named(attributes: str) -> int | None:
    """Cost of an element's names; None where it is hidden."""
    cost = 0
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        name = name.lower()
        if name == "hidden" and not value or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return None
        if name in ("class", "id", "role", "itemprop"):
            said = [NAMES.get(w, 0) for w in _WORD.findall(_CAMEL.sub("-", _LAYOUT.sub(" ", value)).lower())]
            cost = min([cost, *said]) if min(said, default=0) < 0 else max([cost, *said])
    return cost


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """Blocks in page order, and the parent of each container (container 0 is the page)."""
    out: list[Block] = []
    boxes = [Box("", 0, -1, False)]
    # Open elements: tag, container, hidden (2: in an element of UNSHOWN, 3: in svg markup).
    stack: list[tuple[str, int, int]] = [("", 0, 0)]
    opened: Counter[str] = Counter()  # how many elements of a kind are open
    ahead: dict[str, int] = {}
    tags = Tags(page)
    block: Block | None = None
    links = 0
    at = 0

    def text(piece: str) -> None:
        nonlocal block
        if stack[-1][2]:
            return
        words = piece.split()
        if block is None:
            if not words:
                return
            block = Block(stack[-1][1], any(s[0] in _HEADINGS for s in stack[-3:]))
            out.append(block)
        block.pieces.append(piece)
        if links:
            block.linked += sum(map(len, words))

    def pop(n: int) -> None:
        nonlocal block, links
        for tag, *_, hidden in stack[n:]:
            opened[tag] -= 1
            if tag == "a":
                links -= 1
            if tag not in INLINE and hidden < 2:
                block = None
        del stack[n:]

    def ends_at(tag: str) -> int:
        """Where the next end tag of `tag` stops; -1 without one."""
        if 0 <= ahead.get(tag, 0) <= at:
            end = _END[tag].search(page, at)
            ahead[tag] = end.end() if end else -1
        return ahead[tag]

    def push(tag: str, container: int, hidden: int) -> None:
        opened[tag] += 1
        stack.append((tag, container, hidden))

    while found := tags.after(at):
        start, end, closing, tag, attributes = found
        if start > at:
            text(page[at:start])
        at = end
        if not tag:
            continue
        # In svg markup no text is raw.
        if tag in RAW and not closing and stack[-1][2] < 3:
            at = ends_at(tag)
            if at < 0:
                at = len(page)
            continue
        if not closing and stack[-1][2] > 1 and (tag == "select" or tag in BREAKS_OUT):
            # What is still open of svg markup and of a select ends here.
            n = len(stack)
            while stack[n - 1][2] == 3:
                n -= 1
            pop(next((i for i in range(1, n) if stack[i][0] == "select" and stack[i][2] > 1), n))
        if not closing and stack[-1][2] > 1:
            state = 3 if tag == "svg" else 2 if tag == "foreignobject" else stack[-1][2]
            if tag not in VOID and not (attributes.endswith("/") and 3 in (state, stack[-1][2])):
                links += tag == "a"
                push(tag, stack[-1][1], state)
            continue
        if closing:
            if tag == "br" or tag == "p" and not opened["p"]:
                block = None if tag == "p" else block
                continue
            for i in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag == "br":
            if block is not None:
                block.pieces.append(" ")
            continue
        if tag in UNSHOWN:
            # One that is never closed says nothing about what follows it, but svg and select end by other tags.
            if not (tag == "svg" and attributes.endswith("/")) and (tag in ("svg", "select") or ends_at(tag) >= 0):
                push(tag, stack[-1][1], 3 if tag == "svg" else 2)
            continue
        if tag not in INLINE:
            block = None
            # An open paragraph ends where a block-level element begins; list items and cells end at their like.
            ends = CLOSED_BY_SELF.get(tag, set()) | {"p"}
            for i in range(len(stack) - 1 if any(opened[e] for e in ends) else 0, 0, -1):
                if stack[i][0] in ends:
                    pop(i)
                    break
                if stack[i][0] in LISTS:
                    break
        elif tag == "img":
            continue
        if tag in VOID:
            continue
        _, container, hidden = stack[-1]
        if tag not in INLINE:
            names = _named(attributes) if attributes else 0
            if names is None:
                hidden = True
            boxes.append(Box(tag, names or 0, container, opened["form"] > 0 and tag in ("article", "main")))
            container = len(boxes) - 1
        elif attributes and _named(attributes) is None:
            hidden = True
        if tag == "a":
            links += 1
        push(tag, container, hidden)
    if at < len(page):
        text(page[at:])
    for b in out:
        b.text = " ".join(html.unescape("".join(b.pieces)).split())
    out = [b for b in out if b.text]
    weigh(out, boxes)
    return out, [x.parent for x in boxes]


def weigh(found: list[Block], boxes: list[Box]) -> None:
    """Put the costs of boxes and blocks: elements and names, summed from the page inwards.

    Names that speak against content say it of a part of the page. On html and body they are layout, and so they are on
    a box with most of the page's text beside which nothing is content: no text that counts as content by its marks,
    and no more of other text than 1 in REST letters. Such boxes hold each other, so each is judged once those around it are.
    """
    held = [0] * len(boxes)
    for b in found:
        held[b.parent] += len(b.text)
    for i in range(len(boxes) - 1, 0, -1):
        held[boxes[i].parent] += held[i]
    # Wide boxes in order, and for each box how many of them are around it, itself included.
    wide = [i for i, x in enumerate(boxes) if i and x.names < 0 and 2 * held[i] > held[0]]
    place = {i: k + 1 for k, i in enumerate(wide)}
    level = [0] * len(boxes)
    groups: list[list[int]] = [[] for _ in range(len(wide) + 1)]
    for i, x in enumerate(boxes):
        level[i] = place.get(i, level[x.parent] if i else 0)
        groups[level[i]].append(i)
    texts: list[list[Block]] = [[] for _ in groups]
    for b in found:
        texts[level[b.parent]].append(b)
    beside, marked = 0, False
    for k, group in enumerate(groups):
        for i in group:
            x, outer = boxes[i], boxes[boxes[i].parent] if i else boxes[0]
            names = x.names
            if names < 0 and (x.tag in ("html", "body") or k and i == wide[k - 1] and not marked and REST * beside <= held[i]):
                names = 0
            own = ELEMENTS.get(x.tag, 0)
            if x.tag == "header" and outer.inside:
                own = 0
            if x.form:
                own -= ELEMENTS["form"]  # a form around the whole page
            # The heading part of an article is not the page's.
            own += 0 if names == -350 and outer.inside else names
            # Nested boxes of one kind say it once.
            x.cost = max(min(outer.cost + own, 600), -1200)
            x.inside = outer.inside or x.tag in ("article", "main") and own > 0
        for b in texts[k]:
            b.cost = boxes[b.parent].cost
            if not b.heading and score(b) > 0:
                beside += len(b.text)
                marked = marked or b.cost > 0


def score(b: Block, brief: int = 30) -> int:
    """What speaks for content less what speaks against it, in hundredths; `brief` is held against a line for being one."""
    n = len(b.text)
    value = b.cost - int(400 * b.share)
    ends = b.text[-1] in ".!?:;\"'”»…。)"
    value += min(n, 200) // 2 - (0 if b.heading else brief)
    value += 60 if ends else -40 if brief and not b.heading else 0
    if n < 60 and re.search(r"(?i)©|\bcopyright\b|\ball rights reserved\b", b.text):
        value -= 300
    return value


def minimum_cut(terminal: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """True for the nodes on the source side. `terminal`: capacity from the source (+) or to the sink (-)."""
    near: list[dict[int, int]] = [{} for _ in terminal]
    for (a, b), c in edges.items():
        if a != b and c:
            near[a][b] = near[a].get(b, 0) + c
            near[b][a] = near[b].get(a, 0) + c
    side: list[bool | None] = [None] * len(terminal)
    terminal = list(terminal)
    tied = [sum(x.values()) for x in near]
    todo = deque(range(len(terminal)))
    while todo:
        v = todo.popleft()
        if side[v] is not None or abs(terminal[v]) < tied[v]:
            continue
        side[v] = terminal[v] > 0
        for u, c in near[v].items():
            if side[u] is None:
                terminal[u] += c if side[v] else -c
                tied[u] -= c
                todo.append(u)
    rest = [v for v, s in enumerate(side) if s is None]
    if not rest:
        return [bool(s) for s in side]
    # Maximum flow over what is left, along shortest paths (breadth first), with residual capacities.
    left = {v: {u: c for u, c in near[v].items() if side[u] is None} for v in rest}
    excess = {v: max(terminal[v], 0) for v in rest}
    want = {v: max(-terminal[v], 0) for v in rest}
    while True:
        came: dict[int, int | None] = {v: None for v in rest if excess[v]}
        queue, end = deque(came), None
        while queue:
            v = queue.popleft()
            if want[v]:
                end = v
                break
            for u, c in left[v].items():
                if c and u not in came:
                    came[u] = v
                    queue.append(u)
        if end is None:
            break
        path, v = [end], end
        while came[v] is not None:
            v = came[v]
            path.append(v)
        path.reverse()
        flow = min([excess[path[0]], want[end], *(left[a][b] for a, b in zip(path, path[1:]))])
        excess[path[0]] -= flow
        want[end] -= flow
        for a, b in zip(path, path[1:]):
            left[a][b] -= flow
            left[b][a] = left[b].get(a, 0) + flow
    for v in rest:
        side[v] = v in came
    return [bool(s) for s in side]


def main_text(page: str | None) -> str:
    """The blocks on the content side, one a line. An empty or NULL page, or one without text, gives the empty text."""
    if not page:
        return ""
    found, parents = blocks(page)
    if not found:
        return ""
    n = len(found)
    edges: dict[tuple[int, int], int] = {}
    for i, b in enumerate(found):
        # Links and prose are unlike: outside of what is marked as content, the less alike blocks are, the looser they are tied.
        edges[i, n + b.parent] = SHARED if b.cost > 0 else int(SHARED * (1 - b.share))
        if i:
            near = found[i - 1]
            most = ADJACENT if near.parent == b.parent or near.cost == b.cost else ACROSS
            edges[i - 1, i] = most if b.cost > 0 else int(most * (1 - abs(near.share - b.share)))
    for c, p in enumerate(parents):
        if p >= 0:
            edges[n + p, n + c] = NESTED
    # On a page of short lines alone nothing may be content; its lines are then judged without being held short.
    for brief in (30, 0):
        content = minimum_cut([score(b, brief) for b in found] + [0] * len(parents), edges)[:n]
        if any(content):
            break
    return "\n".join(b.text for b, c in zip(found, content) if c)


def extract(pages: DataFrame, html_column: str = "html", out: str = "text") -> DataFrame:
    """`pages` with the main text in place of the html; other columns stay, one called `out` is replaced.

    Every page is judged on its own from its whole html; NULL html gives the empty text. Repeated rows give repeated rows.
    """
    kept = [c for c in pages.columns if c not in (html_column, out)]
    rows = pages.select(*kept, pages[html_column].cast("string").alias(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p) for p in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], batch.schema.names)

    return in_small_batches(rows).mapInArrow(run, rows.schema)
