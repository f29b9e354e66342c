"""Main text of web pages by minimum cuts."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"</?[a-zA-Z]")
STOP = re.compile(r">|=\s*([\"'])")
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
WORDS = re.compile(r"[a-z]+")

# fixed values: elements of HTML
HIDDEN = frozenset(
    "script style noscript template iframe object canvas head title desc annotation select textarea button datalist".split()
)  # never shown, shown in place of something else, or controls
RAW = frozenset("script style textarea title".split())
IN_HEAD = frozenset("head base basefont bgsound link meta noscript template".split()) | RAW
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle mpadded msub msup msubsup munder mover munderover mtable mtr mtd semantics "
    "svg g text tspan path rect circle ellipse line polyline polygon defs use".split()
)
SPACED = frozenset("br text mtd".split())  # INLINE, but white space to a reader
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav header footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
    "footer form header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo "
    "related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget "
    "complementary contentinfo search alert".split()
)
VAGUE_WORDS = frozenset(
    "alert banner comment disclaimer footer form header login notice popup reply respond search share".split()
)  # of CHROME_WORDS, those that content bears too
MAIN_WORDS = frozenset("article content entry main post story".split())
WHOLE = frozenset("html body main article".split())  # their classes speak of the page, not of its text
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LINES = HEADINGS | {"p"}

HARD = 1_000_000  # capacity of what the elements say
MARK, VAGUE = 700, 350  # capacity of what a class, id or role says, if next to no text lies below it
MAIN_COST = 400  # capacity of being in an article, or not in the article of a page that has one
MOST = 250  # of the classifier on one side
SCALE = 40  # capacity of a log odds of one
PRIOR = 20  # labelled blocks that weights before fitting count for
FIT_PAGES = 1000
ENDS = frozenset(".!?…:;。！？\"'”»)")  # last signs of sentences

Weights = dict[tuple[str, int], int]


@dataclass
class Block:
    text: str
    depth: int  # open elements
    shared: int  # of them, those open since the block before
    parent: int  # number of the element around the innermost one
    links: int  # characters inside links
    chrome: bool
    main: bool
    heading: bool
    mark: int = -1  # place of the innermost marked element around


def marks_of(tag: str, start: str) -> tuple[int, bool]:
    """Capacity of the classes, id and role of a start tag as boilerplate, and whether they say main text.

    A name counts as boilerplate if all its parts do (or say main text, as in ``post-comments``),
    so that ``no-sidebar`` or ``comments-open`` say nothing.
    """
    if tag in WHOLE:
        return 0, False
    weight, main = 0, False
    for _, value in ATTRIBUTE.findall(start):
        for name in value.lower().strip("\"'").split():
            parts = set(WORDS.findall(name))
            chrome = parts & CHROME_WORDS
            if chrome and parts <= CHROME_WORDS | MAIN_WORDS:
                weight = max(weight, VAGUE if tag in LINES or chrome <= VAGUE_WORDS else MARK)
            elif parts & MAIN_WORDS and not chrome:
                main = True
    return weight, main


def pieces_of(page: str) -> Iterator[tuple[str, int]]:
    """Tags and stretches of text with the places where they end; comments are left out.

    A tag ends at the first ``>`` outside of quoted values. The first tag that has none shows that a
    quote stays open; from there on quotes are not minded, so that a page is read in linear time.
    A place may be sent back to go on from there.
    """
    at, size, last, quotes = 0, len(page), page.rfind(">"), True
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            at = size if end < 0 else end + 3
            continue
        elif at < last and page[at + 1] in "!?":
            at = page.find(">", at) + 1
            continue
        elif at < last and TAG.match(page, at):
            end = at + 2
            while quotes:
                stop = STOP.search(page, end)
                if stop is None:
                    quotes = False
                elif stop.group() == ">":
                    end = stop.end()
                    break
                else:
                    end = page.find(stop.group(1), stop.end()) + 1
                    quotes = end > 0
            if not quotes:
                end = page.find(">", at) + 1
        else:  # a sign, no tag
            end = page.find("<", at + 1)
            end = size if end < 0 else end
        moved = yield page[at:end], end
        at = end if moved is None else moved


def blocks_of(page: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """Blocks of text in page order with what the elements around them say, and the marked elements.

    A marked element is its capacity and the place of the next marked one around it. An element that
    hides its content ends with its own end tag or that of an element around it.
    """
    found: list[Block] = []
    marked: list[tuple[int, int]] = []
    stack: list[tuple[str, int, bool, bool, int]] = []  # name, number, chrome, main, mark
    names: Counter[str] = Counter()  # of the stack
    number, links, open_links, shared = 0, 0, 0, 0
    parts: list[str] = []
    hidden: str | None = None
    inside: Counter[str] = Counter()  # elements open in the hidden one
    in_head = False

    def close() -> None:
        nonlocal links, shared
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                top = stack[-1] if stack else ("", 0, False, False, -1)
                parent = stack[-2][1] if len(stack) > 1 else 0
                heading = any(x[0] in HEADINGS for x in stack[-2:])
                found.append(Block(text, len(stack), shared, parent, links, top[2], top[3], heading, top[4]))
                shared = len(stack)
            parts.clear()
        links = 0

    def leave(k: int) -> None:
        nonlocal shared
        for x in stack[k:]:
            names[x[0]] -= 1
        del stack[k:]
        shared = min(shared, k)

    pieces = pieces_of(page)
    moved: int | None = None
    while True:
        try:
            piece, at = pieces.send(moved)
        except StopIteration:
            break
        moved = None
        name = NAME.match(piece) if piece[-1] == ">" else None
        if name is None:
            if hidden == "head" and piece.strip():  # its end tag may be left out
                hidden = None
            if hidden is None:
                parts.append(piece)
                links += len(piece) if open_links else 0
            continue
        tag, closing, empty = name.group(1).lower(), piece[1] == "/", piece.endswith("/>")
        if tag in RAW and not closing and not empty:  # no tags up to its end tag
            end = END[tag].search(page, at)
            moved = end.start() if end else len(page)
        if hidden == "head" and not closing:
            if tag not in IN_HEAD:
                hidden = None
            elif tag in ("noscript", "template") and not empty:
                hidden, in_head = tag, True
                inside.clear()
                continue
        if hidden is not None:
            if not closing:
                inside[tag] += not empty and tag not in VOID
                continue
            if inside[tag] > 0:
                inside[tag] -= 1
                continue
            if tag != hidden and not names[tag]:
                continue
            own = tag == hidden
            hidden = "head" if in_head and own else None
            in_head = False
            if own:
                continue
        if tag in HIDDEN:
            if not closing and not empty:
                hidden = tag
                inside.clear()
            continue
        if tag in INLINE:
            if tag == "a":
                open_links = max(0, open_links + (-1 if closing else 1))
            elif tag in SPACED:
                parts.append(" ")
            continue
        if closing and not names[tag] and tag != "p":  # closes nothing
            continue
        close()
        if closing:
            if names[tag]:
                leave(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            if tag in CHROME:
                open_links = 0
            continue
        if tag in VOID:
            continue
        if stack and (stack[-1][0] == "p" or (stack[-1][0] == tag and tag in ("li", "tr", "td", "dt", "dd"))):
            leave(len(stack) - 1)
        weight, main = marks_of(tag, piece)
        above = stack[-1] if stack else ("", 0, False, False, -1)
        chrome = above[2] or (tag in CHROME and not (tag == "header" and above[3]))
        number += 1
        mark = above[4]
        if weight:
            marked.append((weight, mark))
            mark = len(marked) - 1
        stack.append((tag, number, chrome, above[3] or tag in MAIN or main, mark))
        names[tag] += 1
    close()
    return found, marked


def marked_costs(blocks: list[Block], marked: list[tuple[int, int]]) -> list[int]:
    """For each block the greatest capacity of the marked elements around it, less the more text lies below them."""
    below = [0] * len(marked)  # characters
    for block in blocks:
        if block.mark >= 0:
            below[block.mark] += len(block.text)
    for k in range(len(marked) - 1, -1, -1):
        if marked[k][1] >= 0:
            below[marked[k][1]] += below[k]
    total = max(1, sum(len(b.text) for b in blocks if not b.chrome))
    cost: list[int] = []
    for k, (weight, around) in enumerate(marked):
        own = weight * max(0, total - below[k]) ** 2 // total**2
        cost.append(max(own, cost[around]) if around >= 0 else own)
    return [cost[b.mark] if b.mark >= 0 else 0 for b in blocks]


def features(block: Block) -> list[tuple[str, int]]:
    """What the classifier sees of a block: size, share of links, last sign, heading, words of a usual length."""
    text = block.text
    size = len(text)
    return [
        ("size", min(size, 1023).bit_length()),
        ("links", int(4 * min(1.0, block.links / max(1, size)))),
        ("sentence", int(text[-1] in ENDS)),
        ("heading", int(block.heading)),
        ("words", min(4, size // (text.count(" ") + 1) // 4)),
    ]


def before(feature: str, value: int) -> int:
    """Weight of a value that no labelled block has shown."""
    return {"size": 12 * (value - 4), "links": -60 * value, "sentence": 15 if value else -5, "heading": 60 * value}.get(feature, 0)


def fitted(counts: dict[tuple[str, int], tuple[int, int]]) -> Weights:
    """Weights from ``(content, boilerplate)`` counts of blocks per value: scaled log odds, ``before`` as ``PRIOR`` more blocks."""
    totals: dict[str, tuple[int, int]] = {}
    for (feature, _), (content, boilerplate) in counts.items():
        so_far = totals.get(feature, (0, 0))
        totals[feature] = (so_far[0] + content, so_far[1] + boilerplate)
    weights = {}
    for (feature, value), (content, boilerplate) in counts.items():
        known = 1 / (1 + math.exp(-before(feature, value) / SCALE))
        share = (content + PRIOR * known) / (totals[feature][0] + PRIOR)
        other = (boilerplate + PRIOR * (1 - known)) / (totals[feature][1] + PRIOR)
        weights[feature, value] = round(SCALE * math.log(share / other))
    return weights


def label_of(block: Block) -> int | None:
    """1 inside an article without marks, 0 inside menus, footers and the like, none elsewhere."""
    if block.chrome:
        return 0
    return 1 if block.main and block.mark < 0 else None


def fit(pages: DataFrame, id_col: str, url_col: str, html_col: str, fit_pages: int = FIT_PAGES) -> Weights:
    """Weights learned from the blocks of about ``fit_pages`` pages, chosen by a hash of id and address.

    Pages label their own blocks by structure. Tasks count blocks per value; the sums, at most some
    forty rows, make the weights.
    """
    share = fit_pages / max(1, pages.count())
    if share < 1:
        draw = F.pmod(F.xxhash64(F.lit(7), id_col, url_col), F.lit(1 << 30))
        pages = pages.where(draw < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int, int]] = Counter()
        for batch in batches:
            for page in batch.column(0):
                for block in blocks_of(page.as_py() or "")[0]:
                    label = label_of(block)
                    if label is not None:
                        counts.update((*x, label) for x in features(block))
        yield pa.RecordBatch.from_pylist(
            [{"feature": x, "value": v, "label": y, "n": n} for (x, v, y), n in counts.items()],
            pa.schema([("feature", pa.string()), ("value", pa.int32()), ("label", pa.int32()), ("n", pa.int64())]),
        )

    cells = pages.select(html_col).mapInArrow(run, "feature string, value int, label int, n long")
    sums = cells.groupBy("feature", "value").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("content"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("boilerplate"),
    )
    return fitted({(r.feature, r.value): (r.content, r.boilerplate) for r in sums.collect()})


def costs(block: Block, any_main: bool, marked: int = 0, weights: Weights | None = None) -> tuple[int, int]:
    """Capacity from the content side and to the boilerplate side: what a wrong label would cost.

    The classifier's weights add up to ``MOST`` at most on either side, so that alone they do not
    outvote an article or a mark.
    """
    if block.chrome:
        return 0, HARD
    weight = sum((weights or {}).get(x, before(*x)) for x in features(block))
    content = min(MOST, max(0, weight))
    boilerplate = min(MOST, max(0, -weight))
    if block.main:
        content += MAIN_COST
    elif any_main:
        boilerplate += MAIN_COST
    return content, boilerplate + marked


def nearness(a: Block, b: Block) -> int:
    """Smoothness between neighbours: less with the steps from one to the other in the tree of elements."""
    return 10 + 60 // max(1, a.depth + b.depth - 2 * b.shared)


def content_side(capacities: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Blocks on the source side of a minimum cut (Dinic's flows on the residual graph)."""
    n = len(capacities)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for k, (content, boilerplate) in enumerate(capacities):
        spare = content - boilerplate  # flow straight through is sent at once
        if spare > 0:
            add(source, k, spare, 0)
        elif spare < 0:
            add(k, sink, -spare, 0)
    for a, b, weight in edges:
        add(a, b, weight, weight)
    while True:
        depth = [-1] * (n + 2)
        depth[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 0 and depth[to[e]] < 0:
                    depth[to[e]] = depth[a] + 1
                    queue.append(to[e])
        if depth[sink] < 0:
            return [depth[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(i for i, e in enumerate(path) if room[e] == 0)
                at = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[at] < len(out[at]):
                e = out[at][turn[at]]
                if room[e] > 0 and depth[to[e]] == depth[at] + 1:
                    path.append(e)
                    at = to[e]
                    break
                turn[at] += 1
            else:
                if at == source:
                    break
                depth[at] = -1
                at = to[path.pop() ^ 1]


def main_text(page: str | None, weights: Weights | None = None) -> str:
    """Blocks labelled content, joined by empty lines; without fitted weights those before fitting serve."""
    blocks, marked = blocks_of(page or "")
    if not blocks:
        return ""
    any_main = any(b.main and not b.chrome for b in blocks)
    edges = [(k, k + 1, nearness(a, b)) for k, (a, b) in enumerate(zip(blocks, blocks[1:]))]
    last: dict[int, int] = {}
    for k, block in enumerate(blocks):  # blocks of one parent that others part
        if block.parent in last and last[block.parent] < k - 1:
            edges.append((last[block.parent], k, 10))
        last[block.parent] = k
    sides = [costs(b, any_main, m, weights) for b, m in zip(blocks, marked_costs(blocks, marked))]
    chosen = content_side(sides, edges)
    return "\n\n".join(b.text for b, keep in zip(blocks, chosen) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fit_pages: int = FIT_PAGES) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per page.

    The page is read whole. Blocks are labelled content or boilerplate by a minimum cut: a
    classifier of length, links, last sign, heading and words, fitted on about ``fit_pages`` pages,
    gives the terminal capacities with the marks (a class, id or role weighs
    less the more of the text lies below it); blocks next to each other and blocks of one parent
    are tied, the more the nearer they lie in the tree. Formulas and texts of drawings are text; what only
    stands in for an object, a canvas or a script is not. Null and empty pages have an empty text; null ids and
    addresses pass through; repeated rows repeat; an empty table gives no rows; other columns are
    not read.
    """

    weights = fit(pages, id_col, url_col, html_col, fit_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    schema = f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long"
    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)
