"""Main text of web pages by minimum-cut labelling of their blocks.

A tolerant scanner cuts a page into blocks of text. A logistic classifier with fixed weights over a block's ancestors, names, links and
words gives its log-odds of being content; the two costs become capacities from and to the terminals. Neighbouring blocks and blocks of one
parent are tied by smoothness edges, weaker with more DOM levels between them. A maximum flow separates content from
boilerplate at least total cost, and the content blocks are joined in page order.

Defined cases: a null or empty page, and one without content, gives an empty text; broken, unclosed or cut-off mark-up is read as far as it goes;
a page of any length or depth takes time in proportion to its size;
other columns pass through, and ones named like added columns are refused; equal pages give equal texts; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element kinds of HTML, and name parts by which sites mark boilerplate and content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noframes".split())
# Elements inside a line whose content is not text of the page.
HIDDEN = set("svg object canvas select audio video template".split())
# The text of a formula's leaves is kept, with blanks between them.
LEAVES = set("mi mn mo ms mtext annotation".split())
INLINE = set(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br img math mrow mfrac msqrt mroot
    mstyle merror mpadded mphantom menclose mfenced msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mlabeledtr mtd maction semantics annotation-xml""".split()
) | LEAVES
BOILER_TAGS = set("nav header footer aside form menu button dialog fieldset address".split())
CONTENT_TAGS = set("article main".split())
BOILER_NAMES = set(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs
    header masthead topbar toolbar footer colophon copyright legal sidebar aside rail widget related recommended recommendations cookie cookies
    consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login form search comment comments
    commentlist respond reply replies disqus discussion reactions social share sharing pagination pager tags tagcloud skip hidden""".split()
)
CONTENT_NAMES = set("article content main post entry story body text prose".split())
# Parts that say where or in what form an element stands, not what it is: comment-list is a comment, comment-free isn't.
FRAME_NAMES = set(
    """area bar block body bottom box button buttons col container content form global group holder icon icons inner item items left link links list main media message meta
    outer page panel posts primary region results right row secondary section site slot text top trail unit wrap wrapper""".split()
)
# A class such as has-sidebar or comments-open tells about the page, not about the element.
ABOUT_PAGE = set("has no not with without open closed enabled disabled".split())

#: Logistic weights over block features.
WEIGHTS = {"bias": -0.5, "boiler": -9.0, "content_tag": 5.0, "content_name": 1.5, "links": -3.5, "words": 0.55, "sentence": 0.8, "heading": 0.6, "item": -0.8}
ADJACENT, SIBLING = 0.5, 0.35

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@dataclass
class Node:
    tag: str
    number: int
    depth: int
    boiler: bool
    content_tag: bool
    content_name: bool
    parent: Node | None = None


@dataclass
class Block:
    text: str
    link_chars: int
    node: Node
    heading: bool
    item: bool


def names_boilerplate(name: str) -> bool:
    """Whether a class or id names boilerplate: as its last part, or with nothing beside it but parts that frame it."""
    parts = [p.lower() for p in PART.findall(name) if not p.isdigit()]
    if not parts or not ABOUT_PAGE.isdisjoint(parts) or BOILER_NAMES.isdisjoint(parts):
        return False
    return parts[-1] in BOILER_NAMES or all(p in BOILER_NAMES or p in FRAME_NAMES for p in parts)


def open_node(tag: str, attributes: str, parent: Node, number: int) -> Node:
    if tag in HIDDEN or tag == "option":
        return Node(tag, number, parent.depth + 1, True, False, False, parent)
    boiler, content_name = tag in BOILER_TAGS, False
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                boiler = True
            elif name == "style":
                boiler |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
            else:
                for one in value.split():
                    boiler |= names_boilerplate(one)
                    content_name |= not CONTENT_NAMES.isdisjoint(p.lower() for p in PART.findall(one))
                boiler |= name == "role" and value.lower() in ("banner", "contentinfo", "complementary", "dialog", "menubar")
    if tag in ("body", "html"):
        boiler = False
    if tag == "header" and parent.content_tag:
        boiler = parent.boiler
    return Node(tag, number, parent.depth + 1, boiler or parent.boiler, tag in CONTENT_TAGS or parent.content_tag, content_name or parent.content_name, parent)


HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = HEADINGS | set("p div ul ol dl table article section main nav header footer aside form pre blockquote hr figure address fieldset".split())


def tokens(page: str) -> list[tuple[str, str, bool, str]]:
    """(text ahead, tag, whether it ends, attributes) of each tag, without raw text; the text after the last one has an empty tag."""
    out, at, size = [], 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            out.append((page[at:], "", False, ""))
            break
        text, at = page[at : m.start()], m.end()
        tag, ending, attributes = (m[2] or m[5] or "").lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in RAW and not ending:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            tag = ""
        if text or tag:
            out.append((text, tag, ending, attributes))
    return out


def hidden_pairs(found: list[tuple[str, str, bool, str]]) -> dict[int, int]:
    """Both ways between the places of a hidden element's tags. One without an end tag is not there: its text is read."""
    pairs: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for i, (_, tag, ending, attributes) in enumerate(found):
        if tag in HIDDEN:
            if not ending:
                if not attributes.endswith("/"):
                    opened.setdefault(tag, []).append(i)
            elif opened.get(tag):
                start = opened[tag].pop()
                pairs[start], pairs[i] = i, start
    return pairs


def blocks(page: str) -> list[Block]:
    """Blocks of text of a page, with white space single and character references decoded."""
    root = Node("", 0, 0, False, False, False)
    stack, found, number = [root], [], 0
    opened: Counter[str] = Counter()
    buffer: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                node = stack[-1]
                tags = [n.tag for n in stack[-3:]]
                found.append(Block(text, linked, node, any(t in HEADINGS for t in tags), any(t in ("li", "dd", "dt", "option") for t in tags)))
        linked = 0

    def data(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        if in_link:
            linked += len(text.strip())
        buffer.append(text)

    # Of each open hidden element: its place on the stack, its start tag, and the line that goes on after it.
    held: list[tuple[int, int, list[str], int, int]] = []

    def drop(i: int) -> None:
        """End the elements of the stack from place i on; the line around a hidden one goes on where its own element stays open."""
        nonlocal linked, in_link
        while held and held[-1][0] >= i:
            at, _, line, linked, in_link = held.pop()
            cut(at)
            buffer[:] = line
            if i < at:
                flush()
        cut(i)

    def cut(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    def push(tag: str, attributes: str) -> None:
        nonlocal number
        number += 1
        opened[tag] += 1
        stack.append(open_node(tag, attributes, stack[-1], number))

    def close(tags: set[str] | frozenset[str], stop: set[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                drop(i)
                return
            if stack[i].tag in stop:
                return

    found_tags = tokens(page)
    pairs = hidden_pairs(found_tags)
    for k, (text, tag, ending, attributes) in enumerate(found_tags):
        if text:
            data(text)
        if not tag:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if ending else 1
            elif tag in ("br", "img", "wbr"):
                buffer.append(" " if tag == "br" else "")
            elif tag in LEAVES and not ending:
                buffer.append(" ")
            continue
        if tag in HIDDEN:
            if ending:
                at = next((h[0] for h in held if h[1] == pairs.get(k)), 0)
                if at:
                    flush()
                    drop(at)
            elif k in pairs:
                held.append((len(stack), k, buffer.copy(), linked, in_link))
                buffer.clear()
                linked, in_link = 0, 0
                push(tag, attributes)
            continue
        flush()
        in_link = in_link if tag in ("div", "p") or tag in HEADINGS else 0
        if stack[-1].tag == "option":
            drop(len(stack) - 1)
        if tag in VOID:
            continue
        if ending:
            close({tag}, {"body"} if tag not in ("body", "html") else set())
            continue
        if tag in CLOSES_P:
            close({"p"}, {"div", "td", "th", "li", "article", "section", "main", "body", "blockquote", "form", "aside", "nav", "header", "footer"} | HIDDEN)
        if tag in ("li", "dt", "dd", "tr", "td", "th"):
            close({"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag != "tr" else {"tr"}, {"ul", "ol", "dl", "table", "tr"} - {tag} | HIDDEN)
        push(tag, attributes)
    flush()
    drop(1)
    flush()
    return found


def log_odds(b: Block) -> float:
    """The classifier: log-odds of content."""
    w, n = WEIGHTS, b.text.count(" ") + 1
    z = w["bias"] + w["words"] * math.log2(n)
    z += w["boiler"] * b.node.boiler + w["content_tag"] * b.node.content_tag + w["content_name"] * b.node.content_name
    z += w["links"] * min(1.0, b.link_chars / max(1, len(b.text)))
    z += w["sentence"] * (b.text[-1] in ".!?…。\"'”") + w["heading"] * b.heading + w["item"] * b.item
    return z


def levels_between(a: Node, b: Node) -> int:
    """DOM edges between two nodes. Between neighbouring blocks they are no more than the tags that stand between them."""
    steps = 0
    while a is not b:
        if a.depth < b.depth:
            a, b = b, a
        a, steps = a.parent, steps + 1
    return steps


def edges(bs: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: between neighbours, and between one parent's successive children."""
    out, last = [], {}
    for i, b in enumerate(bs):
        if i:
            out.append((i - 1, i, ADJACENT / (1 + levels_between(bs[i - 1].node, b.node))))
        parent = b.node.parent.number if b.node.parent else -1
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, SIBLING))
        last[parent] = i
    return out


def min_cut(costs: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source side of a minimum cut.

    costs are log-odds: a positive one is the capacity from the source, a negative one to the sink. Augmenting paths
    are found level by level (Dinic's algorithm).
    """
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, z in enumerate(costs):
        join(source, i, z, 0.0) if z > 0 else join(i, sink, -z, 0.0)
    for a, b, w in ties:
        join(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        tried = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if room[e] <= tiny)
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while tried[v] < len(out[v]):
                e = out[v][tried[v]]
                if room[e] > tiny and level[to[e]] == level[v] + 1:
                    break
                tried[v] += 1
            if tried[v] < len(out[v]):
                path.append(out[v][tried[v]])
                v = to[path[-1]]
            elif path:
                v = to[path.pop() ^ 1]
                tried[v] += 1
            else:
                break


def main_text(page: str | None) -> str:
    bs = blocks(page or "")
    costs = [log_odds(b) for b in bs]
    if not any(z > 0 for z in costs):
        return ""
    return "\n\n".join(b.text for b, inside in zip(bs, min_cut(costs, edges(bs))) if inside)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the mark-up, with text and n_chars (its code points)."""
    if clash := [c for c in ("text", "n_chars") if c in pages.columns and c != column]:
        raise ValueError(f"columns {clash} are already there")
    kept = [f for f in pages.schema.fields if f.name != column]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*(f.name for f in kept), "text", "n_chars"])

    return pages.mapInArrow(run, schema)
