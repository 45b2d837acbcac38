"""Main text of web pages by minimum cut.

The page becomes a row of text blocks. A logistic classifier over link density, length,
punctuation and the names of the enclosing elements says how likely a block is content; its
costs are the capacities to the two terminals. Neighbouring blocks, and blocks of one parent,
are joined by smoothness edges, the stronger the closer they are in the element tree. The
minimum cut labels all blocks of a page at once.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.llm.common import put

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN = re.compile(r"[^>\"']*")
HINTED = re.compile(r"(?<![\w-])(class|id|role|itemprop|aria-label|hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Element names with a fixed role.
SKIPPED = frozenset("script style noscript template svg iframe object canvas audio video head title select option datalist textarea map".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
CONTROLS = frozenset("input select textarea button".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt mstyle msub msup mtext nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
LINKS = frozenset("a button".split())  # what stands in them speaks against content
NEVER = frozenset("nav footer aside menu dialog".split())
CLOSES_P = frozenset("address article aside blockquote details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tr td th ul".split())
SCOPED = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("select",))}
# Words in class, id or role that speak for boilerplate or for content.
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments comentarios commentlist cookie cookies copyright consent disqus dialog disclaimer "
    "discussion footer form gdpr header hidden login masthead menu message meta modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion "
    "recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar warning widget alert navbox "
    "complementary contentinfo".split()
)
# Those of them that names of content hold too: they only weigh against a block, and only in names of nothing else.
WEAK = frozenset("alert copyright dialog disclaimer discussion form header message meta related replies reply respond search tags toc warning".split())
STRONG = BOILER - WEAK
# Words of layout, which say nothing beside others.
GENERIC = frozenset("area article bar block body bottom box col column container content entry group inner item items left list main outer page panel post right row section site top wrap wrapper".split())
CONTENT = frozenset("article articlebody content entry main maincontent post story text".split())
# Words that make a class name speak of a state, such as has-sidebar or no-comments.
STATES = frozenset("allow allowed closed disabled enabled free has hide is no not off on open show supports with without".split())
# A heading of content, such as article-header, is content.
HEADINGS = frozenset("header heading headline title".split())
HEADED = frozenset("article content entry post story".split())

POSITIVE = frozenset({"article", "main", "!content"})

#: Log-odds of the block classifier.
WEIGHTS = {"bias": -0.4, "article": 2.6, "main": 1.6, "boiler": -6.0, "weak": -3.5, "never": -8.0, "heading": 0.8, "paragraph": 0.9, "list": -0.3, "links": -3.2, "words": 0.35, "stops": 0.35}
#: A form with fewer characters of text for each of its controls is one to fill in; others are mere wrappers.
FORM_CHARS = 200
#: Smoothness of neighbours with the same parent; falls by half with each step in the tree.
SMOOTH = 1.5


class Node:
    """An element that may hold blocks."""

    __slots__ = ("depth", "hints", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, hints: frozenset):
        self.tag, self.parent, self.hints = tag, parent, hints
        self.depth = parent.depth + 1 if parent else 0


class Block:
    __slots__ = ("filled_in", "linked", "node", "parts", "text")

    def __init__(self, node: Node):
        self.node, self.parts, self.linked, self.filled_in = node, [], 0, False

    @property
    def tag(self) -> str:
        return self.node.tag

    @property
    def hints(self) -> frozenset:
        return self.node.hints


def tokens(page: str) -> Iterator[tuple[str, bool, str, str, int]]:
    """(text before, is an end tag, name, attributes, end) of each tag; the name of what follows
    the last one is empty.

    A > between quotes doesn't end a tag. A quote that nothing closes is a character like others,
    and behind a tag that never ends no quotes count, so that no place is read twice. The caller
    sends the position to go on from.
    """
    at, start, size = 0, 0, len(page)
    last = {q: page.rfind(q) for q in "\"'>"}
    quotes = True
    while True:
        start = page.find("<", start)
        if start < 0 or start > last[">"] and not page.startswith("<!--", start):
            yield page[at:], False, "", "", size
            return
        end, name, close = -1, "", False
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = size if end < 0 else end + 3
        elif page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start) + 1
        else:
            close = page[start + 1 : start + 2] == "/"
            m = NAME.match(page, start + 1 + close)
            if m is None:
                start += 1
                continue
            name, k = m.group().lower(), m.end()
            while quotes:
                k = PLAIN.match(page, k).end()
                if k >= size or page[k] == ">":
                    break
                k = page.find(page[k], k + 1) + 1 if k < last[page[k]] else k + 1
            if k >= size:
                quotes = False
            end = (k if quotes else page.find(">", m.end())) + 1
        attrs = page[m.end() : end - 1] if name else ""
        go_on = yield page[at:start], close, name, attrs, end
        at = start = end if go_on is None else go_on


def named_role(value: str, spelled: bool = False) -> str:
    """What the names in a class, id or label say: "!boiler", "!weak", "!content" or nothing.

    ``spelled``: the names may be made of the words of a text, as ids are of headlines. They speak
    for boilerplate only if they hold nothing else.
    """
    role = ""
    for name in value.split():
        words = {w.lower() for w in PART.findall(name)}
        if words & STATES or (words & HEADINGS and words & HEADED and not (words - HEADINGS) & BOILER):
            continue
        pure = not words - BOILER - GENERIC
        if words & STRONG and (pure or not spelled):
            return "!boiler"
        if words & WEAK and pure:
            role = "!weak"
        elif words & CONTENT and not role and not (spelled and words - CONTENT - GENERIC):
            role = "!content"
    return role


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; lenient about tags that are missing or crossed."""
    out: list[Block] = []
    stack: list[tuple[str, Node]] = []  # (tag, the element that blocks directly in it belong to)
    where: dict[str, list[int]] = {}  # places of each tag in the stack
    outer: list[int] = []  # places of the elements that aren't inline
    root = Node("", None, frozenset())
    skipped = links = 0
    current: Block | None = None
    forms: list[int] = []  # controls of each form

    def text(s: str) -> None:
        nonlocal current
        if not s or skipped:
            return
        if current is None:
            if s.isspace():
                return
            current = Block(stack[-1][1] if stack else root)
            out.append(current)
        current.parts.append(s)
        if links:
            current.linked += len(s.strip())

    def pop(k: int) -> None:
        nonlocal skipped, links, current
        for tag, _ in reversed(stack[k:]):
            where[tag].pop()
            skipped -= tag in SKIPPED
            links -= tag in LINKS
            if tag not in INLINE:
                outer.pop()
                current = None
        del stack[k:]

    def place(tag: str) -> int:
        """Of the innermost open element of a name; -1 for none."""
        found = where.get(tag)
        return found[-1] if found else -1

    scan = tokens(page)
    go_on = None
    while True:
        try:
            before, close, tag, attrs, end = scan.send(go_on)
        except StopIteration:
            break
        go_on = None
        text(before)
        if not tag:
            continue
        if close:
            if tag == "br":
                text(" ")
            elif (k := place(tag)) >= 0 and (tag not in INLINE or not outer or k > outer[-1]):
                pop(k)  # an inline end tag doesn't end the block around it
            continue
        if tag in CONTROLS and forms and place("form") >= 0 and not (tag == "input" and re.search(r"\btype\s*=\s*[\"']?hidden", attrs, re.I)):
            innermost = max(int(h[5:]) for h in stack[place("form")][1].hints if h.startswith("form:"))
            forms[innermost] += 1
        if tag in VOID:
            if tag == "br" and current is not None:
                text(" ")
            elif tag == "hr":
                current = None
            continue
        if tag in CLOSES_P and outer and stack[outer[-1]][0] == "p":
            pop(outer[-1])
        if tag in SCOPED:
            same, scope = SCOPED[tag]
            k = max(place(x) for x in same.split())
            if k > max(place(x) for x in scope):
                pop(k)
        around = stack[-1][1] if stack else root
        hints = around.hints
        mine = {tag} if tag in NEVER or tag in ("article", "main", "header") else set()
        if tag == "form":
            mine.add(f"form:{len(forms)}")
            forms.append(0)
        if attrs and attrs != "/" and tag not in ("html", "body"):
            for name, value in HINTED.findall(attrs):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id", "role", "itemprop", "aria-label"):
                    if name == "id" and (tag in TITLES or tag in ("article", "main")):
                        continue
                    role = named_role(value) if name not in ("id", "aria-label") else named_role(re.sub(r"\s+", "-", value), True)
                    if name == "role" and role == "!weak":
                        role = "!boiler"  # roles are from a fixed list
                    if role == "!boiler" or role and "article" not in mine:
                        mine.add(role)
                elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    mine.add("!boiler")
        if tag == "header" and not {"article", "main", "!content"} & hints:
            mine.add("!boiler")
        if "!boiler" in mine or mine & NEVER:
            hints = hints - POSITIVE  # the nearer element counts
            mine -= POSITIVE
        elif mine & {"article", "main"} and not hints & NEVER:
            hints = hints - {"!boiler"}
        if attrs.endswith("/") and tag not in RAW and tag in SKIPPED:
            continue
        if tag in INLINE:
            node = Node(around.tag, around.parent, hints | mine) if mine - {"!content"} else around
        else:
            node = Node(tag, around, hints | mine if mine else hints)
            outer.append(len(stack))
            current = None
        where.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))
        links += tag in LINKS
        skipped += tag in SKIPPED
        if tag in RAW:
            m = re.compile(rf"</{tag}(?![\w-])", re.I).search(page, end)
            go_on = m.start() if m else len(page)
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    found = [b for b in out if b.text]
    chars = [0] * len(forms)
    inside = [[int(h[5:]) for h in b.hints if h.startswith("form:")] if forms else [] for b in found]
    for b, own in zip(found, inside, strict=True):
        for k in own:
            chars[k] += len(b.text)
    for b, own in zip(found, inside, strict=True):
        b.filled_in = any(forms[k] and chars[k] < FORM_CHARS * forms[k] for k in own)
    return found


def log_odds(b: Block) -> float:
    """How much speaks for content, as log-odds."""
    w, n = WEIGHTS, len(b.text)
    score = w["bias"] + w["words"] * min(math.log1p(b.text.count(" ") + 1), 5) + w["stops"] * min(sum(map(b.text.count, ".!?;,:")), 4)
    score += w["links"] * min(1.0, b.linked / n)
    score += w["article"] if "article" in b.hints else 0
    score += w["main"] if b.hints & {"main", "!content"} else 0
    score += w["never"] if b.hints & NEVER or b.filled_in else 0
    score += w["boiler"] if "!boiler" in b.hints else w["weak"] if "!weak" in b.hints else 0
    score += w["heading"] if b.tag in TITLES else w["paragraph"] if b.tag in ("p", "pre", "blockquote") else w["list"] if b.tag == "li" else 0
    return score


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of the minimum cut (Dinic's maximum flow)."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        both = min(source[i], sink[i])  # flows through in any case
        if source[i] > both:
            join(s, i, source[i] - both, 0.0)
        if sink[i] > both:
            join(i, t, sink[i] - both, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
            step = -1
            while nxt[a] < len(out[a]):
                e = out[a][nxt[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    step = e
                    break
                nxt[a] += 1
            if step >= 0:
                path.append(step)
                a = to[step]
            elif a == s:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def apart(a: Node | None, b: Node | None) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if b is None or a is not None and a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours, and between each block and the one before it of the same parent."""
    edges, last = [], {}
    for i, b in enumerate(found):
        parent = b.node.parent
        j = last.get(parent)
        if i:
            a = found[i - 1]
            kin = (a.hints & NEVER == b.hints & NEVER) and (("!boiler" in b.hints) == ("!boiler" in a.hints)) and a.filled_in == b.filled_in
            # what was closed and opened between two neighbours is climbed once
            edges.append((i - 1, i, SMOOTH * 0.5 ** min(60, max(0, apart(a.node, b.node) - 2)) * (1.0 if kin else 0.1)))
        if j is not None and j != i - 1:
            edges.append((j, i, SMOOTH * 0.5))
        last[parent] = i
    return edges


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by one space; empty for none."""
    found = blocks(page or "")
    if not found:
        return ""
    source, sink = [], []
    for b in found:
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, log_odds(b)))))
        source.append(-math.log(max(1 - p, 1e-12)))
        sink.append(-math.log(max(p, 1e-12)))
    keep = min_cut(source, sink, smoothness(found))
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


@F.pandas_udf(T.StringType())
def _main_text(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extract_main_text(pages: DataFrame, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with the main text in the column ``out`` (an existing one is replaced).

    Null, empty and text-free pages give an empty string; pages are parsed whole, in time linear
    in their length; repeated rows are treated alike; nothing is shuffled.
    """
    return put(pages, {out: _main_text(F.coalesce(F.col(html_col), F.lit("")))})
