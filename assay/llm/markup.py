"""HTML as a token stream and as a union-free regular expression: what a task of ``wrappers`` does with one page or two expressions.

An expression is a sequence of nodes: a text slot ``#``, an element with the sequence inside it, or a group ``()`` of
optional nodes. Any node may be optional or repeated. A page is an expression too: neighbours alike are one repeated node, and where
a tag recurs among others, what lies between its first and last place becomes a repeated group of optional nodes.
"""

from __future__ import annotations

import html
import re
import zlib

# fixed values: elements of HTML by their role
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd map mark nobr picture q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split()
)
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
CLOSES |= {x: {"thead", "tbody", "tfoot", "tr", "td", "th"} for x in ("thead", "tbody", "tfoot")}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
BOXES = frozenset("table tr td th tbody thead tfoot".split())

FLOW = frozenset("# p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd pre blockquote figure table tr td th hr".split())

#: What occurs so often in one sequence is a repeated group: text and what says what it is sooner than bare containers, whose place tells them apart.
REPEATED, REPEATED_BARE = 3, 8
#: Elements nested deeper are not told apart; their text belongs to the deepest that is.
DEEPEST = 100

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)
    |</[^>]*(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/]|\Z))""", re.I)
_DIGITS = re.compile(r"\d+")


class Node:
    """``label`` is ``#``, ``()`` or a tag with what its attributes say; a slot has the figures of its texts."""

    __slots__ = ("label", "kids", "many", "opt", "pages", "chars", "linked", "text", "blocks")

    def __init__(self, label: str, kids: list[Node] | None = None, many: bool = False, opt: bool = False):
        self.label, self.kids, self.many, self.opt = label, kids or [], many, opt
        self.pages, self.chars, self.linked, self.text, self.blocks = 0, 0, 0, None, ()

    def dump(self) -> list:
        own = [self.label, int(self.many) + 2 * int(self.opt)]
        return [*own, self.pages, self.chars, self.linked, self.text] if self.label == "#" else [*own, [k.dump() for k in self.kids]]

    @staticmethod
    def load(x: list) -> Node:
        node = Node(x[0], many=bool(x[1] & 1), opt=bool(x[1] & 2))
        if x[0] == "#":
            node.pages, node.chars, node.linked, node.text = x[2:]
        else:
            node.kids = [Node.load(k) for k in x[2]]
        return node

    def shape(self) -> str:
        return self.label + ("*" if self.many else "") + ("?" if self.opt else "") + (f"({' '.join(k.shape() for k in self.kids)})" if self.kids else "")

    def slots(self) -> list[Node]:
        return [self] if self.label == "#" else [s for k in self.kids for s in k.slots()]


def tokens(page: str):
    """(kind, name, attributes or text): ``open``, ``close`` and ``text``; comments and raw elements are left out."""
    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            yield "text", "", page[at:]
            return
        if found.start() > at:
            yield "text", "", page[at : found.start()]
        at = found.end()
        if found["tag"]:
            tag = found["tag"].lower()
            yield ("close" if found["end"] else "open"), tag, found["attrs"]
            if tag in RAW and not found["end"]:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else size


def label(tag: str, attrs: str) -> str:
    """The tag and its class, id, role, item property and hidden attribute, numbers alike."""
    if not attrs or attrs.isspace():
        return tag
    said = {}
    for name, value in _ATTR.findall(attrs):
        said.setdefault(name.lower(), " ".join(value.strip("\"'").lower().split()))
    return tag + "".join(f" {k}={_DIGITS.sub('0', said[k])}" for k in sorted(said))


def parse(page: str, stands_alone=lambda label: False) -> tuple[Node, list[str]]:
    """A page as an expression, and its blocks of text in page order; slots name theirs.

    Inline elements are part of the text around them, unless ``stands_alone`` says otherwise of their label.
    """
    root = Node("page")
    stack, blocks = [("", root)], []
    pieces: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked, in_link
        in_link = False
        if not pieces:
            return
        text = " ".join("".join(pieces).split())
        if text:
            slot = Node("#")
            slot.pages, slot.chars, slot.linked, slot.text, slot.blocks = 1, len(text), min(linked, len(text)), zlib.crc32(text.encode("utf-8", "replace")), (len(blocks),)
            stack[-1][1].kids.append(slot)
            blocks.append(text)
        pieces.clear()
        linked = 0

    def close(n: int) -> None:
        """Close elements until ``n`` are open."""
        flush()
        while len(stack) > n:
            _, node = stack.pop()
            node.kids = normal(node.kids)

    for kind, tag, rest in tokens(page):
        if kind == "text":
            text = html.unescape(rest)
            pieces.append(text)
            if in_link:
                linked += len(text)
        elif kind == "open":
            if tag == "br":
                pieces.append("\n")
                continue
            if tag in RAW:
                flush()
                continue
            named = label(tag, rest)
            if tag in INLINE and not (tag not in VOID and stands_alone(named)):
                if tag == "a":
                    in_link = True
                continue
            flush()
            if tag not in INLINE and stack[-1][0] == "p":
                close(len(stack) - 1)
            for i in range(len(stack) - 1, 0, -1) if tag in CLOSES else ():
                if stack[i][0] in HOLDS.get(tag, BOXES - CLOSES[tag]) or stack[i][0] == "table":
                    break
                if stack[i][0] in CLOSES[tag]:
                    close(i)
                    if tag in HOLDS:
                        break
            if tag in VOID:
                continue
            node = Node(named)
            if len(stack) <= DEEPEST:
                stack[-1][1].kids.append(node)
            else:
                node = stack[-1][1]
            stack.append((tag, node))
        elif tag == "a" and in_link:
            in_link = False
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                if tag not in INLINE:
                    flush()
    close(1)
    root.kids = normal(root.kids)
    return root, blocks


def _alike(a: Node, b: Node) -> bool:
    return a.label == b.label and (a.label != "()" or bool({k.label for k in a.kids} & {k.label for k in b.kids}))


def merged(a: Node, b: Node, across: bool) -> Node:
    """One node for two of a label: of different pages (``across``), or a repetition within."""
    out = Node(a.label, many=a.many or b.many or not across, opt=a.opt or b.opt if across else a.opt and b.opt)
    if a.label == "#":
        out.pages = a.pages + b.pages if across else max(a.pages, b.pages)
        out.chars, out.linked, out.blocks = a.chars + b.chars, a.linked + b.linked, a.blocks + b.blocks
        out.text = a.text if a.text == b.text else None
    elif a.label == "()":
        out.kids = _members([*a.kids, *b.kids], across)
    else:
        out.kids = aligned(a.kids, b.kids, across)
    return out


def _members(nodes: list[Node], across: bool) -> list[Node]:
    """Nodes of a group: one of each label."""
    members: dict[str, Node] = {}
    for x in nodes:
        for y in x.kids if x.label == "()" else [x]:
            members[y.label] = merged(members[y.label], y, across) if y.label in members else y
    return list(members.values())


def _copied(x: Node, many: bool, opt: bool) -> Node:
    out = Node(x.label, x.kids, many, opt)
    out.pages, out.chars, out.linked, out.text, out.blocks = x.pages, x.chars, x.linked, x.text, x.blocks
    return out


def _as_optional(x: Node) -> Node:
    return x if x.opt else _copied(x, x.many, True)


def aligned(a: list[Node], b: list[Node], across: bool) -> list[Node]:
    """One sequence for two: the longest common one is matched, and a mismatch is optional on its side."""
    if len(a) == len(b) and all(map(_alike, a, b)):
        return normal([merged(x, y, across) for x, y in zip(a, b, strict=True)])
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 if _alike(a[i], b[j]) else 0)
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and _alike(a[i], b[j]) and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(merged(a[i], b[j], across))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] == best[i][j]:
            out.append(_as_optional(a[i]))
            i += 1
        else:
            out.append(_as_optional(b[j]))
            j += 1
    return normal(out)


def _joined(a: Node, b: Node) -> Node | None:
    """One node for two neighbours that repeat each other."""
    if "()" in (a.label, b.label):
        own, other = ({k.label for k in x.kids} if x.label == "()" else {x.label} for x in (a, b))
        if own & other and (other <= own or own <= other):
            return Node("()", _members([a, b], False), many=True, opt=a.opt and b.opt)
        return None
    if a.label == b.label and (a.many or b.many or a.shape() == b.shape()):
        return merged(a, b, False)
    return None


def normal(nodes: list[Node]) -> list[Node]:
    """A sequence in which repetitions are folded."""
    if len(nodes) < 2:
        return nodes
    out: list[Node] = []
    for x in nodes:
        while out and (one := _joined(out[-1], x)) is not None:
            out.pop()
            x = one
        out.append(x)
    if len(out) < REPEATED:
        return out
    places: dict[str, list[int]] = {}
    for i, x in enumerate(out):
        for k in x.kids if x.label == "()" else [x]:
            places.setdefault(k.label, []).append(i)
    spans = sorted((p[0], p[-1]) for k, p in places.items() if len(p) >= REPEATED and (len(p) >= REPEATED_BARE or k in FLOW or " " in k))
    if not spans:
        return out
    folded, at = [], 0
    while spans:
        low, high = spans.pop(0)
        while spans and spans[0][0] <= high:
            high = max(high, spans.pop(0)[1])
        members = _members(out[low : high + 1], False)
        group = Node("()", [_as_optional(x) for x in members]) if len(members) > 1 else members[0]
        folded += [*out[at:low], _copied(group, True, all(x.opt for x in out[low : high + 1]))]
        at = high + 1
    return normal([*folded, *out[at:]])
