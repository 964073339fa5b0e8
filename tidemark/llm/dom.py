"""A forgiving HTML reader for one page: a tree of block elements with their text, and simple tree matching."""

from __future__ import annotations

import html
import re
from collections import Counter

# fixed values: element names of the HTML standard by role
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "head", "html", "body"}
CHROME = frozenset(
    "head nav header footer aside form menu dialog button select option datalist label fieldset search svg canvas object audio "
    "video map script style textarea title noscript template iframe".split()
)
# fixed values: words of class, id and role attributes that name the parts around an article
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar aside menu nav "
    "navbar navigation breadcrumb breadcrumbs header masthead topbar footer comment comments commentlist disqus reply replies "
    "respond share sharing social related recommended recommendations widget widgets toolbar pagination pager search complementary "
    "contentinfo".split()
)
REPLY_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
CONTENT_WORDS = frozenset("article articlebody content post entry story main text body".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
MAX_DEPTH = 200  # deeper block elements join their ancestor at this depth, as separate runs of text
MAX_INLINE = 100  # open inline elements; more are read as text

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "key", "chrome", "named", "replies", "content", "items", "nodes", "block", "linked")

    def __init__(self, tag: str, attrs: dict[str, str], block: bool):
        words = set()
        for name in ("class", "id", "role"):
            if name in attrs:
                words.update(w.lower() for w in _WORD.findall(attrs[name]))
        style = attrs.get("style", "").replace(" ", "").lower()
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        self.tag = tag
        self.key = f"{tag}.{attrs.get('class', '')}" if tag != "body" else tag
        self.content = tag in ("article", "main") or bool(words & CONTENT_WORDS) or attrs.get("itemprop", "").lower() == "articlebody"
        # only the class says so: an element that carries the article keeps it all the same, see _settle
        self.named = tag not in CHROME and not hidden and bool(words & CHROME_WORDS) and tag not in ("html", "body", "main", "h1")
        self.replies = bool(words & REPLY_WORDS)
        self.chrome = tag in CHROME or hidden or self.named
        self.items: list = []  # pieces of text and elements, in page order
        self.nodes: list[Node] = []  # block elements below it
        self.block = block
        self.linked = tag == "a"


def parse(page: str) -> Node:
    """The tree of a page; raw text, comments and declarations are left out."""
    root = Node("html", {}, True)
    stack = [root]
    unopened: Counter = Counter()  # elements beyond the depth whose end tags are to come
    opened = inline = 0  # open block and inline elements above the root
    named = False

    def cut(k: int) -> None:
        nonlocal opened, inline
        for x in stack[k:]:
            opened, inline = opened - x.block, inline - (not x.block)
        del stack[k:]
        unopened.clear()

    def close(tags: set[str], within: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                cut(k)
                return
            if stack[k].tag in within:
                return

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else n]
        if piece:
            stack[-1].items.append(html.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].items.append(None)
            elif unopened[tag]:
                unopened[tag] -= 1
                if tag in BLOCK:
                    stack[-1].items.append(None)
            elif tag in BLOCK:
                close({tag}, set())
            else:
                # an inline end tag does not end blocks
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].block:
                        break
                    if stack[k].tag == tag:
                        cut(k)
                        break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].items.append(None)
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>|\\Z", re.I).search(page, at)
            at = end.end()
            continue
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in stack[1:]) or tag == "html":
            continue
        if tag in SAME_LEVEL:
            close(SAME_LEVEL[tag], SCOPE[tag])
        elif tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "object", "body", "html"})
        if tag == "body":
            close({"head"}, set())
        if (opened >= MAX_DEPTH) if tag in BLOCK else (inline >= MAX_INLINE):
            unopened[tag] += 1
            if tag in BLOCK:
                stack[-1].items.append(None)
            continue
        attrs = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTR.findall(m[3])} if m[3].strip() else {}
        node = Node(tag, attrs, tag in BLOCK)
        stack[-1].items.append(node)
        if node.block:
            parent = next(x for x in reversed(stack) if x.block)
            parent.nodes.append(node)
        stack.append(node)
        opened, inline = opened + node.block, inline + (not node.block)
        named = named or node.named
    if named:
        _settle(root)
    return root


def _settle(root: Node) -> None:
    """Elements that only their class calls chrome are none where they are or hold the article, or most of its text.

    The largest article (else main) element below such an element counts if no other is free of them, or if it has more
    than half of the page's text.  Parts for replies never count.
    """
    sizes: dict[int, int] = {}
    articles: list[tuple[Node, list[Node]]] = []

    def weigh(x: Node, above: list[Node]) -> int:
        above = [*above, x] if x.named else above
        if x.tag in ("article", "main") and not any(y.replies for y in above):
            articles.append((x, above))
        size = 0
        for item in x.items:
            if isinstance(item, str):
                size += len(item.strip())
            elif item is not None and (item.named or not item.chrome):
                size += weigh(item, above)
        sizes[id(x)] = size
        return size

    def large(x: Node, least: int) -> None:
        for item in x.items:
            if isinstance(item, Node) and (item.named or not item.chrome) and 2 * sizes[id(item)] > least:
                if not item.replies:
                    item.chrome = False
                    large(item, least)

    weigh(root, [])
    found = [a for a in articles if a[0].tag == "article"] or articles
    free = max((x for x, above in found if not above), key=lambda x: sizes[id(x)], default=None)
    held, above = max((a for a in found if a[1]), key=lambda a: sizes[id(a[0])], default=(None, []))
    if held is not None and (free is None or 2 * sizes[id(held)] > sizes[id(root)]):
        for x in above:
            x.chrome = False
        free = held
    scope = free or root
    large(scope, sizes[id(scope)])


def blocks(node: Node, owner: Node | None = None, out: list | None = None, skip_chrome: bool = True) -> list[tuple[Node, str, int]]:
    """(block element, text, characters in links) of each run of text below ``node``, in page order."""
    out = [] if out is None else out
    run: list[str] = []
    link = [0]
    current = [owner or node]

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append((current[0], text, link[0]))
        run.clear()
        link[0] = 0

    def walk(x: Node, linked: bool) -> None:
        for item in x.items:
            if item is None:
                flush()
            elif isinstance(item, str):
                run.append(item)
                if linked:
                    link[0] += len(item.strip())
            elif skip_chrome and item.chrome:
                if item.block:
                    flush()
            elif item.block:
                flush()
                before, current[0] = current[0], item
                walk(item, linked)
                flush()
                current[0] = before
            else:
                walk(item, linked or item.linked)

    walk(node, False)
    flush()
    return out


def own_texts(root: Node) -> dict[int, tuple[str, ...]]:
    """The runs of text of each block element, without those of elements below it."""
    found: dict[int, list[str]] = {}
    for node, text, _ in blocks(root, skip_chrome=False):
        found.setdefault(id(node), []).append(text)
    return {k: tuple(v) for k, v in found.items()}


def match(a: Node, b: Node, texts_a: dict, texts_b: dict) -> list[tuple[Node, Node]]:
    """Pairs of block elements by simple tree matching: the largest order-keeping match of equal elements.

    Two elements match when tag and class agree; equal text counts for one more, so that repeated parts meet.
    """
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def weigh(x: Node, y: Node) -> int:
        if x.key != y.key:
            return 0
        known = memo.get((id(x), id(y)))
        if known is not None:
            return known[0]
        own = 1 + (texts_a.get(id(x)) == texts_b.get(id(y)))
        xs, ys = x.nodes, y.nodes
        table = []
        if xs and ys:
            above = [0] * (len(ys) + 1)
            table.append(above)
            for c in xs:
                row = [0]
                for j, d in enumerate(ys):
                    w = weigh(c, d)
                    row.append(max(row[j], above[j + 1], above[j] + w if w else 0))
                table.append(row)
                above = row
            own += above[-1]
        memo[id(x), id(y)] = own, table
        return own

    pairs = []

    def trace(x: Node, y: Node) -> None:
        pairs.append((x, y))
        table = memo[id(x), id(y)][1]
        i, j = len(x.nodes), len(y.nodes)
        while table and i and j:
            c, d = x.nodes[i - 1], y.nodes[j - 1]
            w = weigh(c, d)
            if w and table[i][j] == table[i - 1][j - 1] + w:
                trace(c, d)
                i, j = i - 1, j - 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1

    if weigh(a, b):
        trace(a, b)
    return pairs
