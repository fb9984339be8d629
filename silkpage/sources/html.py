"""A small HTML tree for captured pages: tag soup to nodes, with implied end tags.

There is no layout here. `hidden` stands in for it: an element is hidden by its tag, the
hidden attribute or an inline style, or inside such an element.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

#: Fixed values of HTML: elements without content, with raw text, never shown.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
UNSEEN = frozenset(("script", "style", "noscript", "template", "head", "title"))
#: Fixed values of HTML: a start tag that ends an open element of these tags.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"),
    "tfoot": ("tr", "td", "th", "tbody"),
}
SCOPES = frozenset(("ul", "ol", "dl", "select", "table", "td", "th", "body", "html", "div", "section", "article"))
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "ord", "end", "inner", "nth", "_hidden")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.ord = self.end = self.nth = 0
        self.inner = [0, 0]
        self._hidden: bool | None = None

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str)]

    def walk(self) -> Iterator[Node]:
        """Elements of the subtree in document order, without this one."""
        stack = self.elements[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack += n.elements[::-1]

    def find(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag in tags)

    def up(self) -> Iterator[Node]:
        n: Node | None = self
        while n is not None and n.tag != "#document":
            yield n
            n = n.parent

    def text(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack += n.children[::-1]
        return "".join(out)

    @property
    def hidden(self) -> bool:
        if self._hidden is None:
            own = self.tag in UNSEEN or "hidden" in self.attrs or bool(HIDING.search(self.get("style")))
            self._hidden = own or (self.parent is not None and self.parent.hidden)
        return self._hidden


def attributes(s: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTR.findall(s):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def parse(html: str | None) -> Node:
    """The tree under a #document node; html, head and body are always there."""
    html = html or ""
    root = Node("#document", {}, None)
    top = Node("html", {}, root)
    head, body = Node("head", {}, top), Node("body", {}, top)
    root.children.append(top)
    top.children += [head, body]
    body.inner = [0, len(html)]
    cur, at, in_body = head, 0, False

    def add_text(s: str) -> None:
        nonlocal cur, in_body
        if not s:
            return
        if cur is head:
            if not s.strip():
                return
            cur, in_body = body, True
        cur.children.append(unescape(s))

    def close_to(tags: tuple[str, ...], stops: frozenset[str]) -> None:
        nonlocal cur
        n = cur
        while n is not body and n is not head and n is not top:
            if n.tag in tags:
                n.inner[1] = here
                cur = n.parent
                n = cur
                continue
            if n.tag in stops or n.parent is None:
                return
            n = n.parent

    pos = 0
    while (m := TOKEN.search(html, pos)) is not None:
        here = m.start()
        add_text(html[at:here])
        at = pos = m.end()
        if m[1]:
            tag, n = m[1].lower(), cur
            if tag in ("body", "html"):
                if tag == "body":
                    body.inner[1] = here
                continue
            if tag == "head":
                cur, in_body = body, True
                continue
            while n is not None and n not in (body, head, top, root) and n.tag != tag:
                n = n.parent
            if n is not None and n.tag == tag and n not in (body, head, top, root):
                n.inner[1] = here
                cur = n.parent
        elif m[2]:
            tag = m[2].lower()
            attrs = attributes(m[3])
            if tag in ("html", "head", "body"):
                target = {"html": top, "head": head, "body": body}[tag]
                for k, v in attrs.items():
                    target.attrs.setdefault(k, v)
                if tag == "body":
                    cur, in_body = body, True
                    body.inner[0] = at
                continue
            if cur is head and not in_body and tag not in ("meta", "title", "link", "script", "style", "base", "noscript", "template"):
                cur, in_body = body, True
                if not body.inner[0]:
                    body.inner[0] = here
            if tag in ENDS_P:
                close_to(("p",), frozenset(("table", "td", "th", "button")))
            if tag in ENDS:
                close_to(ENDS[tag], SCOPES - frozenset(ENDS[tag]))
            node = Node(tag, attrs, cur)
            node.inner = [at, at]
            cur.children.append(node)
            if tag in VOID or m[3].rstrip().endswith("/") and tag not in RAW and tag in ("svg", "path"):
                continue
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                raw = html[at : stop.start() if stop else len(html)]
                node.children.append(raw if tag in ("script", "style", "xmp", "iframe", "noembed", "noframes") else unescape(raw)) if raw else None
                node.inner[1] = at + len(raw)
                at = pos = stop.end() if stop else len(html)
            else:
                cur = node
                node.inner[1] = len(html)
    here = len(html)
    add_text(html[at:])
    # Pre-order interval encoding and positions among siblings of one tag.
    count = 0
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        n, done = stack.pop()
        if done:
            n.end = count
            continue
        n.ord = count
        count += 1
        stack.append((n, True))
        seen: dict[str, int] = {}
        for c in n.elements:
            seen[c.tag] = c.nth = seen.get(c.tag, 0) + 1
        for c in n.elements:
            if seen[c.tag] == 1:
                c.nth = 0
        stack += [(c, False) for c in n.elements[::-1]]
    return root
