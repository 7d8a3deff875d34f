"""A tolerant HTML reader: the tree of a page's block elements, with their text."""

from __future__ import annotations

import html
import re

# Fixed values of HTML: block elements, those whose content isn't page text, those without content, implied ends.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("script style head title noscript template iframe object svg canvas math select datalist textarea button audio video noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends the open elements named, up to (not including) the limits.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **{k: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}) for k in ("thead", "tbody", "tfoot")},
}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^a-zA-Z>][^>]*+(?:>|\Z)|<!?>|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDING = re.compile(r"""\shidden(?:[\s=/]|\Z)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I | re.A) for name in HIDDEN}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\W\d_]+")


class Node:
    """A block element or a run of text beside block elements (tag ``#text``)."""

    __slots__ = ("tag", "attrs", "parent", "children", "depth", "text", "links", "tags", "inputs", "bold", "hidden")

    def __init__(self, tag: str, attrs: str, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.text: list[str] = []
        self.links = self.tags = self.inputs = self.bold = 0
        self.hidden = False


def attribute_tokens(attrs: str) -> list[str]:
    """Lower-case words of class, id and role."""
    return [t.lower() for m in _ATTRIBUTE.finditer(attrs) for t in _PART.findall(m[2] or m[3] or m[4] or "")]


def parse(page: str) -> Node:
    """The page's block tree. Text runs are decoded and their white space is one space each; a node's own text lies in leaves."""
    root = Node("#root", "", None)
    stack, at, link, n = [root], 0, None, len(page)
    run: list[str] = []
    run_links = 0

    def flush() -> None:
        nonlocal run_links
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                here = stack[-1]
                leaf = Node("#text", "", here)
                leaf.text.append(text)
                leaf.links = min(run_links, len(text))
                here.children.append(leaf)
            run.clear()
        run_links = 0

    def add(text: str) -> None:
        nonlocal run_links
        run.append(text)
        if link is not None:
            run_links += len(text)

    def close(keep: int) -> None:
        nonlocal link
        flush()
        del stack[keep:]
        if link is not None and link > len(stack):
            link = None

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if page.startswith("<![CDATA[", m.start()):
                add(html.escape(page[m.start() + 9 : at].removesuffix("]]>"), quote=False))
            continue
        name, end, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        here = stack[-1]
        if end:
            if name == "a":
                link = None
            elif name in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == name or name in HEADINGS and stack[k].tag in HEADINGS:
                        close(k)
                        break
                else:
                    flush()
            continue
        here.tags += 1
        if name in HIDDEN:
            if not attrs.endswith("/"):
                if stop := _CLOSING[name].search(page, at):
                    at = stop.end()
                elif name in ("script", "style", "title", "textarea", "xmp"):
                    at = n
                if name in ("button", "select", "textarea"):
                    here.inputs += 1
                run.append(" ")
            continue
        if name == "br":
            run.append(" ")
        elif name == "a":
            link = len(stack)
        elif name in ("input", "label", "option"):
            here.inputs += 1
            if name == "input":
                run.append(" ")
        elif name in ("b", "strong", "em", "i"):
            here.bold += 1
        elif name in BLOCKS:
            flush()
            if name in ("html", "body") and any(x.tag == name for x in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or name in HEADINGS and stack[k].tag in HEADINGS and k == len(stack) - 1:
                    close(k)
                    break
                if stack[k].tag in ("table", "td", "th", "caption"):
                    break
            if name in IMPLIED:
                ends, limits = IMPLIED[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in limits:
                        break
                    if stack[k].tag in ends:
                        close(k)
                        if name not in ("tr", "thead", "tbody", "tfoot"):
                            break
            if name != "hr":
                node = Node(name, attrs, stack[-1])
                node.hidden = bool(attrs) and _HIDING.search(attrs) is not None
                stack[-1].children.append(node)
                if not attrs.endswith("/") or name in ("p", "div", "section", "li"):
                    stack.append(node)
        elif name in ("td", "th"):
            run.append(" ")
    flush()
    return root
