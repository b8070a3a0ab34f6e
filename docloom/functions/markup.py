"""Tolerant HTML tree for use inside tasks: one page in, small rows out."""

from __future__ import annotations

from html.parser import HTMLParser

# Element classes of HTML.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta "
    "nextid param source spacer track wbr".split()
)
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
BLOCKS = HEADINGS | frozenset(
    "p pre ul ol dl table div blockquote hr article section nav footer header aside main form".split()
)
NON_TEXT = frozenset({"rp", "rt", "script", "style", "template"})
RAW_TEXT = frozenset({"script", "style"})
KEEP_SPACE = frozenset({"pre", "textarea"})
# Attributes that hold a list of words, on any tag and per tag.
LIST_ATTRIBUTES = frozenset({"accesskey", "class", "dropzone"})
LIST_ATTRIBUTES_BY_TAG = {
    "a": {"rel", "rev"},
    "area": {"rel"},
    "form": {"accept-charset"},
    "icon": {"sizes"},
    "iframe": {"sandbox"},
    "link": {"rel", "rev"},
    "object": {"archive"},
    "output": {"for"},
    "td": {"headers"},
    "th": {"headers"},
}
ASCII_SPACE = " \t\n\f\r"
# What an opening tag closes: tag -> (tags it ends, tags that stop the search).
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody"}, {"table"}),
    "tfoot": ({"thead", "tbody"}, {"table"}),
}


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict | None = None) -> None:
        self.tag, self.attrs, self.kids = tag, attrs or {}, []

    @property
    def classes(self) -> set[str]:
        return set((self.attrs.get("class") or "").split())

    def elements(self) -> list["Node"]:
        return [k for k in self.kids if isinstance(k, Node) and k.tag != "#comment"]

    def walk(self):
        for kid in self.elements():
            yield kid
            yield from kid.walk()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _end_open(self, ended: set[str], stops: set[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in stops:
                return
            if self.open[depth].tag in ended:
                del self.open[depth:]
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end_open({"p"}, BLOCKS - {"p"} | {"li", "td", "th", "dd"})
        if tag in _ENDS:
            self._end_open(*_ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data: str) -> None:
        kids = self.open[-1].kids
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)

    def handle_comment(self, data: str) -> None:
        node = Node("#comment")
        node.kids.append(data)
        self.open[-1].kids.append(node)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def events(top: Node, hidden=lambda node: False):
    """The tree below ``top`` in page order: (opening, node), (closing, node) and (text, piece)."""
    waiting = [iter(top.kids)]
    inside = [top]
    while waiting:
        kid = next(waiting[-1], None)
        if kid is None:
            waiting.pop()
            ended = inside.pop()
            if inside:
                yield "close", ended
        elif isinstance(kid, str):
            yield "text", kid
        elif not hidden(kid):
            yield "open", kid
            waiting.append(iter(kid.kids))
            inside.append(kid)


def _unread(node: Node) -> bool:
    return node.tag == "#comment" or node.tag in NON_TEXT


def text_of(node: Node, code: str = "") -> str:
    """Text of a node with white space collapsed; outermost ``<code>`` between ``code`` marks."""
    pieces, depth, begun = [], 0, 0
    for what, of in events(node, _unread):
        if what == "text":
            pieces.append(of)
        elif code and of.tag == "code":
            depth += 1 if what == "open" else -1
            if what == "open" and depth == 1:
                begun = len(pieces)
            elif what == "close" and not depth:
                pieces[begun:] = [code + " ".join("".join(pieces[begun:]).split()) + code]
    return " ".join("".join(pieces).split())


# -- canonical markup ----------------------------------------------------------

_ENTITIES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})


def _opening(node: Node, end: str) -> str:
    words = [node.tag]
    for name, value in sorted(node.attrs.items()):
        if name in LIST_ATTRIBUTES or name in LIST_ATTRIBUTES_BY_TAG.get(node.tag, ()):
            value = " ".join(value.split())
        value = value.translate(_ENTITIES)
        mark = "'" if '"' in value and "'" not in value else '"'
        words.append(f"{name}={mark}{value.replace(mark, '&quot;')}{mark}")
    return f"<{' '.join(words)}{end}"


def canonical(root: Node) -> str:
    """One normal form of a page: sorted attributes, escaped text, blank text as one character."""
    out: list[str] = []
    raw = spaced = comment = 0  # open elements whose text is written as it is, keeps its blanks, is a comment
    for what, of in events(root):
        if what == "text":
            blank = not spaced and not of.strip(ASCII_SPACE)
            piece = ("\n" if "\n" in of else " ") if blank else of
            out.append(piece if raw or comment else piece.translate(_ENTITIES))
            continue
        step = 1 if what == "open" else -1
        if of.tag == "#comment":
            comment += step
            out.append("<!--" if step > 0 else "-->")
            continue
        raw += step * (of.tag in RAW_TEXT)
        spaced += step * (of.tag in KEEP_SPACE)
        empty = of.tag in VOID and not of.kids
        if step > 0:
            out.append(_opening(of, "/>" if empty else ">"))
        elif not empty:
            out.append(f"</{of.tag}>")
    return "".join(out)
