"""HTML pages to typed rows: blocks, spans, cells, metadata, release entries.

A task only tokenises: it turns pages into block rows by one table of rules (tag, class, how the
element is laid out). What rows mean together (sections, links, entries of a change log, documents)
is DataFrame work, here and in ``operators.documents``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from docloom.functions import markup
from docloom.functions.links import resolve_href
from docloom.functions.markup import HEADINGS, Node, text_of
from docloom.session import cut, spread

# Main containers, admonition classes, containers left out.
MAIN = ("div.section", "div.chapter", "article")
ADMONITIONS = ("caution", "important", "note", "tip", "warning")
DROPPED = ("titlepage", "spirit-nav", "copyright-footer")
DROPPED_TAGS = ("nav", "footer", "hr")
SEPARATOR = re.compile(r"^[\s—–-]*$")
# Result rows that leave a task together, at most.
SLICE_ROWS = 2048

SPAN = "struct<span_no:int,kind:string,style:string,text:string,href:string>"
BLOCK_SCHEMA = (
    "page_id bigint, block_no int, parent_path array<int>, kind string, level int, label string, text string, "
    f"row_no int, col_no int, is_header boolean, spans array<{SPAN}>"
)
_STYLES = {"code": "code", "em": "italic", "i": "italic", "strong": "bold", "b": "bold"}


def _is(node: Node, selector: str) -> bool:
    tag, _, name = selector.partition(".")
    return tag in ("", node.tag) and (not name or name in node.classes)


def _find(node: Node, *selectors: str) -> Node | None:
    return next((n for n in node.walk() if any(_is(n, s) for s in selectors)), None)


def main_container(root: Node, selectors=MAIN) -> Node | None:
    return root if "" in selectors else _find(root, *selectors)


# -- inline content --------------------------------------------------------------


def _left_out(node: Node) -> bool:
    return (
        node.tag == "#comment"
        or node.tag in markup.NON_TEXT
        or _is(node, "a.indexterm")
        or _is(node, "a.para")
        or (_is(node, "span.silver") and SEPARATOR.match(text_of(node)) is not None)
    )


def _alt(node: Node) -> str:
    image = node if node.tag == "img" else _find(node, "img")
    return text_of(node) if image is None else (image.attrs.get("alt") or "").strip()


# Elements that are one span of their own: selector, kind, text, target.
_ATOMS = (
    ("br", "break", lambda n: "\n", lambda n: None),
    ("img", "image", _alt, lambda n: n.attrs.get("src", "")),
    ("a.co", "callout", _alt, lambda n: None),
    ("a.footnote", "text", text_of, lambda n: None),
)


def _spans(kids: list, style: str = "") -> list[dict]:
    """Pieces of inline content; each takes the innermost style and link that are open around it."""
    holder = Node("#run")
    holder.kids = kids
    out: list[dict] = []
    styles, targets, skip = [style], [None], None
    for what, of in markup.events(holder, _left_out):
        if skip is not None:
            skip = None if what == "close" and of is skip else skip
            continue
        if what == "text":
            kind = "link" if targets[-1] is not None else "span" if styles[-1] else "text"
            made = (kind, of, targets[-1])
        elif what == "open":
            atom = next((a for a in _ATOMS if _is(of, a[0])), None)
            if atom is None:
                styles.append(_STYLES.get(of.tag, styles[-1]))
                targets.append(of.attrs.get("href", targets[-1]) if of.tag == "a" else targets[-1])
                continue
            skip = of
            made = (atom[1], atom[2](of), atom[3](of))
        else:
            styles.pop()
            targets.pop()
            continue
        out.append({"span_no": len(out), "kind": made[0], "style": styles[-1], "text": made[1], "href": made[2]})
    return out


# -- layouts: an element's own row, and the rows that hold its parts ---------------

Row = dict
Layout = tuple[Row | None, list[tuple[Row, Node | None]]]


def _listed(kind: str, labelled: list[tuple[str, Node | None]], item: str = "item") -> Layout:
    return {"kind": kind}, [({"kind": item, "label": label}, node) for label, node in labelled]


def _list(node: Node) -> Layout:
    entries = [n for n in node.elements() if n.tag == "li"]
    if node.tag == "ul":
        return _listed("list", [("", n) for n in entries])
    begin = (node.attrs.get("start") or "").strip()
    return _listed("list", [(f"{k}.", n) for k, n in enumerate(entries, int(begin) if begin.isdigit() else 1)])


def _definitions(node: Node) -> Layout:
    labelled: list[tuple[str, Node | None]] = []
    named = ""
    for tag, run in groupby((n for n in node.elements() if n.tag in ("dt", "dd")), key=lambda n: n.tag):
        if tag == "dt":
            named = ", ".join(text_of(n) for n in run)
            labelled.append((named, None))
        else:
            bodies = list(run)
            if named and labelled and labelled[-1][1] is None:
                labelled.pop()
            labelled += zip(chain([named], ("" for _ in bodies)), bodies)
            named = ""
    return _listed("deflist", labelled, "definition")


def _cells(row: Node) -> list[Node]:
    return [n for n in row.elements() if n.tag in ("td", "th")]


def _grid(node: Node, title: str = "") -> Layout:
    """Rows by section: one head row is number 0, all others count from 1."""
    sections = [(n.tag, [r for r in n.elements() if r.tag == "tr"]) for n in node.elements() if n.tag != "tr"]
    heads = [r for tag, rows in sections if tag == "thead" for r in rows]
    rest = [r for tag, rows in sections if tag in ("tbody", "tfoot") for r in rows] + [n for n in node.elements() if n.tag == "tr"]
    first = rest[0] if rest else None
    if not heads and first is not None and {c.tag for c in _cells(first)} == {"th"}:
        heads, rest = [first], rest[1:]
    numbered = chain(zip((0,), heads), enumerate(rest, 1))
    parts = [
        ({"kind": "cell", "text": text_of(cell), "row_no": r, "col_no": c, "is_header": r == 0}, cell)
        for r, row in numbered
        for c, cell in enumerate(_cells(row))
    ]
    return {"kind": "table", "text": title}, parts


def _titled_grid(node: Node) -> Layout:
    grid = _find(node, "table")
    title = next((text_of(n) for n in node.elements() if _is(n, "p.title")), "")
    return (None, []) if grid is None else _grid(grid, title)


def _admonition(node: Node) -> Layout:
    head = _find(node, "th")
    label = (head is not None and text_of(head)) or next(n for n in ADMONITIONS if n in node.classes).capitalize()
    lines = [n for n in node.walk() if n.tag == "tr"]
    body = node if not lines else (_cells(lines[-1]) or [None])[-1]
    return None, [({"kind": "admonition", "label": label}, body)]


def _callouts(node: Node) -> Layout:
    pairs = [_cells(n) for n in node.walk() if n.tag == "tr"]
    return _listed("list", [(f"({_alt(pair[0])})", pair[1]) for pair in pairs if len(pair) == 2])


def _footnotes(node: Node) -> Layout:
    notes = [(n, _find(n, "a.para")) for n in node.walk() if _is(n, "div.footnote")]
    return _listed("footnotes", [("*" if mark is None else text_of(mark), n) for n, mark in notes])


def _figures(node: Node) -> Layout:
    found = [n for n in node.walk() if n.tag == "img"]
    return None, [({"kind": "figure", "text": n.attrs.get("src", ""), "label": _alt(n)}, None) for n in found]


def _heading(node: Node) -> Layout:
    return {"kind": "heading", "text": text_of(node), "level": int(node.tag[1]), "spans": _spans(node.kids)}, []


def _code(node: Node) -> Layout:
    spans = _spans(node.kids, "code")
    return {"kind": "code", "text": "".join(s["text"] for s in spans).expandtabs(8), "spans": spans}, []


def _nothing(node: Node) -> Layout:
    return None, []


# The first rule whose selector fits lays an element out; any other block only passes its content on.
_RULES: tuple[tuple[str, Callable[[Node], Layout]], ...] = (
    *((tag, _nothing) for tag in DROPPED_TAGS),
    *((f"div.{name}", _nothing) for name in DROPPED),
    *((tag, _heading) for tag in sorted(HEADINGS)),
    ("pre", _code),
    ("ul", _list),
    ("ol", _list),
    ("dl", _definitions),
    ("table", _grid),
    ("blockquote", lambda node: (None, [({"kind": "quote"}, node)])),
    *((f"div.{name}", _admonition) for name in ADMONITIONS),
    ("div.calloutlist", _callouts),
    ("div.footnotes", _footnotes),
    ("div.table", _titled_grid),
    ("div.mediaobject", _figures),
)


def _paragraph(kids: list) -> Row | None:
    spans = _spans(kids)
    marks = [s for s in spans if s["kind"] in ("image", "callout")]
    text = " ".join("".join(s["text"] for s in spans if s not in marks).split())
    if not text and [s["kind"] for s in marks] == ["image"]:
        return {"kind": "figure", "text": marks[0]["href"], "label": marks[0]["text"]}
    return {"kind": "para", "text": text, "spans": spans} if text or marks else None


def _is_block(kid) -> bool:
    return isinstance(kid, Node) and kid.tag in markup.BLOCKS


def page_blocks(html: str, selectors=MAIN) -> list[dict]:
    """Block rows of one page (no rows when it has no main container)."""
    rows: list[dict] = []

    def put(path: list[int], row: Row) -> list[int]:
        number = len(rows)
        empty = {"level": None, "label": None, "text": "", "row_no": None, "col_no": None, "is_header": None, "spans": []}
        rows.append({"block_no": number, "parent_path": list(path), **empty, **row})
        return [*path, number]

    def lay(node: Node, path: list[int]) -> None:
        for block, run in groupby(node.kids, key=_is_block):
            if not block:
                row = _paragraph(list(run))
                if row is not None:
                    put(path, row)
                continue
            for kid in run:
                layout = next((make for selector, make in _RULES if _is(kid, selector)), None)
                if layout is None:
                    lay(kid, path)
                    continue
                own, parts = layout(kid)
                below = path if own is None else put(path, own)
                for row, part in parts:
                    inner = put(below, row)
                    if part is not None:
                        lay(part, inner)

    main = main_container(markup.parse(html), selectors)
    if main is not None:
        lay(main, [])
    return rows


def _per_page(pages: DataFrame, key: str, rows_of, schema: str) -> DataFrame:
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for frame in frames:
            for page, html in zip(frame[key], frame["html"]):
                for row in rows_of(html or ""):
                    held.append({"page_id": page, **row})
                    if len(held) >= SLICE_ROWS:
                        yield pd.DataFrame(held, columns=names)
                        held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    return spread(pages.select(key, "html")).mapInPandas(run, schema)


def html_blocks(pages: DataFrame, key: str = "page_id", selectors=MAIN) -> DataFrame:
    """Pages (page_id, html) to block rows of the first element that a selector fits.

    Filter pages first: nothing is pushed below this.
    """
    return _per_page(pages, key, lambda html: page_blocks(html, selectors), BLOCK_SCHEMA)


def register_sql(spark: SparkSession) -> None:
    """Make ``html_blocks(html)`` a SQL table function for ``LATERAL`` joins."""
    columns = ("block_no", "parent_path", "kind", "level", "label", "text", "row_no", "col_no", "is_header", "spans")

    class HtmlBlocks:
        def eval(self, html: str):
            for row in page_blocks(html or ""):
                yield tuple(row[name] for name in columns)

    schema = BLOCK_SCHEMA.removeprefix("page_id bigint, ")
    spark.udtf.register("html_blocks", udtf(HtmlBlocks, returnType=schema))


def block_spans(blocks: DataFrame, bases: DataFrame) -> DataFrame:
    """Spans of each block, link targets resolved against the page path (page_id, path)."""
    spans = blocks.select("page_id", "block_no", F.explode("spans").alias("s")).select("page_id", "block_no", "s.*")
    return spans.join(bases, "page_id").withColumn("_t", resolve_href(F.col("path"), F.col("href"))).select(
        "page_id", "block_no", "span_no", "kind", "style", "text", "href",
        F.col("_t.path").alias("target"), F.col("_t.fragment").alias("fragment"), F.col("_t.url").alias("url"),
    )


# The lines of a requirements section that name headers.
HEADER_LINE = r"^(Convenience header|Header):\s*(\S+)$"


def page_metadata(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Title, up and next links, requirement headers and first declaration of each page.

    Titles and relations are attributes and come from the parser; the rest is read off the block rows.
    """

    def rows_of(html: str) -> list[dict]:
        root = markup.parse(html)
        main = main_container(root)
        head = None if main is None else _find(main, *HEADINGS)
        named = None if head is None else next((a for a in head.walk() if a.tag == "a" and a.attrs.get("title")), None)
        title = "" if head is None else text_of(head) if named is None else " ".join(named.attrs["title"].split())
        links = [n for n in root.walk() if n.tag == "link" and n.attrs.get("href")]
        rel = {name: next((n.attrs["href"] for n in links if n.attrs.get("rel") == name), None) for name in ("up", "next")}
        return [{"title": title, **rel}]

    own = _per_page(pages, key, rows_of, "page_id bigint, title string, up string, next string")
    top = html_blocks(pages, key).filter(F.size("parent_path") == 0)
    # a page's blocks are bounded by the page, which one task has parsed
    before = W.partitionBy("page_id").orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)
    section = F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(before)
    name, value = (F.regexp_extract("text", HEADER_LINE, k) for k in (1, 2))
    lines = top.withColumn("section", section).select(
        "page_id", "block_no", "kind", "text", name.alias("name"), value.alias("value"),
        ((F.col("kind") == "para") & (F.col("section") == "Requirements") & (name != "")
         & ((name == "Header") | (value != "None"))).alias("line"),
    )

    def last(name: str) -> Column:
        return F.coalesce(F.max_by("value", F.when(F.col("line") & (F.col("name") == name), F.col("block_no"))), F.lit(""))

    code = F.min_by("text", F.when(F.col("kind") == "code", F.col("block_no")))
    found = lines.groupBy("page_id").agg(
        last("Header").alias("header"), last("Convenience header").alias("convenience_header"),
        F.coalesce(F.trim(F.regexp_replace(code, r"\s+", " ")), F.lit("")).alias("declaration"),
    )
    empty = {c: "" for c in ("header", "convenience_header", "declaration")}
    return own.join(found, "page_id", "left").fillna(empty)


# -- change-log pages ----------------------------------------------------------


def release_entries(pages: DataFrame, heading: str, key: str = "page_id") -> DataFrame:
    """Change-log pages to entry rows; ``heading`` has one group, the version.

    Entries are read off the block rows. A release reaches from its heading to the next heading of
    a level that releases have on that page. Its entries are the list items, numbered within the
    item that holds them, and paragraphs outside lists. Windows run over one page's rows.
    """
    blocks = _per_page(pages, key, lambda html: page_blocks(html, ("",)), BLOCK_SCHEMA)
    version = F.when(F.col("kind") == "heading", F.regexp_extract("text", heading, 1))
    blocks = blocks.withColumn("version", F.when(version != "", version))
    page = W.partitionBy("page_id")
    levels = F.collect_set(F.when(F.col("version").isNotNull(), F.col("level"))).over(page)
    blocks = blocks.withColumn("starts", (F.col("kind") == "heading") & F.array_contains(levels, F.col("level")))
    so_far = page.orderBy("block_no").rowsBetween(W.unboundedPreceding, 0)
    blocks = blocks.select(
        "page_id", "block_no", "kind", "text", "spans", "starts",
        F.last(F.when(F.col("starts"), F.struct("version")), ignorenulls=True).over(so_far)["version"].alias("version"),
        F.sum(F.when(F.col("starts") & F.col("version").isNotNull(), 1).otherwise(0)).over(so_far).alias("release_no"),
        F.col("parent_path").alias("above"),
    ).filter("version is not null and not starts")
    lists = blocks.filter("kind = 'item'").select("page_id", F.col("block_no").alias("item"))
    # the items around each row, outermost first
    around = blocks.select("page_id", "block_no", F.explode("above").alias("item")).join(lists, ["page_id", "item"])
    around = around.groupBy("page_id", "block_no").agg(F.sort_array(F.collect_list("item")).alias("items"))
    rows = blocks.join(around, ["page_id", "block_no"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<int>")))
    alone = (F.col("kind") == "para") & (F.size("above") == 0)
    entries = rows.filter((F.col("kind") == "item") | alone).withColumn("holder", F.try_element_at("items", F.lit(-1)))
    within = W.partitionBy("page_id", "release_no", "holder").orderBy("block_no")
    entries = entries.withColumn("place", (F.row_number().over(within) - 1).cast("int"))
    places = entries.select("page_id", F.col("block_no").alias("item"), "place")
    steps = entries.select("page_id", "block_no", F.explode(F.concat("items", F.array("block_no"))).alias("item"))
    paths = steps.join(places, ["page_id", "item"]).groupBy("page_id", "block_no").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("item", "place"))), lambda x: x["place"]).alias("path")
    )
    said = F.filter("spans", lambda s: ~s["kind"].isin("image", "callout"))
    texts = rows.filter("kind = 'para'").withColumn(
        "owner", F.coalesce(F.try_element_at("items", F.lit(-1)), F.when(alone, F.col("block_no")))
    ).filter("owner is not null")
    marked = F.array_join(F.transform(said, lambda s: F.when(s["style"] == "code", F.concat(F.lit("`"), F.trim(s["text"]), F.lit("`"))).otherwise(s["text"])), "")
    texts = texts.select("page_id", "owner", "block_no", "text", F.regexp_replace(marked, "``", "").alias("marked"))
    joined = texts.groupBy("page_id", F.col("owner").alias("block_no")).agg(
        *(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", c))), lambda x: x[c]), " ").alias(c) for c in ("text", "marked"))
    )

    def tidy(c: str) -> Column:
        return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))

    return entries.select("page_id", "block_no", "release_no", "version").join(paths, ["page_id", "block_no"]).join(
        joined, ["page_id", "block_no"], "left"
    ).select(
        "page_id", (F.col("release_no") - 1).cast("int").alias("release_no"), "version", "path",
        (F.size("path") - 1).alias("depth"), tidy("text").alias("text"), tidy("marked").alias("marked_text"),
    )


# -- columns backed by the tree ------------------------------------------------


def _by_page(html: Column, of_page: Callable[[str], str]) -> Column:
    """Row by row: a worker holds some hundred pages, not an Arrow batch of ten thousand and its results."""
    return F.udf(lambda page: None if page is None else of_page(page), T.StringType(), useArrow=False)(html)


def canonical_html(html: Column) -> Column:
    """Canonical markup of a page."""
    return _by_page(html, lambda page: markup.canonical(markup.parse(page)))


def exact_code_to_backticks(html: Column) -> Column:
    """Text of a page by the parser, with each outermost ``<code>`` in backticks."""
    return _by_page(html, lambda page: text_of(markup.parse(page), "`"))


def markup_duplicates(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Content hash of the canonical markup and how many pages share it."""
    hashed = cut(pages.select(key, F.sha2(canonical_html(F.col("html")), 256).alias("fingerprint")))  # pages are parsed once
    counts = hashed.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_pages"), F.min(key).alias("first_page"))
    return hashed.join(counts, "fingerprint")
