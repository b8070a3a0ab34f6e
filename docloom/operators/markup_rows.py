"""Pages as token rows: tags, texts and comments with their place, and what running counters say of them.

Nothing here leaves DataFrame functions. ``tokens`` cuts every page into rows; windows over one page's
rows then find where elements end whose end tag is missing: a list item ends at its end tag, at the
next item of its list or where the list ends; a paragraph ends at the next tag of any block element.
Every opener so gives exactly one element, an interval of places (``enter``, ``leave``). Elements and the
tokens they hold stay rows of one table, so no tables are put together on the way.

``held_by`` says which items hold a token. An item holds what lies in its interval, so on every level of
nesting a token can only lie in the last item opened before it; that is a running value per
page and level, not a comparison of all intervals.

Pages are dealt to tasks by ``page_id`` once, before they are cut; windows and groupings over a page need
no further exchange. A page is one row of the input, so a task's window is bounded by a page.

Defined cases: a null or empty page has no tokens; an end tag without its opener ends nothing but a
paragraph; what is left open ends with the body; a ``<`` that starts no tag is text.
"""

from __future__ import annotations

import html.entities

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import normalize_ws

# Comments, elements whose content is not markup, tags, declarations, texts, a lone bracket.
TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"""|</?[a-z](?:[^>"']+|"[^"]*"|'[^']*')*>|<[!?/][^>]*>|[^<]+|<"""
)
# Markup that one task cuts into token rows, about: sorted rows take some thirty times as much memory.
TASK_BYTES = 8 << 20
# Tags that end an open paragraph.
BLOCK_TAGS = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul"
).split()
LIST_TAGS = ("ul", "ol")
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Blocks that are neither a paragraph, a list nor a mere wrapper.
OTHER_BLOCKS = ("blockquote", "dl", "figure", "form", "hr", "pre", "table", *HEADING_TAGS)
# Longest paragraph of a compact item.
COMPACT_MAX_TEXT = 90
HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _page(last: int = 0, *by: str):
    """A page's tokens up to this one, or up to the one before it (-1)."""
    return W.partitionBy("page_id", *by).orderBy("pos").rowsBetween(W.unboundedPreceding, last)


def _behind(*by: str):
    """A page's tokens after this one, the nearest last."""
    return W.partitionBy("page_id", *by).orderBy(F.col("pos").desc()).rowsBetween(W.unboundedPreceding, -1)


# -- character references ----------------------------------------------------------------


def _map(values: dict[str, str]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(F.lit, values.values())))


def decode_references(s: Column) -> Column:
    """``s`` with all character references decoded: numbers, names, and names whose semicolon is missing
    (the longest that fits)."""
    known = html.entities.html5
    without = {name: char for name, char in known.items() if not name.endswith(";")}
    names, old = _map(known), _map(without)
    # numbers that mean a character of another code page
    moved = _map({str(k): bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(128, 160)})
    longest = max(map(len, without))
    pieces = F.regexp_extract_all(s, F.lit(r"&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"), F.lit(0))

    def of_number(p: Column) -> Column:
        digits = F.regexp_extract(p, "([0-9A-Fa-f]+);?$", 1)
        hexed = p.rlike("^&#[xX]")
        # longer numbers are beyond all characters
        short = F.length(F.ltrim(digits, F.lit("0"))) <= F.when(hexed, 8).otherwise(10)
        code = F.when(hexed, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        valid = short & (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        own = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(valid, F.coalesce(F.try_element_at(moved, code.cast("string")), own)).otherwise("�")

    def of_name(p: Column) -> Column:
        name = F.substr(p, F.lit(2))
        fits = [
            F.concat(F.try_element_at(old, F.substring(name, 1, n)), F.substr(name, F.lit(n + 1))) for n in range(longest, 1, -1)
        ]
        # the usual names first: a map is searched from end to end
        usual = F
        for text, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
            usual = usual.when(p == text, char)
        return usual.otherwise(F.coalesce(F.try_element_at(names, name), *fits, p))

    def one(p: Column) -> Column:
        return F.when(p.rlike("^&#"), of_number(p)).when(p.rlike("^&[A-Za-z]"), of_name(p)).otherwise(p)

    return F.when(F.contains(s, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(s)


def whole_references(s: Column) -> Column:
    """``s`` with each ``&`` escaped that begins no reference with a semicolon: a name that was cut off stays text."""
    return F.regexp_replace(s, r"&(?!(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)", "&amp;")


def escape_text(s: Column) -> Column:
    """``s`` as text of a page; :func:`decode_references` gives it back."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(char), F.lit(name))
    return s


# -- tokens ------------------------------------------------------------------------------


def _dealt(pages: DataFrame) -> DataFrame:
    """Pages dealt by ``page_id`` to tasks of about ``TASK_BYTES`` of markup, however many there are: the number is
    counted, and a number that is given is kept (without one, tasks would grow with the input)."""
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    return pages.repartition(max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), "page_id")


def tokens(pages: DataFrame) -> DataFrame:
    """``page_id, pos, piece, tag, closing`` of (page_id, html), and what holds at each place:

    ``level``: lists around the token, a list's own tags included; ``list_at``: the opener of the list of
    that level; ``leave``: where the item or paragraph opened here ends; ``block_no``: block tags so
    far; ``link``: place and target of the link that the token lies in.
    """
    dealt = _dealt(pages.select("page_id", "html"))
    cut = dealt.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("pos", "piece"))
    name = F.lower(F.regexp_extract("piece", r"^</?([A-Za-z][^\s/>]*)", 1))
    rows = cut.withColumns({"tag": name, "closing": F.startswith("piece", F.lit("</"))})
    is_list, closing = F.col("tag").isin(*LIST_TAGS), F.col("closing")
    rows = rows.withColumn("_sum", F.sum(F.when(is_list, F.when(closing, -1).otherwise(1)).otherwise(0)).over(_page()))
    # end tags without a list do not count: the depth is measured from the lowest sum so far
    rows = rows.withColumn("_low", F.least(F.lit(0), F.coalesce(F.min("_sum").over(_page(-1)), F.lit(0))))
    rows = rows.withColumn("_stray", is_list & closing & (F.col("_sum") < F.col("_low")))
    depth = F.col("_sum") - F.least("_low", "_sum") + F.when(is_list & closing & ~F.col("_stray"), 1).otherwise(0)
    target = F.coalesce(*(F.nullif(F.regexp_extract("piece", HREF, k), F.lit("")) for k in (1, 2, 3)), F.lit(""))
    # a link ends at its end tag, at another link, or with its item or paragraph
    link = F.when(
        F.col("tag").isin("a", "li", "p"),
        F.struct(F.when((F.col("tag") == "a") & ~closing & F.col("piece").rlike(HREF), F.struct("pos", target.alias("target"))).alias("l")),
    )
    block = F.col("tag").isin(*BLOCK_TAGS)
    ended = F.min(F.when(F.col("tag").isin("body", "html") & closing, F.col("pos"))).over(W.partitionBy("page_id"))
    rows = rows.select(
        "page_id", "pos", "piece", "tag", "closing", depth.cast("int").alias("level"),
        F.sum(F.when(block, 1).otherwise(0)).over(_page()).alias("block_no"),
        F.coalesce(ended, F.max("pos").over(W.partitionBy("page_id")) + 1).alias("_end"),
        F.last(link, ignorenulls=True).over(_page())["l"].alias("link"),
        (is_list & closing & ~F.col("_stray")).alias("_ends"),
        F.last(F.when(block, F.col("pos")), ignorenulls=True).over(_behind()).alias("_block"),
    )
    end = F.greatest("_end", F.col("pos") + 1)
    return rows.withColumns({
        "_item": F.last(F.when((F.col("tag") == "li") | F.col("_ends"), F.col("pos")), ignorenulls=True).over(_behind("level")),
        "list_at": F.last(F.when(is_list & ~closing, F.col("pos")), ignorenulls=True).over(_page(0, "level")),
    }).select(
        "page_id", "pos", "piece", "tag", "closing", "level", "block_no", "link", "list_at",
        F.when(closing, None).when(F.col("tag") == "li", F.coalesce("_item", end)).when(F.col("tag") == "p", F.coalesce("_block", end)).alias("leave"),
    )


def is_text() -> Column:
    """Whether a token is text of the page."""
    return (F.col("tag") == "") & (~F.startswith("piece", F.lit("<")) | (F.col("piece") == "<"))


def held_by(rows: DataFrame, wanted: Column, kinds: tuple[str, ...] = ("li",), proper: bool = False) -> DataFrame:
    """The ``wanted`` tokens, once for every element of ``kinds`` that holds them: ``enter``, ``depth``.

    ``proper``: an element's own opener does not lie in it.
    """

    def entry(kind: str, depth: Column, opens: bool) -> Column:
        return F.struct(F.lit(kind).alias("kind"), depth.alias("depth"), F.lit(opens).alias("opens"))

    inside = [F.transform(F.sequence(F.lit(0), F.col("level")), lambda d: entry("li", d, False)) if k == "li" else F.array(entry(k, F.lit(0), False)) for k in kinds]
    none = F.slice(inside[0], 1, 0)
    opens = F.col("leave").isNotNull() & F.col("tag").isin(*kinds)
    own = F.array(F.struct(F.col("tag").alias("kind"), F.when(F.col("tag") == "li", F.col("level")).otherwise(0).alias("depth"), F.lit(True).alias("opens")))
    entries = F.concat(F.when(opens, own).otherwise(none), F.when(wanted, F.concat(*inside)).otherwise(none))
    spread = rows.select("*", F.explode(entries).alias("_x"))
    # an opener comes before a token of the same place, unless the token must lie inside
    order = [F.col("pos"), F.col("_x.opens").asc() if proper else F.col("_x.opens").desc()]
    run = W.partitionBy("page_id", "_x.kind", "_x.depth").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_x.opens"), F.struct(F.col("pos").alias("enter"), "leave")), ignorenulls=True).over(run)
    found = spread.withColumn("_e", last).where("not _x.opens and pos < _e.leave")
    return found.select(*rows.columns, F.col("_e.enter").alias("enter"), F.col("_x.depth").alias("depth"))


def fragments(rows: DataFrame) -> DataFrame:
    """``page_id, enter, leave, tag, block_no``: items and paragraphs, closed or not, numbered from 1 in page order."""
    place = F.row_number().over(W.partitionBy("page_id").orderBy("pos")).cast("bigint")
    return rows.where("leave is not null").select("page_id", F.col("pos").alias("enter"), "leave", "tag", place.alias("block_no"))


def spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Texts of every fragment: ``page_id, block_no, span_no, kind, text, target``; a link's texts are one span."""
    held = held_by(rows.drop("block_no"), is_text(), ("li", "p"))
    owned = held.join(found.select("page_id", "enter", "block_no"), ["page_id", "enter"])
    # a link that began before the fragment is none of its own
    link = F.when(F.col("link.pos") > F.col("enter"), F.col("link"))
    grouped = owned.withColumn("link", link).groupBy("page_id", "block_no", F.coalesce("link.pos", "pos").alias("span_no"))
    return grouped.agg(joined("piece").alias("text"), F.first("link").alias("link")).select(
        "page_id", "block_no", "span_no",
        F.when(F.col("link").isNull(), "text").when(F.col("link.target").rlike(SCHEME), "external").otherwise("link").alias("kind"),
        decode_references(F.col("text")).alias("text"), F.coalesce("link.target", F.lit("")).alias("target"),
    )


def joined(text: str, order: str = "pos", between: str = "") -> Column:
    """Aggregate: the texts of a group, all of one page, one after the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), between)


def outside_links(found: DataFrame, texts: DataFrame) -> DataFrame:
    """``found`` with ``outside``: each fragment's text outside its in-corpus links."""
    rest = texts.where("kind <> 'link'").groupBy("page_id", "block_no").agg(joined("text", "span_no").alias("outside"))
    return found.join(rest, ["page_id", "block_no"], "left").withColumn(
        "outside", F.coalesce(normalize_ws(F.col("outside")), F.lit(""))
    )


def innermost(held: DataFrame) -> DataFrame:
    """Of ``held_by``'s rows, the ones of the innermost element."""
    deepest = F.max("depth").over(W.partitionBy("page_id", "pos"))
    return held.withColumn("_d", deepest).where("depth = _d").drop("_d")


def compact_lists(rows: DataFrame, limit: int = COMPACT_MAX_TEXT) -> DataFrame:
    """``page_id, list_no, n_items, compact`` of every list that has items.

    An item is compact if it starts with its only paragraph, of at most ``limit`` characters, holds
    nothing else but lists, and all items nested in it are compact. A list is if all its items are.
    """
    wanted = is_text() | (~F.col("closing") & F.col("tag").isin(*OTHER_BLOCKS, *LIST_TAGS))
    own = innermost(held_by(rows, wanted))
    text = F.when(F.col("tag") == "", normalize_ws(F.col("text")))
    parts = own.groupBy("page_id", "enter", "block_no", "tag").agg(joined("piece").alias("text"), F.min("pos").alias("pos"))
    parts = parts.withColumn("text", F.length(decode_references(text))).where("tag <> '' or text > 0")
    is_list = F.col("tag").isin(*LIST_TAGS)
    shape = parts.groupBy("page_id", "enter").agg(
        F.count_if(F.col("tag") == "").alias("paras"), F.max("text").alias("longest"),
        F.count_if((F.col("tag") != "") & ~is_list).alias("others"),
        F.min(F.when(F.col("tag") == "", F.col("pos"))).alias("para_at"), F.min(F.when(is_list, F.col("pos"))).alias("list_at"),
    )
    fits = F.expr(f"paras = 1 and longest <= {limit} and others = 0 and (list_at is null or para_at < list_at)")
    # an item answers for everything nested in it
    nested = held_by(rows, F.col("leave").isNotNull() & (F.col("tag") == "li")).select("page_id", "enter", F.col("pos").alias("item"))
    judged = nested.join(shape.select("page_id", F.col("enter").alias("item"), fits.alias("fits")), ["page_id", "item"], "left")
    whole = judged.groupBy("page_id", "enter").agg(F.bool_and(F.coalesce("fits", F.lit(False))).alias("compact"))
    items = rows.where("tag = 'li' and leave is not null and level > 0 and list_at is not null").select("page_id", F.col("pos").alias("enter"), "list_at")
    lists = items.join(whole, ["page_id", "enter"])
    found = lists.groupBy("page_id", "list_at").agg(F.count("*").alias("n_items"), F.bool_and("compact").alias("compact"))
    number = F.row_number().over(W.partitionBy("page_id").orderBy("list_at")).cast("bigint")
    return found.select("page_id", number.alias("list_no"), "n_items", "compact")


# -- texts and entries ---------------------------------------------------------------------


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of every page: no comments, scripts, styles, templates or ruby notes."""
    rows = tokens(pages)
    template = F.when(F.col("tag") == "template", F.when(F.col("closing"), -1).otherwise(1)).otherwise(0)
    # a note ends at its end tag, at the next note or with its ruby
    note = F.when(F.col("tag").isin("rt", "rp", "ruby"), F.struct((F.col("tag").isin("rt", "rp") & ~F.col("closing")).alias("n")))
    seen = rows.withColumns({"_sum": F.sum(template).over(_page()), "_note": F.last(note, ignorenulls=True).over(_page())["n"]})
    seen = seen.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(_page())))
    kept = is_text() & (F.col("_sum") == F.col("_low")) & ~F.coalesce("_note", F.lit(False))
    texts = seen.where(kept).groupBy("page_id").agg(joined("piece").alias("text"))
    return pages.select("page_id", F.col("html").isNotNull().alias("_given")).join(texts, "page_id", "left").select(
        "page_id", F.when(F.col("_given"), F.coalesce(normalize_ws(decode_references(F.col("text"))), F.lit(""))).alias("text")
    )


def release_entries(pages: DataFrame, heading: str) -> DataFrame:
    """Entries of change-log pages: ``page_id, release_no, version, path, depth, text``.

    A release reaches from a heading that ``heading`` matches (its group is the version) to the next
    heading of a level that releases have on the page. Its entries are the list items, numbered within
    the item that holds them, and texts outside lists; an entry's text leaves out nested items.

    Pages are cut and moved once: what a row needs of others of its page it finds by windows and groupings
    over the page, not by joins. A page without an id has no entries.
    """
    rows = tokens(pages.where("page_id is not null"))
    is_head = F.col("tag").isin(*HEADING_TAGS)
    state = F.last(F.when(is_head, F.struct("pos", "tag", "closing")), ignorenulls=True).over(_page())
    rows = rows.select("page_id", "pos", "piece", "tag", "closing", "level", "leave", "block_no", state.alias("_head"))
    inside = F.coalesce(~F.col("_head.closing"), F.lit(False))
    rows = rows.withColumns({"_said": is_text() & ~inside, "_titled": is_text() & inside})
    # a heading's title, at its opener; one without text is none
    of_head = W.partitionBy("page_id", "_head.pos", "_head.tag")
    title = F.when(F.col("_titled"), F.struct("pos", "piece"))
    rows = rows.withColumn("_title", F.when(is_head & ~F.col("closing"), F.collect_list(title).over(of_head)))
    rows = rows.where("_said or _title is not null or (tag = 'li' and leave is not null)")
    rows = rows.withColumn("_text", F.array_join(F.transform(F.array_sort("_title"), lambda x: x["piece"]), ""))
    version = F.nullif(F.regexp_extract(normalize_ws(decode_references(F.col("_text"))), heading, 1), F.lit(""))
    rows = rows.withColumn("_version", F.when(F.size("_title") > 0, version))
    # of openers at one place, which only pages of one id have, one counts
    again = F.row_number().over(W.partitionBy("page_id", "pos").orderBy("pos")) > 1
    ranks = F.collect_set(F.when(F.col("_version").isNotNull(), F.col("tag"))).over(W.partitionBy("page_id"))
    rows = rows.withColumns({"_again": again, "_starts": (F.size("_title") > 0) & F.array_contains(ranks, F.col("tag"))})
    so_far = W.partitionBy("page_id").orderBy("pos").rangeBetween(W.unboundedPreceding, W.currentRow)
    number = F.sum(F.when(F.col("_starts") & F.col("_version").isNotNull() & ~F.col("_again"), 1).otherwise(0)).over(so_far) - 1
    running = F.last(F.when(F.col("_starts"), F.struct(F.col("_version").alias("version"))), ignorenulls=True).over(so_far)
    is_item = (F.col("tag") == "li") & F.col("leave").isNotNull()
    rows = rows.select(
        "page_id", "pos", F.when(F.col("_said"), F.col("piece")).alias("piece"), "level", "leave", "block_no",
        is_item.alias("is_item"), "_said", running["version"].alias("version"), number.cast("int").alias("release_no"),
    ).where("version is not null and (is_item or _said)")

    # the items around each row, outermost first; ``n``: rows at this place
    around = F.transform(F.sequence(F.lit(0), F.col("level")), lambda d: F.struct(d.alias("depth"), F.lit(False).alias("opens")))
    own = F.when(F.col("is_item"), F.array(F.struct(F.col("level").alias("depth"), F.lit(True).alias("opens")))).otherwise(F.slice(around, 1, 0))
    spread = rows.select("*", F.explode(F.concat(around, own)).alias("_x"))
    spread = spread.withColumn("piece", F.when(F.col("_x.depth") == 0, F.col("piece")))
    run = W.partitionBy("page_id", "_x.depth").orderBy("pos", "_x.opens").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_x.opens"), F.struct(F.col("pos").alias("enter"), "leave")), ignorenulls=True).over(run)
    held = spread.withColumn("_e", last).where("not _x.opens")
    rows = held.groupBy("page_id", "pos").agg(
        *(F.first(c).alias(c) for c in ("block_no", "is_item", "version", "release_no")),
        F.array_sort(F.collect_list(F.when(F.expr("pos < _e.leave"), F.col("_e.enter")))).alias("above"),
        F.collect_list(F.when(F.col("_x.depth") == 0, F.col("piece"))).alias("pieces"), F.count_if(F.col("_x.depth") == 0).alias("n"),
    )

    # entries: items, and stretches of text outside them
    owner = F.try_element_at("above", F.lit(-1))
    loose = F.min(F.when(~F.col("is_item") & owner.isNull(), F.col("pos"))).over(W.partitionBy("page_id", "block_no"))
    rows = rows.withColumn("entry", F.when(F.col("is_item"), F.col("pos")).otherwise(F.coalesce(owner, loose)))
    said = F.flatten(F.array_repeat("pieces", F.when(owner.isNull(), 1).otherwise(F.col("n")).cast("int")))
    at = F.col("pos") == F.col("entry")
    entries = rows.withColumn("pieces", F.when(F.size("pieces") > 0, F.struct("pos", F.array_sort(said).alias("pieces")))).groupBy("page_id", "entry").agg(
        F.first(F.when(at, F.struct("is_item", "version", "release_no", "above", "n")), ignorenulls=True).alias("_e"),
        F.array_sort(F.collect_list("pieces")).alias("_said"),
    )
    # joined before they are decoded, which looks at a text several times
    entries = entries.withColumn("text", F.array_join(F.flatten(F.transform("_said", lambda x: x["pieces"])), ""))
    entries = entries.select("page_id", F.col("entry").alias("pos"), "_e.*", normalize_ws(decode_references(F.col("text"))).alias("text"))
    entries = entries.where("is_item or text <> ''")

    # an entry's place within the item that holds it, then the places of all items around it
    within = W.partitionBy("page_id", "release_no", F.try_element_at("above", F.lit(-1))).orderBy("pos")
    place = F.sum("n").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    entries = entries.withColumn("place", place.cast("int"))
    steps = entries.select("*", F.explode(F.concat("above", F.array("pos"))).alias("step"))
    found = F.first(F.when(F.col("pos") == F.col("step"), F.struct("place", "n")), ignorenulls=True).over(W.partitionBy("page_id", "step"))
    places = F.sequence(F.col("_p.place"), (F.col("_p.place") + F.col("_p.n") - 1).cast("int"))
    placed = F.transform(places, lambda p: F.struct("step", p.alias("place")))
    paths = steps.withColumn("_p", found).withColumn("_p", F.flatten(F.array_repeat(placed, F.col("n").cast("int"))))
    paths = paths.groupBy("page_id", "pos").agg(
        *(F.first(c).alias(c) for c in ("release_no", "version", "text", "n")),
        F.transform(F.array_sort(F.flatten(F.collect_list("_p"))), lambda x: x["place"]).alias("path"),
    )
    paths = paths.withColumn("_n", F.explode(F.sequence(F.lit(1), "n")))
    return paths.select(
        "page_id", "release_no", "version", "path", (F.size("path") - 1).alias("depth"), F.coalesce("text", F.lit("")).alias("text")
    )
