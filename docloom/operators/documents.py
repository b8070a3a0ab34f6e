"""Page and document operators over block, span and cell rows.

All rows of one page come from one source row, so windows and lists per page (or per table,
section and list of a page) are bounded by the size of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import first_sentence, normalize_ws

# What may stand between links in a list of links only.
LINK_ONLY = r"(?i)^[\s,.;:()]*(?:(?:and|or|see|also)[\s,.;:()]*)*$"
# Header lines of a requirements section, inherited notes.
REQUIREMENT_LINE = r"^(?:Convenience header|Header):\s*\S+$"
INHERITED = r"^Inherited from \S+\.?$"
# Layout limits of tables, navigation and summaries.
TABLE_GAP = 2
TABLE_MAX_WIDTH = 70
TABLE_NARROW = 20
TABLE_MIN_WRAP = 20
NAV_MAX_WORDS = 4
DECLARATION_MAX = 100
# Block classes outside the content.
BOILERPLATE = ("titlepage", "nav", "footer", "hr", "indexterm", "separator")
# The marker before "more" links in a declaration.
MORE_MARKER = "»"
# Sections a document starts with, in order.
HEAD_SECTIONS = ("NAME", "SYNOPSIS", "DESCRIPTION")


def word_count(s: Column) -> Column:
    text = normalize_ws(s)
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))


def is_link_only(text_outside_links: Column) -> Column:
    return normalize_ws(text_outside_links).rlike(LINK_ONLY)


def drop_nav_paragraphs(blocks: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """Blocks without short paragraphs around a single link to one of ``targets``.

    ``blocks``: (page_id, block_no, kind, outside), ``links``: (page_id, block_no, target).
    """
    single = links.groupBy("page_id", "block_no").agg(
        F.count(F.lit(1)).alias("_n"), F.first("target").alias("target")
    ).filter("_n = 1")
    hits = single.join(targets.select("target"), "target", "left_semi").select("page_id", "block_no")
    short = blocks.filter((F.col("kind") == "para") & (word_count(F.col("outside")) <= NAV_MAX_WORDS))
    drop = short.select("page_id", "block_no").join(hits, ["page_id", "block_no"], "left_semi")
    return blocks.join(drop, ["page_id", "block_no"], "left_anti")


def requirements_only(blocks: DataFrame, pattern: str = REQUIREMENT_LINE) -> DataFrame:
    """Per section: whether every block is a paragraph with a header line."""
    fits = (F.col("kind") == "para") & F.col("text").rlike(pattern)
    return blocks.groupBy("page_id", "section_no").agg(F.bool_and(fits).alias("requirements_only"))


def not_boilerplate(blocks: DataFrame) -> DataFrame:
    return blocks.filter(~F.coalesce(F.col("kind").isin(*BOILERPLATE), F.lit(False)))


def member_tables(cells: DataFrame) -> DataFrame:
    """Per table: header is exactly (Name, Description) and every row has two cells."""
    rows = cells.groupBy("page_id", "table_no", "row_no").agg(
        F.count(F.lit(1)).alias("n_cols"),
        F.bool_or("is_header").alias("is_header"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda c: c["text"]), "|").alias("labels"),
    )
    return rows.groupBy("page_id", "table_no").agg(
        (
            F.bool_and(F.col("n_cols") == 2)
            & F.bool_or(F.col("is_header") & (F.col("labels") == "Name|Description"))
        ).alias("is_member_table")
    )


def drop_marker_spans(spans: DataFrame, marker: str = MORE_MARKER) -> DataFrame:
    return spans.filter(~((F.col("kind") == "span") & F.startswith(F.col("text"), F.lit(marker))))


def leading_links(spans: DataFrame) -> DataFrame:
    """Per block, the link that starts it (only blanks before it)."""
    first = spans.filter(F.trim("text") != "").groupBy("page_id", "block_no").agg(
        F.min_by(F.struct("kind", "text", "target"), "span_no").alias("_s")
    )
    return first.filter(F.col("_s.kind") == "link").select("page_id", "block_no", "_s.text", "_s.target")


def links_in(spans: DataFrame) -> DataFrame:
    """Every link of each page with its place on the page (from 1)."""
    place = W.partitionBy("page_id").orderBy("block_no", "span_no")
    return spans.filter(F.col("kind") == "link").select(
        "page_id", F.row_number().over(place).cast("bigint").alias("link_no"), "target", "fragment"
    )


def declaration_blocks(blocks: DataFrame, links: DataFrame, part_pages: DataFrame) -> DataFrame:
    """Mark declarations (code linking to the page's parts) and drop each one's brief before it.

    ``links``: (page_id, block_no, target); ``part_pages``: (page_id, target).
    """
    hits = links.join(part_pages, ["page_id", "target"], "left_semi").select("page_id", "block_no").distinct()
    marked = blocks.join(hits.withColumn("_hit", F.lit(True)), ["page_id", "block_no"], "left").withColumn(
        "is_declaration", (F.col("kind") == "code") & F.coalesce("_hit", F.lit(False))
    )
    follow = W.partitionBy("page_id").orderBy("block_no")
    brief = (F.col("kind") == "para") & F.coalesce(F.lead("is_declaration").over(follow), F.lit(False))
    return marked.withColumn("_brief", brief).filter(~F.col("_brief")).drop("_brief", "_hit")


def sections_of(blocks: DataFrame) -> DataFrame:
    """Cut each page at its headings: section 0 is what precedes the first one; footnotes are
    set aside as section -1."""
    body = W.partitionBy("page_id").orderBy("block_no").rowsBetween(W.unboundedPreceding, 0)
    number = F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(body)
    return blocks.withColumn(
        "section_no", F.when(F.col("kind") == "footnotes", F.lit(-1)).otherwise(number).cast("bigint")
    )


def section_levels(sections: DataFrame, forced: int | None = None) -> DataFrame:
    """Shallowest heading level of the page becomes 1, deeper ones 2 (or all ``forced``)."""
    top = F.min("level").over(W.partitionBy("page_id"))
    level = F.lit(forced) if forced is not None else F.when(F.col("level") <= top, 1).otherwise(2)
    return sections.withColumn("out_level", level.cast("int"))


def summaries(blocks: DataFrame) -> DataFrame:
    """First sentence of the first real paragraph before any code or heading."""
    stops = blocks.groupBy("page_id").agg(
        F.min(F.when(F.col("kind").isin("code", "heading"), F.col("block_no"))).alias("_stop")
    )
    real = (F.col("kind") == "para") & (F.col("text") != "") & ~F.col("text").rlike(INHERITED)
    before = F.col("_stop").isNull() | (F.col("block_no") < F.col("_stop"))
    found = blocks.filter(real).join(stops, "page_id").filter(before)
    picked = found.groupBy("page_id").agg(F.min_by("text", "block_no").alias("text"))
    return picked.select("page_id", first_sentence(F.col("text")).alias("summary"))


def declaration_of(blocks: DataFrame) -> DataFrame:
    """Block number of the declaration: the first code block if only paragraphs precede it."""
    other = blocks.filter(F.col("kind") != "para").groupBy("page_id").agg(
        F.min_by(F.struct("kind", "block_no"), "block_no").alias("_b")
    )
    return other.filter(F.col("_b.kind") == "code").select("page_id", F.col("_b.block_no").alias("block_no"))


def member_table_tails(blocks: DataFrame, member: DataFrame) -> DataFrame:
    """Mark blocks after the last table of a section that starts with a member table.

    ``blocks`` carries section_no and table_no; ``member``: (page_id, table_no, is_member_table).
    """
    part = W.partitionBy("page_id", "section_no")
    body = blocks.filter(F.col("kind") != "heading")
    first = F.min_by(F.struct("kind", "table_no"), "block_no").over(part)
    last = F.max(F.when(F.col("kind") == "table", F.col("block_no"))).over(part)
    spread = body.withColumn("_f", first).withColumn("_last", last)
    starts = spread.filter(F.col("_f.kind") == "table").select(
        "page_id", "section_no", F.col("_f.table_no").alias("table_no")
    ).distinct()
    fits = starts.join(member.filter("is_member_table"), ["page_id", "table_no"], "left_semi")
    ok = fits.select("page_id", "section_no").withColumn("_ok", F.lit(True))
    return spread.join(ok, ["page_id", "section_no"], "left").select(
        *blocks.columns,
        (F.coalesce("_ok", F.lit(False)) & (F.col("section_no") > 0) & (F.col("block_no") > F.col("_last"))).alias("moved"),
    )


def see_also(links: DataFrame, named_inline: DataFrame) -> DataFrame:
    """Distinct linked documents of each page, without itself and those named inline, in
    (section, name) order. ``links``: (page, section, name); ``named_inline``: (page, name)."""
    rest = (
        links.select("page", "section", "name").distinct()
        .filter(F.col("name") != F.col("page"))
        .join(named_inline.select("page", "name"), ["page", "name"], "left_anti")
    )
    order = W.partitionBy("page").orderBy("section", "name")
    return rest.select(
        "page", "section", "name", F.row_number().over(order).cast("bigint").alias("seq"),
        F.lead("name").over(order).isNull().alias("is_last"),
    )


def table_profile(cells: DataFrame, by: list[str]) -> DataFrame:
    """Width profile of each table and the layout it gets. Cells: (…by, row_no, col_no, text)."""
    per_row = cells.groupBy(*by, "row_no").agg(F.count(F.lit(1)).alias("_n"))
    ragged = per_row.groupBy(*by).agg(
        F.max("_n").cast("bigint").alias("n_cols"), (F.min("_n") != F.max("_n")).alias("ragged")
    )
    columns = cells.groupBy(*by, "col_no").agg(F.max(F.length("text")).cast("bigint").alias("width"))
    # Width list of one table: as long as the table is wide.
    widths = columns.groupBy(*by).agg(
        F.sum("width").alias("_sum"),
        F.max_by("col_no", F.struct(F.col("width"), -F.col("col_no"))).alias("widest_col"),
        F.max("width").alias("widest"),
        F.array_sort(F.collect_list("width")).alias("_w"),
    )
    gaps = F.lit(TABLE_GAP) * (F.col("n_cols") - 1)
    second = F.try_element_at("_w", F.lit(-2))
    left_over = F.lit(TABLE_MAX_WIDTH) - (F.col("_sum") - F.col("widest")) - gaps
    layout = (
        F.when(F.col("ragged") | (F.col("n_cols") < 2), "rows")
        .when(F.col("_sum") + gaps <= TABLE_MAX_WIDTH, "table")
        .when((F.col("n_cols") >= 3) & (second <= TABLE_NARROW) & (left_over >= TABLE_MIN_WRAP), "wrap")
        .otherwise("rows")
    )
    return widths.join(ragged, by).select(
        *by, "n_cols", "ragged", (F.col("_sum") + gaps).alias("total_width"), "widest_col", layout.alias("layout")
    )


def records_from_table(cells: DataFrame, by: list[str]) -> DataFrame:
    """Body rows as a tag (first cell) and ``header: text`` for the other filled cells."""
    heads = cells.filter("is_header").select(*by, "col_no", F.col("text").alias("_h"))
    body = cells.filter(~F.col("is_header")).join(heads, [*by, "col_no"], "left")
    label = F.coalesce("_h", F.lit(""))
    part = F.when(label == "", F.col("text")).otherwise(F.concat(label, F.lit(": "), F.col("text")))
    filled = F.when((F.col("col_no") > 0) & (F.col("text") != ""), F.struct(F.col("col_no").alias("c"), part.alias("p")))
    # One table row: as many cells as the table has columns.
    return body.groupBy(*by, "row_no").agg(
        F.max(F.when(F.col("col_no") == 0, F.col("text"))).alias("tag"),
        F.array_join(F.transform(F.array_sort(F.collect_list(filled)), lambda x: x["p"]), "; ").alias("parts"),
    )


def index_by_category(headers: DataFrame, groups: DataFrame, widths: DataFrame) -> DataFrame:
    """Grid index: header columns spanning several body columns; entries per category and group.

    ``headers``: (page_id, table_no, header_no, title, span); ``groups``: (page_id, table_no,
    column_no, group_no, group_title, entry); ``widths``: (page_id, table_no, n_cols). A table
    whose spans do not add up to its columns raises when the result is read.
    """
    ends = W.partitionBy("page_id", "table_no").orderBy("header_no")
    placed = headers.withColumn("_end", F.sum("span").over(ends)).withColumn("_start", F.col("_end") - F.col("span"))
    columns = placed.select(
        "page_id", "table_no", "header_no", "title", F.explode(F.sequence(F.col("_start"), F.col("_end") - 1)).alias("column_no")
    )
    spans = headers.groupBy("page_id", "table_no").agg(F.sum("span").alias("_spans"))
    checked = widths.join(spans, ["page_id", "table_no"]).withColumn(
        "_ok",
        F.when(F.col("n_cols") == F.col("_spans"), F.lit(True)).otherwise(
            F.raise_error(F.format_string("index table %s has %s columns but its headers span %s",
                                          F.col("table_no").cast("string"), F.col("n_cols").cast("string"), F.col("_spans").cast("string")))
        ),
    )
    return (
        groups.join(columns, ["page_id", "table_no", "column_no"])
        .join(checked.filter("_ok").select("page_id", "table_no"), ["page_id", "table_no"])
        .select("page_id", "table_no", "header_no", F.col("title").alias("category"), "column_no", "group_no", "group_title", "entry")
    )


def render_documents(meta: DataFrame, blocks: DataFrame, see: DataFrame) -> DataFrame:
    """Text body of each document: NAME, SYNOPSIS, DESCRIPTION, sections, NOTES, SEE ALSO.

    ``meta``: (page_id, name, summary); ``blocks``: sectioned rows (page_id, block_no,
    section_no, kind, level, text); ``see``: (page_id, seq, name). The list that is joined
    holds the blocks of one page.
    """
    declared = declaration_of(blocks.filter("section_no = 0")).withColumn("_decl", F.lit(True))
    marked = section_levels(blocks).join(declared, ["page_id", "block_no"], "left")
    part = (
        F.when(F.coalesce("_decl", F.lit(False)), 1)
        .when(F.col("section_no") == 0, 2)
        .when(F.col("section_no") > 0, 3)
        .otherwise(4)
    )
    heading = F.when(F.col("out_level") == 1, F.upper("text")).otherwise(F.concat(F.lit("  "), F.col("text")))
    line = F.when(F.col("kind") == "heading", heading).otherwise(F.concat(F.lit("    "), F.col("text")))
    body = marked.select("page_id", part.alias("part"), F.col("block_no").cast("bigint").alias("ord"), line.alias("line"))
    titles = {1: "SYNOPSIS", 2: "DESCRIPTION", 4: "NOTES"}
    present = body.select("page_id", "part").distinct().filter(F.col("part").isin(*titles))
    title_map = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair])
    heads = present.select("page_id", "part", F.lit(-1).cast("bigint").alias("ord"), title_map[F.col("part")].alias("line"))
    name = meta.select(
        "page_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("ord"),
        F.concat(F.lit("NAME\n    "), F.col("name"), F.lit(" - "), F.col("summary")).alias("line"),
    )
    also = see.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]), ", ").alias("_names")
    ).select(
        "page_id", F.lit(5).alias("part"), F.lit(0).cast("bigint").alias("ord"),
        F.concat(F.lit("SEE ALSO\n    "), F.col("_names")).alias("line"),
    )
    rows = body.unionByName(heads).unionByName(name).unionByName(also)
    ordered = F.array_sort(F.collect_list(F.struct("part", "ord", "line")))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("body"))


def page_totals(documents: DataFrame) -> DataFrame:
    return documents.groupBy("section").agg(F.count(F.lit(1)).alias("n_documents"))


def block_text(spans: DataFrame) -> DataFrame:
    """Text of each block from its spans: markers and images left out, a figure's text kept."""
    kept = spans.filter(~F.col("kind").isin("callout", "image"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s["text"])
    return kept.groupBy("page_id", "block_no").agg(normalize_ws(F.array_join(pieces, "")).alias("text"))


def joined_terms(terms: DataFrame, by: list[str]) -> DataFrame:
    """Several terms of one definition as one text."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("term_no", "text"))), lambda t: t["text"])
    return terms.groupBy(*by).agg(F.array_join(ordered, ", ").alias("term"))
