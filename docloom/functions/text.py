"""Text columns: whitespace, sentences, truncation, code and HTML fragments, content keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as whitespace at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Longest text sent to a scorer, and how a cut text is marked.
TEXT_CAP = 9160
# A sentence ends at . ! or ? before a capital or the end, but not after
# e.g, i.e, etc or vs.
SENTENCE = (
    r"^(?s)(.*?(?<!\be\.g)(?<!\bi\.e)(?<!\betc)(?<!\bvs)[.!?])(?=\s+[A-Z(\"'`]|\s*$)"
)
# Columns between tab stops of a listing.
TAB_WIDTH = 8
# Elements whose text is never part of a page's text.
NON_TEXT_TAGS = ("rp", "rt", "script", "style", "template")
# The named characters the regular-expression text form decodes.
ENTITIES = (
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&hellip;", "…"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
)


def strip(s: Column) -> Column:
    """Leading and trailing Unicode whitespace removed (plain ``trim`` drops only blanks)."""
    return F.btrim(s, F.lit(WHITESPACE))


def normalize_ws(s: Column) -> Column:
    """Runs of Unicode whitespace become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def normalize_ws_ascii(s: Column) -> Column:
    """As :func:`normalize_ws` for ASCII whitespace only: a no-break space survives."""
    return F.trim(F.regexp_replace(s, r"[ \t\n\r\f\x0B]+", " "))


def first_sentence(s: Column) -> Column:
    flat = normalize_ws(s)
    found = F.regexp_extract(flat, SENTENCE, 1)
    return F.when(found == "", flat).otherwise(found)


def thousands(n: Column) -> Column:
    return F.format_number(n.cast("bigint"), 0)


def truncate_marked(s: Column, cap: int = TEXT_CAP) -> Column:
    cut = F.concat(
        F.substring(s, 1, cap),
        F.lit(" [... "),
        thousands(F.length(s) - cap),
        F.lit(" more characters truncated]"),
    )
    return F.when(F.length(s) > cap, cut).otherwise(s)


def code_to_backticks(html: Column) -> Column:
    """``<code>`` elements in backticks, other tags dropped, whitespace normalised."""
    ticked = F.regexp_replace(html, r"(?s)<code\b[^>]*>(.*?)</code>", "`$1`")
    return normalize_ws(F.regexp_replace(ticked, r"<[^>]*>", ""))


def expand_tabs(line: Column, width: int = TAB_WIDTH) -> Column:
    """A line with its tabs filled to the next multiple of ``width`` columns.

    A fold over the pieces between tabs: what is written so far gives the column, so each piece is
    filled by what its place asks for. A carriage return starts a new count; the last piece is
    followed by no tab.
    """
    pieces = F.split(line, "\t", -1)

    def fill(done: Column, piece: Column) -> Column:
        text = F.concat(done, piece)
        column = F.length(F.substring_index(text, "\r", -1))
        return F.rpad(text, F.length(text) + F.lit(width) - column % width, " ")

    filled = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.lit(""), fill)
    return F.when(F.contains(line, F.lit("\t")), F.concat(filled, F.element_at(pieces, -1))).otherwise(line)


def normalize_code(text: Column) -> Column:
    """Code listing: tabs to columns of eight, trailing blanks cut, outer empty lines dropped, empty runs collapsed."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.regexp_replace(expand_tabs(line), r"[ \r\f]+$", ""))
    joined = F.array_join(lines, "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def decode_entities(s: Column) -> Column:
    for name, char in ENTITIES:
        s = F.replace(s, F.lit(name), F.lit(char))
    return s


def main_content(html: Column) -> Column:
    """What the main container holds; null when the page has none (or is cut inside it)."""
    found = F.regexp_extract(html, r"(?s)<article>(.*)</article>", 1)
    return F.when(F.contains(html, F.lit("</article>")), found)


def result_key(version: Column, model: Column, effort: Column, text: Column) -> Column:
    """Content key of a scored text: SHA-256 over the settings and the stripped text."""
    digest = F.sha2(F.concat_ws("\n", version, model, effort, strip(text)), 256)
    # Declared non-null: else every join on the key hashes the text once more to test for null.
    return F.coalesce(digest, F.lit(""))


def quantity(n: Column, one: str, many: str | None = None) -> Column:
    """``1 entry`` / ``1,234 entries``."""
    plural = many if many is not None else one + "s"
    return F.concat(thousands(n), F.when(n == 1, F.lit(" " + one)).otherwise(F.lit(" " + plural)))


def short_error(s: Column) -> Column:
    """``a.b.C(d.E)`` becomes ``C(E)``."""
    return F.regexp_replace(s, r"[\w.]+\.(\w+)", "$1")


def link_text(text: Column, url: Column) -> Column:
    """``text <url>``, or only ``<url>`` when the text is empty or repeats it."""
    tagged = F.concat(F.lit("<"), url, F.lit(">"))
    return F.when((text == "") | (text == url), tagged).otherwise(F.concat(text, F.lit(" "), tagged))


def figure_label(alt: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(alt, F.lit("")), F.element_at(F.split(path, "/"), -1))


def list_label(kind: Column, start: Column, index: Column) -> Column:
    """Label of list item ``index`` (from 0): numbered lists count from ``start``."""
    number = F.concat((F.coalesce(start, F.lit(1)) + index).cast("string"), F.lit("."))
    return F.when(kind == "ol", number).otherwise(F.lit(""))
