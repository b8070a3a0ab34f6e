"""Document names made from paths and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_encode(s: Column) -> Column:
    """``/ % \\``, control and non-ASCII characters as upper-case UTF-8 ``%XX``."""
    coded = r"[/%\\\x00-\x1f\x7f-\x{10ffff}]+"

    def one(t: Column) -> Column:
        # all coded runs of a text at once, parted by blanks, which are never coded themselves
        runs = F.array_join(F.regexp_extract_all(t, F.lit(coded), F.lit(0)), " ")
        escaped = F.split(F.regexp_replace(F.hex(F.encode(runs, "UTF-8")), "(..)", "%$1"), "%20", -1)
        between = F.split(t, coded, -1)
        return F.array_join(F.zip_with(between, escaped, lambda kept, run: F.concat(kept, F.coalesce(run, F.lit("")))), "")

    # a list of one, so that what ``s`` is made by is evaluated once
    return F.transform(F.array(s), one)[0]


def sanitize_name(s: Column) -> Column:
    """One component of a document name, safe as a file name."""
    text = F.replace(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")), F.lit("::"), F.lit("."))
    text = F.regexp_replace(text, r"(?U)(?<=\w) (?=\w)", "_")
    text = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit("+"))
    return percent_encode(text)


def path_to_name(rel: Column, root: str) -> Column:
    """``<root>/tutorial/tuttimer1.html`` -> ``<root>.tutorial.timer1``."""
    stem = F.regexp_replace(rel, r"\.html$", "")
    stem = F.regexp_replace(stem, rf"^{root}/(?=.)", "")
    stem = F.regexp_replace(stem, r"^tutorial/tut([^/]+)$", "tutorial/$1")
    stem = F.regexp_replace(stem, r"^examples/([^/]+)_examples$", "examples/$1")
    parts = F.transform(F.split(stem, "/"), sanitize_name)
    return F.concat_ws(".", F.lit(root), F.array_join(parts, "."))


def split_part(rel: Column) -> Column:
    """``struct(whole, number, is_listing, is_static)`` read from a page path."""
    overload = r"^(.+)/overload(\d+)\.html$"
    listing = r"^((?:.*/)?tutorial/[^/]+)/src\.html$"
    whole = (
        F.when(rel.rlike(overload), F.concat(F.regexp_extract(rel, overload, 1), F.lit(".html")))
        .when(rel.rlike(listing), F.concat(F.regexp_extract(rel, listing, 1), F.lit(".html")))
    )
    return F.struct(
        whole.alias("whole"),
        F.regexp_extract(rel, overload, 2).try_cast("int").alias("number"),
        rel.rlike(listing).alias("is_listing"),
        rel.rlike(r"__static\.html$").alias("is_static"),
    )


def ancestors(name: Column) -> Column:
    """Every proper dotted prefix of a name, shortest first."""
    parts = F.split(name, r"\.")
    count = F.size(parts)
    return F.when(
        count > 1,
        F.transform(F.sequence(F.lit(1), count - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")),
    ).otherwise(F.array().cast("array<string>"))
