"""Three-part versions as structs, which Spark compares field by field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import strip

VERSION_TYPE = "struct<major:int,minor:int,patch:int>"


def make_version(major: Column, minor: Column, patch: Column) -> Column:
    return F.struct(
        major.cast("int").alias("major"), minor.cast("int").alias("minor"), patch.cast("int").alias("patch")
    )


def version_literal(text: str) -> Column:
    major, minor, patch = (int(part) for part in text.split("."))
    return make_version(F.lit(major), F.lit(minor), F.lit(patch))


def parse_version(s: Column, prefix: str = "") -> Column:
    """``1.38.2``, ``v1-38-2`` or ``<prefix>-1.38.2`` as a struct; null when malformed."""
    head = rf"(?:{prefix}[-_])?" if prefix else ""
    pattern = rf"(?i)^{head}v?(\d+)[.\-_](\d+)[.\-_](\d+)$"
    text = strip(s)
    parts = [F.regexp_extract(text, pattern, i).try_cast("int") for i in (1, 2, 3)]
    return F.when(text.rlike(pattern) & parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(),
                  make_version(*parts))


def format_version(v: Column) -> Column:
    return F.concat_ws(".", v["major"], v["minor"], v["patch"])


def dashed(v: Column) -> Column:
    return F.concat_ws("-", v["major"], v["minor"], v["patch"])


def page_url(root: Column, version: Column, path: Column, anchor: Column) -> Column:
    """URL of a page inside a version's documentation root."""
    base = F.concat(root, F.lit("/"), dashed(version), F.lit("/doc/"), path)
    return F.when(F.coalesce(anchor, F.lit("")) == "", base).otherwise(F.concat(base, F.lit("#"), anchor))
