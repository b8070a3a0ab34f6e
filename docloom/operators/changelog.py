"""Change-log operators: version ranges, attached classifications, grouping, entry trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import quantity
from docloom.functions.versions import format_version, version_literal
from docloom.operators.ordered import TEXT_WIDTH, chunk_of, neighbour_values, sorted_ordinal, with_ordinal

# Groups of a diff, in display order, with their headings.
GROUPS = (
    ("breaking", 1, "Breaking"),
    ("deprecated", 2, "Deprecated"),
    ("added", 3, "Added"),
    ("changed", 4, "Changed"),
    ("fixed", 5, "Fixed"),
    ("other", 6, "Other"),
)
UNCLASSIFIED = "pending"


def group_dimension(spark) -> DataFrame:
    rows = ", ".join(f"('{grp}', {rank}, '{heading}')" for grp, rank, heading in GROUPS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS groups(grp, grp_rank, heading)")


def version_range(df: DataFrame, first: str, second: str, column: str = "version") -> DataFrame:
    """Rows in ``(older, newer]``; the two ends may come in either order."""
    if first == second:
        raise ValueError(f"the two versions are the same: {first}")
    a, b = version_literal(first), version_literal(second)
    low, high = F.least(a, b), F.greatest(a, b)
    return df.filter((F.col(column) > low) & (F.col(column) <= high))


def nearest_known(probes: DataFrame, known: DataFrame, key: str = "vnum") -> DataFrame:
    """Largest known key below and smallest known key above every probe (as-of, both ways).

    Keys are whole numbers. Known keys are cut into ranges; a probe looks into its own range
    and, past its ends, at the nearest non-empty ranges: equi-joins only.
    """
    width = 1 << 16
    known = known.select(F.col(key).alias("_k")).distinct().withColumn("_r", chunk_of("_k", width))
    mine = probes.select(key).distinct().withColumn("_r", chunk_of(key, width))
    # Both sides in one ordered stream, per range; unique because of the kind flag.
    both = known.select("_r", F.col("_k").alias("_x"), F.lit(1).alias("_known")).unionByName(
        mine.select("_r", F.col(key).alias("_x"), F.lit(0).alias("_known"))
    )
    lows = W.partitionBy("_r").orderBy("_x").rangeBetween(W.unboundedPreceding, -1)
    highs = W.partitionBy("_r").orderBy("_x").rangeBetween(1, W.unboundedFollowing)
    hit = F.when(F.col("_known") == 1, F.col("_x"))
    local = both.select(
        "_r", "_x", "_known", F.max(hit).over(lows).alias("_lo"), F.min(hit).over(highs).alias("_hi")
    ).filter(F.col("_known") == 0)
    # One row per range that holds anything; ranges are 65,536 versions wide.
    ends = _beyond(both.groupBy("_r").agg(F.min(hit).alias("_min"), F.max(hit).alias("_max")), 2)
    return local.join(ends, "_r").select(
        F.col("_x").alias(key),
        F.coalesce("_lo", "_prev").alias("nearest_lower"),
        F.coalesce("_hi", "_next").alias("nearest_higher"),
    )


def _beyond(ends: DataFrame, level: int) -> DataFrame:
    """Per range, the largest known key before it and the smallest after it (``_prev``, ``_next``).

    Ranges are looked at 65,536 at a time, and the rest through wider ranges of the same kind.
    """
    above = chunk_of("_r", 1 << 16) if level else F.lit(0).cast("bigint")
    placed = ends.withColumn("_above", above)
    order = W.partitionBy("_above").orderBy("_r")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    near = placed.select("_r", "_above", F.max("_max").over(before).alias("_prev"), F.min("_min").over(after).alias("_next"))
    if not level:
        return near.drop("_above")
    wider = placed.groupBy(F.col("_above").alias("_r")).agg(F.min("_min").alias("_min"), F.max("_max").alias("_max"))
    far = _beyond(wider, level - 1).select(F.col("_r").alias("_above"), F.col("_prev").alias("_p"), F.col("_next").alias("_n"))
    return near.join(far, "_above").select(
        "_r", F.coalesce("_prev", "_p").alias("_prev"), F.coalesce("_next", "_n").alias("_next")
    )


def unknown_versions(wanted: DataFrame, entries: DataFrame, key: str = "vnum") -> DataFrame:
    """The wanted versions that no entry has, with the nearest lower and higher one that exist."""
    known = entries.select(key).distinct()
    return nearest_known(wanted.join(known, key, "left_anti"), known, key)


def checked_range(df: DataFrame, first: str, second: str, column: str = "version") -> tuple[DataFrame, bool]:
    """``version_range`` of versions that must exist, and whether the ends came newest first.

    An unknown end is an error that names its nearest neighbours. One aggregation checks both.
    """
    sums = []
    for place, text in enumerate((first, second)):
        at, own = version_literal(text), F.col(column)
        sums += [
            F.coalesce(F.bool_or(own == at), F.lit(False)).alias(f"known{place}"),
            format_version(F.max(F.when(own < at, own))).alias(f"below{place}"),
            format_version(F.min(F.when(own > at, own))).alias(f"above{place}"),
        ]
    found = df.agg(*sums).first()
    for place, text in enumerate((first, second)):
        if not found[f"known{place}"]:
            near = [found[f"{side}{place}"] or "none" for side in ("below", "above")]
            raise ValueError(f"no entries for version {text}; nearest below: {near[0]}, nearest above: {near[1]}")
    older, newer = ([int(part) for part in text.split(".")] for text in (first, second))
    return version_range(df, first, second, column), older > newer


def attach_classification(items: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """Every item with its stored result (nulls when there is none)."""
    return items.join(store, key, "left")


def pending_items(items: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    return items.join(store.select(key), key, "left_anti")


def dedupe_first(items: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """One row per key: the values of its first appearance."""
    return items.groupBy(key).agg(
        F.min(order).alias(order), *[F.min_by(v, order).alias(v) for v in values]
    )


def diff_group(category: Column, breaking: Column) -> Column:
    return F.when(breaking, F.lit("breaking")).otherwise(F.coalesce(category, F.lit(UNCLASSIFIED)))


def group_entries(diff: DataFrame, order: str = "entry_no") -> DataFrame:
    """One row per entry with its group, the group's rank and the place inside the group.

    ``order`` is a whole number, unique and rising with (release, page order). Groups without
    entries come back as one row with ``seq`` 0; entries without a result form a last group.
    """
    dims = group_dimension(diff.sparkSession)
    grouped = diff.withColumn("grp", diff_group(F.col("category"), F.col("breaking")))
    placed = with_ordinal(grouped, ["grp"], order, width=TEXT_WIDTH)
    # Six fixed rows: the dimension is the broadcast side.
    ranked = placed.join(F.broadcast(dims), "grp", "left").withColumn("grp_rank", F.coalesce("grp_rank", F.lit(7))).withColumn(
        "heading", F.coalesce("heading", F.initcap("grp"))
    )
    present = grouped.select("grp").distinct()
    empty = dims.join(present, "grp", "left_anti").withColumn("seq", F.lit(0).cast("bigint"))
    return ranked.unionByName(empty, allowMissingColumns=True)


def group_counts(diff: DataFrame) -> DataFrame:
    """Entries and releases per group in fixed order (empty groups kept), and in total."""
    dims = group_dimension(diff.sparkSession)
    marked = diff.select(diff_group(F.col("category"), F.col("breaking")).alias("grp"), "version")
    # (group, release) first: the counts are small before any distinct is taken.
    pairs = marked.groupBy("grp", "version").agg(F.count(F.lit(1)).alias("n"))
    per = pairs.groupBy("grp").agg(F.sum("n").alias("n_entries"), F.count(F.lit(1)).alias("n_releases"))
    listed = F.broadcast(dims).join(per, "grp", "full_outer").select(
        "grp",
        F.coalesce("grp_rank", F.lit(7)).alias("grp_rank"),
        F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
        F.coalesce("n_releases", F.lit(0)).alias("n_releases"),
    )
    total = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_entries"), F.count_distinct("version").alias("n_releases")
    ).select(F.lit("total").alias("grp"), F.lit(0).alias("grp_rank"), "n_entries", "n_releases")
    return listed.unionByName(total)


def diff_header(diff: DataFrame, first: str, second: str) -> DataFrame:
    """One row on top of a diff: versions, releases, entries, and the non-empty groups' counts."""
    older, newer = sorted((first, second), key=lambda v: tuple(int(part) for part in v.split(".")))
    counts = group_counts(diff)
    name = F.initcap("grp")  # at most eight rows
    shown = F.when((F.col("grp_rank") > 0) & (F.col("n_entries") > 0), F.struct("grp_rank", F.concat(name, F.lit(" "), F.col("n_entries").cast("string")).alias("t")))
    total = lambda c: F.max(F.when(F.col("grp") == "total", F.col(c)))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["t"]), ", ")
    return counts.agg(total("n_releases").alias("n_releases"), total("n_entries").alias("n_entries"), listed.alias("counts")).select(
        F.lit(older).alias("from_version"), F.lit(newer).alias("to_version"), "n_releases", "n_entries", "counts"
    )


def release_coverage(entries: DataFrame, store: DataFrame, by: str = "version", key: str = "key") -> DataFrame:
    """Per release: its entries and how many already have a stored result."""
    known = store.select(key).distinct().withColumn("_has", F.lit(1))
    # Same text in one release: counted once per copy after a pre-aggregation by key.
    copies = entries.groupBy(by, key).agg(F.count(F.lit(1)).alias("_n"))
    return copies.join(known, key, "left").groupBy(by).agg(
        F.sum("_n").alias("n_entries"),
        F.sum(F.when(F.col("_has") == 1, F.col("_n")).otherwise(F.lit(0))).alias("n_classified"),
    )


def release_index(entries: DataFrame, by: str = "version") -> DataFrame:
    """Releases newest first, each with its entry count as a label."""
    per = entries.groupBy(by).agg(F.count(F.lit(1)).alias("n_entries"))
    return sorted_ordinal(per, [F.col(by).desc()], "position").select(
        "position",
        format_version(F.col(by)).alias("version"),
        quantity(F.col("n_entries"), "entry", "entries").alias("label"),
    )


def release_neighbours(releases: DataFrame, order: str = "vnum") -> DataFrame:
    """Previous and next release of each release."""
    return neighbour_values(releases, [], order, order, "previous", "next")


def flatten_entry(children: DataFrame, by: str = "page_ord") -> DataFrame:
    """Own text and descendants of each entry, one line per node, indented and dashed."""
    prefix = F.when(F.col("depth") > 0, F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "))).otherwise(F.lit(""))
    lines = children.select(by, "path", F.concat(prefix, F.col("text")).alias("line"))
    # One entry's nodes come from one source row.
    ordered = F.array_sort(F.collect_list(F.struct("path", "line")))
    return lines.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("full_text"))


def nest_children(nodes: DataFrame, by: str = "page_ord") -> DataFrame:
    """Every node with the texts of its direct children, in order."""
    parent = F.slice("path", F.lit(1), F.size("path") - 1)
    kids = nodes.filter(F.size("path") > 1).select(by, parent.alias("path"), F.col("path").alias("_p"), F.col("text").alias("_t"))
    lists = kids.groupBy(by, "path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda x: x["_t"]).alias("children")
    )
    return nodes.join(lists, [by, "path"], "left").withColumn(
        "children", F.coalesce("children", F.array().cast("array<string>"))
    )


def diff_json_lines(diff: DataFrame, order: str = "entry_no") -> DataFrame:
    """JSON lines of a grouped diff: one object per entry, to be sorted by (grp_rank, seq)."""
    body = F.to_json(F.struct(
        F.col("version_text").alias("release"), "category", "breaking",
        F.coalesce("breaking_reason", F.lit("")).alias("breaking_reason"), "text", "children",
    ), {"ignoreNullFields": "false"})
    return group_entries(diff, order).filter("seq > 0").select("grp_rank", "seq", body.alias("line"))


def _heading_lines(grouped: DataFrame, markdown: bool) -> DataFrame:
    sizes = grouped.filter("seq > 0").groupBy("grp_rank", "heading").agg(F.count(F.lit(1)).alias("n"))
    shown = F.concat(F.lit("## "), F.col("heading")) if markdown else F.upper("heading")
    line = F.concat(shown, F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return sizes.select("grp_rank", F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("line_no"), line.alias("line"))


def diff_markdown_lines(diff: DataFrame, order: str = "entry_no") -> DataFrame:
    """Markdown lines of a diff, keyed for a global sort by (grp_rank, seq, line_no)."""
    grouped = group_entries(diff, order)
    tag = F.when(F.col("grp") == "breaking", F.concat(F.lit("`"), F.col("category"), F.lit("` "))).otherwise(F.lit(""))
    first = F.concat(F.lit("- "), tag, F.col("text"), F.lit(" *"), F.col("version_text"), F.lit("*"))
    return _entry_lines(grouped, first, "  - ", markdown=True)


def diff_text_lines(diff: DataFrame, order: str = "entry_no") -> DataFrame:
    """Plain-text lines of a diff: heading per group, one bullet per entry, why, children."""
    grouped = group_entries(diff, order)
    tag = F.when(F.col("grp") == "breaking", F.concat(F.lit("["), F.col("category"), F.lit("] "))).otherwise(F.lit(""))
    first = F.concat(F.lit("- "), tag, F.col("text"), F.lit(" ["), F.col("version_text"), F.lit("]"))
    return _entry_lines(grouped, first, "  - ", markdown=False)


def _entry_lines(grouped: DataFrame, first: Column, nested: str, markdown: bool) -> DataFrame:
    reason = F.coalesce(F.col("breaking_reason"), F.lit(""))
    why = F.when(
        F.coalesce(F.col("breaking"), F.lit(False)) & (reason != ""),
        F.array(F.concat(F.lit(f"{nested}why: "), reason)),
    ).otherwise(F.array().cast("array<string>"))
    kids = F.transform(
        F.coalesce("children", F.array().cast("array<string>")), lambda c: F.concat(F.lit(nested), c)
    )
    bullets = grouped.filter("seq > 0").select(
        "grp_rank", "seq", F.posexplode(F.concat(F.array(first), why, kids)).alias("line_no", "line")
    )
    return bullets.unionByName(_heading_lines(grouped, markdown))
