"""Page-graph operators: reachability, reading order, inherited attributes, link lookup.

Iterated joins cut their lineage in the shared scratch folder each round and return to the
driver only the number of new rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.names import ancestors
from docloom.functions.qualified import split_qualified
from docloom.operators.ordered import top_k, with_ordinal
from docloom.session import cut


def reachable(edges: DataFrame, seeds: DataFrame, fold_every: int = 8) -> DataFrame:
    """Nodes reached from ``seeds`` (node) along ``edges`` (src, dst) with their level.

    The distinct edges are written once and not partitioned by source: a hub with a third of
    them would be one partition. Each level's join is planned by the size of its frontier.
    """
    distinct = cut(edges.select("src", "dst").distinct())
    seen = cut(seeds.select("node").distinct().withColumn("level", F.lit(0)))
    frontier, level = seen, 0
    while True:
        level += 1
        step = frontier.join(distinct, frontier["node"] == distinct["src"]).select(F.col("dst").alias("node")).distinct()
        found = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level)))
        if found.isEmpty():
            return seen
        seen = seen.unionByName(found)
        if level % fold_every == 0:
            seen = cut(seen)
        frontier = found


def _hop(first: DataFrame, second: DataFrame) -> DataFrame:
    """Jump tables (n, to) one after the other."""
    return first.join(second.select(F.col("n").alias("to"), F.col("to").alias("_far")), "to").select(
        "n", F.col("_far").alias("to")
    )


def reading_order(pages: DataFrame, starts: DataFrame, node: str = "node", succ: str = "next") -> DataFrame:
    """Rank of every page along the ``next`` chain from each start (by pointer jumping).

    ``pages`` holds (node, next), ``starts`` (start); a chain ends at null, at a page that is
    not in the table (which still gets its rank) or at a page already ranked. Every round
    covers four times the length of the one before.
    """
    one = cut(pages.filter(F.col(succ).isNotNull()).select(F.col(node).alias("n"), F.col(succ).alias("to")))
    ranks = cut(starts.select(F.col("start"), F.col("start").alias("n"), F.lit(0).cast("bigint").alias("rank")))
    ranked, span = ranks.count(), 1

    def ahead(jump: DataFrame, steps: int) -> DataFrame:
        return ranks.join(jump, "n").select("start", F.col("to").alias("n"), (F.col("rank") + steps).alias("rank"))

    while True:
        two = cut(_hop(one, one))
        three = _hop(two, one)
        reached = ranks
        for times, jump in ((1, one), (2, two), (3, three)):
            reached = reached.unionByName(ahead(jump, times * span))
        # A page met again keeps its first rank.
        ranks = cut(reached.groupBy("start", "n").agg(F.min("rank").alias("rank")))
        total = ranks.count()
        if total == ranked:
            return ranks.withColumnRenamed("n", node)
        ranked, span = total, span * 4
        one = cut(_hop(two, two))


def inherit_up(pages: DataFrame, node: str = "node", up: str = "up", attr: str = "attr") -> DataFrame:
    """Own attribute, else the nearest ancestor's along ``up`` (pointer jumping).

    After ``k`` rounds 2^k ancestors are covered. It ends when no open page has a further
    parent, or when the covered length exceeds the number of pages (a cycle without the
    attribute).
    """
    state = cut(pages.select(F.col(node).alias("n"), F.col(up).alias("up"), F.col(attr).alias("attr")))
    total, covered = state.count(), 1
    while True:
        open_rows = state.filter(F.col("attr").isNull() & F.col("up").isNotNull())
        if covered > total or open_rows.isEmpty():
            break
        parents = state.select(F.col("n").alias("up"), F.col("up").alias("_up2"), F.col("attr").alias("_attr2"))
        moved = open_rows.select("n", "up").join(parents, "up", "left").select(
            "n", F.col("_up2").alias("up"), F.col("_attr2").alias("attr")
        )
        done = state.filter(F.col("attr").isNotNull() | F.col("up").isNull())
        state = cut(done.unionByName(moved))
        covered *= 2
    return state.select(F.col("n").alias(node), F.col("attr").alias(attr))


def toc_tree(docs: DataFrame, root: str) -> DataFrame:
    """Table of contents below ``root``: parent, depth and sort path of every document.

    ``docs`` holds (name, pos). The parent is the nearest existing dotted prefix below the
    root. The sort path lists (pos, name) from the top ancestor down, so sorting by it gives
    the nested order; its length is bounded by the dots of one name.
    """
    below = docs.filter(F.startswith("name", F.lit(root + "."))).select("name", F.coalesce("pos", F.lit(1 << 60)).cast("bigint").alias("pos"))
    prefixes = below.select("name", F.explode(ancestors(F.col("name"))).alias("anc"))
    existing = prefixes.join(below.select(F.col("name").alias("anc"), F.col("pos").alias("anc_pos")), "anc")
    chains = existing.groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct(F.length("anc").alias("len"), F.col("anc_pos").alias("pos"), F.col("anc").alias("name")))).alias("chain")
    )
    full = below.join(chains, "name", "left")
    chain = F.coalesce(F.col("chain"), F.array().cast("array<struct<len:int,pos:bigint,name:string>>"))
    own = F.array(F.struct("pos", "name"))
    path = F.concat(F.transform(chain, lambda a: F.struct(a["pos"].alias("pos"), a["name"].alias("name"))), own)
    return full.select(
        "name",
        F.coalesce(F.try_element_at(chain, F.lit(-1))["name"], F.lit(root)).alias("parent"),
        (F.size(chain) + 1).alias("depth"),
        path.alias("sort_path"),
    )


def reading_order_sort(docs: DataFrame, ranks: DataFrame, node: str = "node") -> DataFrame:
    """Documents with their sort key: chain position first, unranked last, then name."""
    last = F.lit((1 << 62)).cast("bigint")
    return docs.join(ranks.select(node, "rank"), node, "left").withColumn("sort_pos", F.coalesce("rank", last))


def resolve_links(links: DataFrame, by_path: DataFrame, by_anchor: DataFrame) -> DataFrame:
    """Links (path, fragment) with the target document: the anchor's, else the page's.

    ``by_path`` holds (path, name); ``by_anchor`` (path, fragment, name).
    """
    # Each distinct target is looked up once, so a hot target does not skew the two joins.
    targets = links.select("path", "fragment").distinct()
    exact = by_anchor.select("path", "fragment", F.col("name").alias("_exact"))
    page = by_path.select("path", F.col("name").alias("_page"))
    found = targets.join(exact, ["path", "fragment"], "left").join(page, "path", "left").select(
        "path",
        "fragment",
        F.coalesce("_exact", "_page").alias("name"),
        F.when(F.col("_exact").isNotNull(), "anchor").when(F.col("_page").isNotNull(), "page").alias("how"),
    )
    return links.join(found, ["path", "fragment"], "left")


def orphan_parts(parts: DataFrame, wholes: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Part keys without a whole: their number and the first ``k``, marked when more follow."""
    orphans = parts.select(key).distinct().join(wholes.select(key), key, "left_anti")
    first = orphans.orderBy(key).limit(k).agg(F.array_sort(F.collect_list(key)).alias("_first"))
    count = orphans.agg(F.count(F.lit(1)).alias("n_orphans"))
    text = F.array_join(F.transform("_first", lambda x: x.cast("string")), ", ")
    return count.withColumn("_first", first.scalar()).select(
        "n_orphans", F.when(F.col("n_orphans") > k, F.concat(text, F.lit(" ..."))).otherwise(text).alias("first_keys")
    )


def fold_parts(parts: DataFrame, wholes: DataFrame, key: str, number: str) -> DataFrame:
    """Part rows of existing wholes, numbered by ``number`` (unique within the whole)."""
    return with_ordinal(parts.join(wholes.select(key), key, "left_semi"), [key], number)


def repair_titles(titles: DataFrame, repairs: DataFrame, title: str = "title", sep: str = "::") -> DataFrame:
    """Titles equal to a broken one, or below it, get the repaired prefix.

    ``repairs`` holds (priority, broken, fixed); the lowest priority wins. Every leading part
    of a distinct title is looked up by equality, so no pairwise comparison is needed.
    """
    distinct = titles.select(title).distinct()
    parts = F.split(F.col(title), sep)
    leads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))
    hits = distinct.select(title, F.explode(leads).alias("broken")).join(repairs, "broken")
    best = hits.groupBy(title).agg(F.min_by(F.struct("broken", "fixed"), "priority").alias("_r"))
    rest = F.substr(F.col(title), F.length(F.col("_r.broken")) + 1)
    fixed = best.select(title, F.concat(F.col("_r.fixed"), rest).alias("repaired"))
    return titles.join(fixed, title, "left").withColumn("repaired", F.coalesce("repaired", F.col(title)))


# What a page of a specialisation declares last.
DECLARED = r"(?s)(?:struct|class)\s+([A-Za-z_]\w*\s*<.*>)\s*$"


def title_repairs(pages: DataFrame, order: str) -> DataFrame:
    """Repairs read off the pages themselves: ``priority, broken, fixed``.

    ``pages``: (title, declaration, top_level, and a unique ``order``). A top-level page whose title is
    no qualified name, but which declares a specialisation, gives its title that name. Of several
    pages with one title the last says what it becomes, the first how early it is tried.
    """
    declared = F.regexp_extract("declaration", DECLARED, 1)
    broken = pages.where(F.col("top_level") & split_qualified(F.col("title")).isNull() & split_qualified(declared).isNotNull())
    return broken.groupBy(F.col("title").alias("broken")).agg(
        F.min(order).alias("priority"), F.max_by(declared, F.col(order)).alias("fixed")
    )


def with_parent(pages: DataFrame, parents: DataFrame, up: str, node: str, value: str, out: str) -> DataFrame:
    """Every page with a value of its parent page."""
    return pages.join(parents.select(F.col(node).alias(up), F.col(value).alias(out)), up, "left")


def uncovered(docs: DataFrame, sections: DataFrame, name: str = "name") -> DataFrame:
    """Documents that are neither a listed section nor below one (by dotted prefix)."""
    own = F.concat(ancestors(F.col(name)), F.array(F.col(name)))
    covered = docs.select(name, F.explode(own).alias("section")).join(
        sections.select("section"), "section", "left_semi"
    )
    return docs.join(covered.select(name).distinct(), name, "left_anti")


def name_collisions(claims: DataFrame, name: str = "name", source: str = "source") -> DataFrame:
    """Names claimed by more than one source, with the first two sources."""
    pairs = claims.select(name, source).distinct()
    counts = pairs.groupBy(name).agg(F.count(F.lit(1)).alias("n_sources")).filter("n_sources > 1")
    firsts = top_k(pairs.join(counts, name, "left_semi"), [name], [F.col(source)], 2)
    named = firsts.groupBy(name).agg(
        F.min(source).alias("first_source"), F.max(source).alias("second_source")
    )
    return counts.join(named, name)


def merge_members(members: DataFrame) -> DataFrame:
    """Members of each document in order (static variant last) and whether they may merge.

    ``members`` holds (name, rel). Members merge only when their paths without the static
    suffix are one and the same.
    """
    bare = F.regexp_replace("rel", r"\.html$", "")
    flagged = members.withColumn("is_static", F.endswith(bare, F.lit("__static"))).withColumn(
        "stem", F.regexp_replace(bare, "__static$", "")
    )
    stems = flagged.select("name", "stem").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_stems"))
    # A mergeable document has at most two distinct members; rank by the pair itself.
    ranked = flagged.select("name", "stem", "rel", "is_static").distinct()
    before = (
        ranked.groupBy("name", "stem")
        .agg(F.count_if("is_static").alias("n_static"), F.count_if(~F.col("is_static")).alias("n_plain"))
    )
    placed = ranked.join(before, ["name", "stem"]).withColumn(
        "seq", F.when(F.col("is_static"), F.col("n_plain") + 1).otherwise(F.lit(1)).cast("bigint")
    )
    return placed.join(stems, "name").select(
        "name", "rel", "seq", "n_stems", (F.col("n_stems") > 1).alias("collides")
    )


def ordered_includes(lines: DataFrame) -> DataFrame:
    """Distinct include lines of each document in order of first appearance.

    ``lines`` holds (name, line_no, include); ``line_no`` is unique within the document.
    """
    first = lines.groupBy("name", "include").agg(F.min("line_no").alias("line_no"))
    return with_ordinal(first, ["name"], "line_no")


def specialization_repairs(pages: DataFrame, is_name: Column, pattern: str) -> DataFrame:
    """Repairs read off the declarations of pages whose title is not a proper name."""
    fixed = F.regexp_extract("declaration", pattern, 1)
    return pages.filter(~is_name & (fixed != "")).select(
        F.col("page_no").alias("priority"), F.col("title").alias("broken"), fixed.alias("fixed")
    )
