"""Graph operators: crawl closure, chains with cycles, inheritance, names."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docloom.operators import documents, graph


def pairs(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_reachable(spark):
    edges = [("index", "overview"), ("overview", "reference"), ("overview", "index"), ("reference", "socket"), ("socket", "parent"), ("other", "index"), ("index", "index")]
    found = graph.reachable(pairs(spark, edges, "src string, dst string"), pairs(spark, [("index",)], "node string"), fold_every=2)
    assert {r.node: r.level for r in found.collect()} == {"index": 0, "overview": 1, "reference": 2, "socket": 3, "parent": 4}


def test_reading_order_stops_at_cycles_and_missing_pages(spark):
    chain = [(i, i + 1) for i in range(11)] + [(11, 5), (50, 99), (60, None)]
    starts = [(0,), (50,), (60,)]
    found = graph.reading_order(pairs(spark, chain, "node bigint, next bigint"), pairs(spark, starts, "start bigint")).collect()
    ranks = {}
    for row in found:
        ranks.setdefault(row.start, {})[row.node] = row.rank
    assert ranks == {0: {i: i for i in range(12)}, 50: {50: 0, 99: 1}, 60: {60: 0}}


def test_inherit_up(spark):
    rows = [(i, i - 1 if i else None, "top" if i == 0 else ("mid" if i == 7 else None)) for i in range(20)]
    rows += [(100, 101, None), (101, 100, None), (102, 100, None), (103, 999, None), (104, 103, "own")]
    found = {r.node: r.attr for r in graph.inherit_up(pairs(spark, rows, "node bigint, up bigint, attr string")).collect()}
    assert all(found[i] == ("top" if i < 7 else "mid") for i in range(20))
    assert [found[i] for i in (100, 101, 102, 103, 104)] == [None, None, None, None, "own"]


def test_resolve_links_prefers_the_anchor(spark):
    links = pairs(spark, [("a", "x"), ("a", "y"), ("b", ""), ("c", "")], "path string, fragment string")
    found = graph.resolve_links(
        links, pairs(spark, [("a", "A"), ("b", "B")], "path string, name string"), pairs(spark, [("a", "x", "AX")], "path string, fragment string, name string")
    )
    assert {(r.path, r.fragment): (r.name, r.how) for r in found.collect()} == {
        ("a", "x"): ("AX", "anchor"), ("a", "y"): ("A", "page"), ("b", ""): ("B", "page"), ("c", ""): (None, None)
    }


def test_repair_titles(spark):
    titles = pairs(spark, [("ip::address >",), ("ip::address >::value",), ("ip::address",), ("x",)], "title string")
    repairs = pairs(spark, [(1, "ip::address >", "hash< ip::address >")], "priority int, broken string, fixed string")
    found = {r.title: r.repaired for r in graph.repair_titles(titles, repairs).collect()}
    assert found == {
        "ip::address >": "hash< ip::address >", "ip::address >::value": "hash< ip::address >::value", "ip::address": "ip::address", "x": "x"
    }


def test_title_repairs_come_from_the_pages(spark):
    pages = pairs(spark, [
        (1, "ip::address >", "template <>\nstruct hash< ip::address >", True),
        (2, "std::list >", "class wrap< std::list >  ", False),  # below another page
        (3, "good::name", "struct hash< other >", True),  # its title is a name
        (4, "x >", "struct plain", True),  # no specialisation
        (5, "y >", "struct bad< y", True),
        (6, "z >", "struct first< z >", True),
        (7, "z >", "struct last< z >", True),
        (8, None, None, True),
    ], "ord int, title string, declaration string, top_level boolean")
    found = {(r.broken, r.priority, r.fixed) for r in graph.title_repairs(pages, "ord").collect()}
    assert found == {("ip::address >", 1, "hash< ip::address >"), ("z >", 6, "last< z >")}


def test_merge_members(spark):
    members = [("q", "r/q__static.html"), ("q", "r/q.html"), ("c", "r/a.html"), ("c", "r/b.html"), ("s", "r/s__static.html")]
    found = {(r.name, r.rel): (r.seq, r.collides) for r in graph.merge_members(pairs(spark, members, "name string, rel string")).collect()}
    assert found[("q", "r/q.html")] == (1, False) and found[("q", "r/q__static.html")] == (2, False)
    assert found[("c", "r/a.html")][1] and found[("c", "r/b.html")][1] and found[("s", "r/s__static.html")] == (1, False)


def test_collisions_and_orphans(spark):
    claims = pairs(spark, [("n", "b"), ("n", "a"), ("n", "a"), ("n", "c"), ("m", "a")], "name string, source string")
    row = graph.name_collisions(claims).collect()
    assert [(r.name, r.n_sources, r.first_source, r.second_source) for r in row] == [("n", 3, "a", "b")]
    orphans = graph.orphan_parts(spark.range(9).withColumnRenamed("id", "k"), spark.range(2).withColumnRenamed("id", "k"), "k").first()
    assert (orphans.n_orphans, orphans.first_keys) == (7, "2, 3, 4, 5, 6 ...")
    none = graph.orphan_parts(spark.range(2).withColumnRenamed("id", "k"), spark.range(2).withColumnRenamed("id", "k"), "k").first()
    assert (none.n_orphans, none.first_keys) == (0, "")


def test_toc_tree(spark):
    docs = pairs(spark, [("d.a", 2), ("d.a.x.y", 3), ("d.b", 1), ("d.a.x.z", None), ("e.q", 1)], "name string, pos bigint")
    tree = {r.name: (r.parent, r.depth) for r in graph.toc_tree(docs, "d").collect()}
    assert tree == {"d.a": ("d", 1), "d.b": ("d", 1), "d.a.x.y": ("d.a", 2), "d.a.x.z": ("d.a", 2)}
    nested = [r.name for r in graph.toc_tree(docs, "d").orderBy("sort_path").collect()]
    assert nested == ["d.b", "d.a", "d.a.x.y", "d.a.x.z"]


def test_table_layouts(spark):
    def cells(table, *rows):
        return [(table, i, j, t) for i, row in enumerate(rows) for j, t in enumerate(row)]

    rows = cells("fits", ["a" * 30, "b" * 38]) + cells("wide", ["a" * 30, "b" * 41]) + cells("wrap", ["a" * 20, "b" * 20, "c" * 90])
    rows += cells("narrow", ["a" * 21, "b" * 20, "c" * 90]) + cells("ragged", ["a", "b"], ["c"]) + cells("single", ["a"], ["b"])
    found = documents.table_profile(pairs(spark, rows, "tbl string, row_no bigint, col_no int, text string"), ["tbl"])
    assert {r.tbl: r.layout for r in found.collect()} == {
        "fits": "table", "wide": "rows", "wrap": "wrap", "narrow": "rows", "ragged": "rows", "single": "rows"
    }


def test_index_spans_must_add_up(spark):
    headers = pairs(spark, [(0, 0, 0, "Core", 1), (0, 0, 1, "More", 2)], "page_id int, table_no int, header_no int, title string, span bigint")
    groups = pairs(spark, [(0, 0, 0, 0, "Classes", "a"), (0, 0, 1, 0, "Classes", "b"), (0, 0, 2, 0, "Types", "c")],
                   "page_id int, table_no int, column_no int, group_no int, group_title string, entry string")
    widths = pairs(spark, [(0, 0, 3)], "page_id int, table_no int, n_cols int")
    found = documents.index_by_category(headers, groups, widths).collect()
    assert {(r.category, r.group_title, r.entry) for r in found} == {("Core", "Classes", "a"), ("More", "Classes", "b"), ("More", "Types", "c")}
    with pytest.raises(PySparkException, match="has 4 columns"):
        documents.index_by_category(headers, groups, widths.withColumn("n_cols", F.lit(4))).collect()
