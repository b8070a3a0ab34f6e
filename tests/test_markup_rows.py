"""Token rows of pages: implied end tags, links, lists, entries, texts."""

import html
import random
import re

from pyspark.sql import functions as F

from docloom.operators import markup_rows as rows_of


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


def fragments(spark, page):
    tokens = rows_of.tokens(pages(spark, page))
    found = rows_of.fragments(tokens)
    texts = rows_of.outside_links(found, rows_of.spans(tokens, found))
    return [(r.tag, r.outside) for r in texts.orderBy("block_no").collect()]


def test_every_opener_is_one_fragment(spark, sf):
    given = spark.read.parquet(f"{sf}/pages.parquet")
    found = rows_of.fragments(rows_of.tokens(given)).groupBy("page_id").count().collect()
    openers = {r.page_id: len(re.findall(r"<(?:li|p)\b", re.sub(r"(?s)<script.*?</script>|<!--.*?-->", "", r.html))) for r in given.collect()}
    assert {r.page_id: r["count"] for r in found} == {k: n for k, n in openers.items() if n}


def test_missing_end_tags(spark):
    page = """<p>one<p>two <b>x</b></div> out<ul><li>a<li>b<ol><li>c<p>d<li>e</ol>f</li><li><p>g</ul></ul>h<p>last"""
    assert fragments(spark, page) == [
        ("p", "one"), ("p", "two x"), ("li", "a"), ("li", "bcdef"), ("li", "cd"), ("p", "d"), ("li", "e"), ("li", "g"), ("p", "g"), ("p", "last"),
    ]


def test_markup_that_is_no_element(spark):
    page = """<!-- <li>no --><script>"<p>" + '<li>'</script><style>p{}</style><P title="a > <li>">x < y<br/>&lt;li&gt;</P>"""
    assert fragments(spark, page) == [("p", "x < y<li>")]
    assert fragments(spark, "") == [] and fragments(spark, None) == []


def test_links_end_with_their_paragraph(spark):
    page = '<p>see <a href="in.html">here<p>text <a href=http://x.org>there</a> <a name="t">plain</a><p><a href="a"><b>b</b> c</a>'
    tokens = rows_of.tokens(pages(spark, page))
    found = rows_of.spans(tokens, rows_of.fragments(tokens)).orderBy("block_no", "span_no").collect()
    assert [(r.block_no, r.kind, r.text, r.target) for r in found] == [
        (1, "text", "see ", ""), (1, "link", "here", "in.html"), (2, "text", "text ", ""), (2, "external", "there", "http://x.org"),
        (2, "text", " ", ""), (2, "text", "plain", ""), (3, "link", "b c", "a"),
    ]


def test_compact_lists(spark):
    short, long = "s" * 90, "l" * 91
    wanted = {
        f"<ul><li>{short}<li><p>{short}</ul>": [(2, True)],
        f"<ul><li>{short}<li>{long}</ul>": [(2, False)],
        # nested items count for the ones around them, not the other way round
        f"<ul><li>a<ul><li>b<ul><li>{long}</ul></ul></ul><ul><li>c</ul>": [(1, False), (1, False), (1, False), (1, True)],
        f"<ul><li>{long}<ul><li>b</ul></ul>": [(1, False), (1, True)],
        # two paragraphs, a listing, a list before the text, no text
        "<ul><li><p>a<p>b</li></ul>": [(1, False)],
        "<ul><li>a<pre>b</pre></li></ul>": [(1, False)],
        "<ul><li><ul><li>b</ul>a</li></ul>": [(1, False), (1, True)],
        "<ul><li><ul><li>b</ul></li></ul>": [(1, False), (1, True)],
        "<ul><li> </li></ul>": [(1, False)],
        "<ul></ul>": [],
    }
    found = rows_of.compact_lists(rows_of.tokens(pages(spark, *wanted))).orderBy("page_id", "list_no").collect()
    assert [[(r.n_items, r.compact) for r in found if r.page_id == k] for k in range(len(wanted))] == list(wanted.values())


def test_random_nesting_against_a_stack(spark):
    """Items of random lists, end tags left out at random, against a parser with a stack."""
    rng = random.Random(3)

    def some_list(depth):
        items = []
        for _ in range(rng.randint(1, 4)):
            nested = some_list(depth + 1) if depth < 4 and rng.random() < 0.4 else ""
            items.append(f"<li>t{rng.randint(0, 99)} {nested}" + ("</li>" if rng.random() < 0.5 else ""))
        return "<ul>" + "".join(items) + "</ul>"

    texts = [some_list(0) + some_list(2) for _ in range(30)]
    tokens = rows_of.tokens(pages(spark, *texts))
    found = rows_of.fragments(tokens)
    said = rows_of.outside_links(found, rows_of.spans(tokens, found)).collect()
    for page, text in enumerate(texts):
        open_items, done = [], []
        for piece in re.findall(r"<[^>]*>|[^<]+", text):
            if piece == "<ul>":
                open_items.append(None)
            elif piece == "<li>":
                if open_items[-1] is not None:
                    open_items.pop()
                open_items.append([])
                done.append(open_items[-1])
            elif piece == "</li>":
                open_items.pop()
            elif piece == "</ul>":
                if open_items[-1] is not None:
                    open_items.pop()
                open_items.pop()
            else:
                for item in open_items:
                    if item is not None:
                        item.append(piece)
        own = [r.outside for r in sorted((r for r in said if r.page_id == page), key=lambda r: r.block_no)]
        assert own == [" ".join("".join(item).split()) for item in done]


def test_references_as_in_the_standard_library(spark):
    texts = [
        "a &lt; b", "&amp;amp;", "&notit; &not; &ampfoo &AMP;", "&#65;&#x41;&#x80;&#0;&#xD800;&#1114112;&#99999999999999999999;",
        "&unknown; &; & &copy2020", "&NotEqualTilde;&#x1F600;", "", "&", "no references",
    ]
    found = spark.createDataFrame([(t,) for t in texts], "s string").select("s", rows_of.decode_references(F.col("s")).alias("d")).collect()
    assert [r.d for r in found] == [html.unescape(r.s) for r in found] and len(found) == len(texts)


def test_texts_come_back_from_escaped_text(spark):
    texts = ["a < b && c > d", "&lt; stays &amp; so", "<b>no tag</b>", ""]
    found = spark.createDataFrame([(t,) for t in texts], "s string").select("s", rows_of.decode_references(rows_of.escape_text(F.col("s"))).alias("d"))
    assert [r.d for r in found.collect()] == [r.s for r in found.collect()]


def test_page_texts(spark):
    page = "a &lt; b<!-- no -->l<span>&amp;</span>m<script>if (x<y) '</p>'</script> kept<p>Para</p> after<template>t<template>u</template>v</template>!"
    ruby = "<ruby>base<rp>(</rp><rt>note<rp>)</ruby> on</template> <script>open"
    found = {r.page_id: r.text for r in rows_of.page_texts(pages(spark, page, ruby, "", None)).collect()}
    assert found == {0: "a < bl&m keptPara after!", 1: "base on", 2: "", 3: None}


def test_release_entries(spark):
    page = """<h2>Log</h2><ul><li>before</ul><h3>Release 1.2.0</h3><ul><li>one &amp; two<ul><li>n1<li>n2<b>x</b></ul> tail<li>three</ul><p>loose &lt;
      <h4>part</h4><ul><li>in part</ul><h3>Other</h3><ul><li>no</ul><h3>Release 1.3.0</h3><p>q<ul><li>z</ul>"""
    found = rows_of.release_entries(pages(spark, page), r"^Release (\d+\.\d+\.\d+)$").orderBy("release_no", "path")
    assert [(r.release_no, r.version, list(r.path), r.depth, r.text) for r in found.collect()] == [
        (0, "1.2.0", [0], 0, "one & two tail"), (0, "1.2.0", [0, 0], 1, "n1"), (0, "1.2.0", [0, 1], 1, "n2x"), (0, "1.2.0", [1], 0, "three"),
        (0, "1.2.0", [2], 0, "loose <"), (0, "1.2.0", [3], 0, "in part"), (1, "1.3.0", [0], 0, "q"), (1, "1.3.0", [1], 0, "z"),
    ]


def test_no_python_in_the_plan(spark, sf, capsys):
    given = spark.read.parquet(f"{sf}/pages.parquet")
    rows_of.page_texts(given).explain()
    rows_of.release_entries(given, "(x)").explain()
    printed = capsys.readouterr().out
    assert "Physical Plan" in printed and not any(x in printed for x in ("MapInArrow", "EvalPython", "MapInPandas", "PythonUDF"))


def test_a_task_gets_a_bounded_share_of_the_pages(spark):
    """Twice the markup is dealt to twice the tasks, and adaptive execution does not put them together."""
    given = spark.range(400).selectExpr("id AS page_id", "concat('<p>', repeat('word ', 20000)) AS html")
    dealt = rows_of._dealt(given)
    assert dealt.rdd.getNumPartitions() >= 400 * 100_000 // rows_of.TASK_BYTES
    assert rows_of._dealt(given.limit(0)).count() == 0
    wide = rows_of._dealt(given.union(given.selectExpr("page_id + 400", "html")).union(given.selectExpr("page_id + 800", "html")))
    assert wide.rdd.getNumPartitions() >= 3 * 400 * 100_000 // rows_of.TASK_BYTES


def test_words_are_gathered_without_a_shuffle_of_their_own(spark, sf):
    from docloom.plans import corpus

    plan = corpus.block_text(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(page_id" in plan and "block_no" not in plan.split("hashpartitioning(")[1].split(")")[0]


def test_entries_are_found_without_moving_pages_again(spark):
    """Pages are dealt once; no join reads or shuffles them again."""
    found = rows_of.release_entries(pages(spark, "<h3>Release 1.2.0</h3><ul><li>one<ul><li>two</ul></ul>"), r"^Release (\S+)$")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(page_id" in plan
    assert [(list(r.path), r.text) for r in found.orderBy("path").collect()] == [([0], "one"), ([0, 0], "two")]
