"""Parser goldens: blocks, canonical markup, change-log pages."""

from pyspark.sql import functions as F

from docloom.functions import markup
from docloom.operators import html


def kinds(page):
    return [(r["kind"], r["label"], r["text"]) for r in html.page_blocks(f"<article>{page}</article>")]


def test_blocks_of_each_kind():
    page = """<h2>Title</h2>loose <b>text</b><p>One <a href="x.html">link</a>.<p>Two<pre>a\tb</pre>
    <ol start="3"><li>x<li><p>y</p><ul><li>deep</li></ul></ol><blockquote>q</blockquote>
    <dl><dt>s</dt><dt>t</dt><dd>both</dd><dt>u</dt></dl><p><img src="i.png" alt=" pic "></p><p> </p>"""
    assert kinds(page) == [
        ("heading", None, "Title"), ("para", None, "loose text"), ("para", None, "One link."), ("para", None, "Two"),
        ("code", None, "a       b"), ("list", None, ""), ("item", "3.", ""), ("para", None, "x"), ("item", "4.", ""),
        ("para", None, "y"), ("list", None, ""), ("item", "", ""), ("para", None, "deep"), ("quote", None, ""), ("para", None, "q"),
        ("deflist", None, ""), ("definition", "s, t", ""), ("para", None, "both"), ("definition", "u", ""), ("figure", "pic", "i.png"),
    ]


def test_tables_admonitions_footnotes_callouts():
    page = """<table><thead><tr><th>Name<th>Description</thead><tbody><tr><td>a<td>b</tbody></table>
    <table><tr><th>h</th></tr><tr><td>c</td></tr></table>
    <div class="note"><table><tr><th>Note</th></tr><tr><td>n</td></tr></table></div><div class="tip">t</div>
    <div class="footnotes"><div class="footnote"><p><a class="para">[1]</a> foot</p></div></div>
    <div class="calloutlist"><table><tr><td><img alt="1"></td><td>call</td></tr></table></div><div class="titlepage">no</div>"""
    rows = html.page_blocks(f"<article>{page}</article>")
    cells = [(r["row_no"], r["col_no"], r["is_header"], r["text"]) for r in rows if r["kind"] == "cell"]
    assert cells == [(0, 0, True, "Name"), (0, 1, True, "Description"), (1, 0, False, "a"), (1, 1, False, "b"), (0, 0, True, "h"), (1, 0, False, "c")]
    labelled = [(r["kind"], r["label"]) for r in rows if r["label"]]
    assert labelled == [("admonition", "Note"), ("admonition", "Tip"), ("item", "[1]"), ("item", "(1)")]
    assert "foot" in [r["text"] for r in rows] and "no" not in [r["text"] for r in rows]


def test_unclosed_and_truncated_pages():
    assert kinds("<p><b>bold<br><p>next") == [("para", None, "bold"), ("para", None, "next")]
    assert html.page_blocks("<nav>x</nav>") == []


def test_links_keep_place_and_target():
    rows = html.page_blocks('<article><p>a <code>b</code> <a href="t#f">c <i>d</i></a></p></article>')
    assert [(s["kind"], s["style"], s["text"], s["href"]) for s in rows[0]["spans"]] == [
        ("text", "", "a ", None), ("span", "code", "b", None), ("text", "", " ", None), ("link", "", "c ", "t#f"), ("link", "italic", "d", "t#f")
    ]


def test_canonical_markup():
    page = """<p  id="x" class=" b  a "><a rel="y  z" href='q"r'>a &lt; b</a><br>\n \n<img alt="i"></p><pre> </pre><!--c--><script>a<b</script>"""
    assert markup.canonical(markup.parse(page)) == (
        """<p class="b a" id="x"><a href='q"r' rel="y z">a &lt; b</a><br/>\n<img alt="i"/></p><pre> </pre><!--c--><script>a<b</script>"""
    )


def test_text_leaves_out_scripts_and_comments():
    page = "a &lt; b<!-- no -->l<span>&amp;</span>m<script>x</script> kept<p>Para</p> after<template>t</template>"
    assert markup.text_of(markup.parse(page)) == "a < bl&m keptPara after"


def test_code_to_backticks_nests():
    node = markup.parse("Use <code>a<code>b</code></code> and <code> x  y </code><script>no</script>.")
    assert markup.text_of(node, "`") == "Use `ab` and `x y`."


HISTORY = """<div><h3><a name="lib_1_38_2"></a>Lib 1.38.2</h3><div class="itemizedlist"><ul>
<li>Fixed <code><span>ip</span><span>::</span><span>tcp</span></code> handling.</li>
<li><p>Removed some facilities:</p><div class="itemizedlist"><ul><li>Removed spawn() overloads.</li><li>Removed <b>io</b>.</li></ul></div></li></ul></div>
<h3>Lib 1.0.0</h3><p>First stable release.</p></div>"""


def test_history_entries(spark):
    pages = spark.createDataFrame([(1, HISTORY), (2, "<h3>Other</h3><ul><li>no</li></ul>")], "page_id bigint, html string")
    rows = html.release_entries(pages, r"^Lib (\d+\.\d+\.\d+)$").orderBy("release_no", "path").collect()
    assert [(r.release_no, r.version, r.path, r.depth, r.text) for r in rows] == [
        (0, "1.38.2", [0], 0, "Fixed ip::tcp handling."),
        (0, "1.38.2", [1], 0, "Removed some facilities:"),
        (0, "1.38.2", [1, 0], 1, "Removed spawn() overloads."),
        (0, "1.38.2", [1, 1], 1, "Removed io."),
        (1, "1.0.0", [0], 0, "First stable release."),
    ]
    assert rows[0].marked_text == "Fixed `ip::tcp` handling."


def test_metadata(spark):
    page = """<html><head><link rel="up" href="../up.html"><link rel="next" href="n.html"></head><body><div class="section">
    <div class="titlepage"><h3><a title="a::b">x</a></h3></div><pre>class  b;</pre><h4>Requirements</h4>
    <p>Header: a/b.hpp</p><p>Convenience header: None</p></div></body></html>"""
    row = html.page_metadata(spark.createDataFrame([(1, page)], "page_id bigint, html string")).first()
    assert (row.title, row.up, row.next, row.header, row.convenience_header, row.declaration) == ("a::b", "../up.html", "n.html", "a/b.hpp", "", "class b;")


def test_parser_columns(spark):
    page = "<p>Use <code>a<code>b</code></code> &amp;  c</p>"
    row = spark.createDataFrame([(page,), (None,)], "html string").select(
        html.exact_code_to_backticks(F.col("html")).alias("marked"), html.canonical_html(F.col("html")).alias("canonical")
    ).collect()
    assert tuple(row[0]) == ("Use `ab` & c", "<p>Use <code>a<code>b</code></code> &amp;  c</p>")
    assert tuple(row[1]) == (None, None)


def test_canonical_markup_takes_pages_row_by_row(spark):
    """No Arrow batch of ten thousand pages is held by a worker."""
    pages = spark.createDataFrame([(1, "<p>a<br>"), (2, None), (3, "<p>a<br></p>")], "page_id long, html string")
    found = pages.select("page_id", html.canonical_html(F.col("html")).alias("c"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan
    assert {r.page_id: r.c for r in found.collect()} == {1: "<p>a<br/></p>", 2: None, 3: "<p>a<br/></p>"}
    assert {r.page_id: r.n_pages for r in html.markup_duplicates(pages.where("html is not null")).collect()} == {1: 2, 3: 2}
