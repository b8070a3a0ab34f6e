"""Golden values of the column functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docloom.functions import costs, links, names, text, versions


def apply(spark, values, build, schema="s string"):
    rows = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], schema)
    return [r[0] for r in rows.select(build(*[F.col(c) for c in rows.columns]).alias("out")).collect()]


def test_parse_version(spark):
    good = ["1.38.2", "1-38-2", "lib-1-38-2", "lib-1.38.2", "v1.38.2", " 1.38.2 "]
    bad = ["", "1.38", "1.38.2.1", "other-1.89", "latest", "1.x.2"]
    parsed = apply(spark, good + bad, lambda s: versions.parse_version(s, "lib"))
    assert [tuple(v) for v in parsed[: len(good)]] == [(1, 38, 2)] * len(good)
    assert parsed[len(good) :] == [None] * len(bad)


def test_versions_order_by_number(spark):
    rows = spark.createDataFrame([("1.10.0",), ("1.9.0",)], "s string")
    assert rows.agg(versions.format_version(F.max(versions.parse_version(F.col("s"))))).first()[0] == "1.10.0"


def test_bare_hosts(spark):
    true = [p + "www.site.org/a/b.html" for p in ("", "./", "../", "../../")]
    false = ["overview.html", "doc/reference.html", "../../doc/reference.html", "", "reference.html#a/b", "reference.html?x=a/b"]
    assert apply(spark, true + false, links.is_bare_host) == [True] * 4 + [False] * 6
    urls = apply(spark, ["../www.site.org/j/n4370.html", "www.site.org/a?x=1#f"], links.external_url)
    assert urls == ["http://www.site.org/j/n4370.html", "http://www.site.org/a?x=1#f"]


def test_relative_to_root(spark):
    urls = ["http://h/doc/a/b.html?x=1", "http://h/doc//etc/x.html", "http://h/doc/../s.html", "http://h/doc/a/../../s.html", "http://o/doc/a"]
    found = apply(spark, urls, lambda s: links.relative_to_root(F.lit("http://h/doc/"), s))
    assert found == ["a/b.html", None, None, None, None]


@pytest.mark.parametrize(
    ("base", "href", "expected"),
    [
        ("a/b/c.html", "d.html#x", ("a/b/d.html", "x", None)),
        ("a/b/c.html", "../d%20e.html", ("a/d e.html", "", None)),
        ("a/b/c.html", "#frag", ("a/b/c.html", "frag", None)),
        ("a/b/c.html", "../../../up.html", ("../up.html", "", None)),
        ("a/b/c.html", "https://x.org/y", (None, None, "https://x.org/y")),
        ("a/b/c.html", "../www.x.org/y", (None, None, "http://www.x.org/y")),
        ("a/b/c.html", "a+b.html", ("a/b/a+b.html", "", None)),
        ("a/b/c.html", "./x/./y/../z.html", ("a/b/x/z.html", "", None)),
    ],
)
def test_resolve_href(spark, base, href, expected):
    assert tuple(apply(spark, [(base, href)], links.resolve_href, "b string, h string")[0]) == expected


def test_sanitize_name(spark):
    cases = {
        "x::operator bool": "x.operator_bool",
        'buffer_literals::operator"" _buf': 'buffer_literals.operator""_buf',
        "foo< T >, bar": "foo<T>+bar",
        "a/b": "a%2Fb",
        "naïve": "na%C3%AFve",
        "a\U0001f600b": "a%F0%9F%98%80b",
        "50%": "50%25",
        "a b c d": "a_b_c_d",
    }
    assert apply(spark, list(cases), names.sanitize_name) == list(cases.values())


def test_path_to_name(spark):
    cases = {
        "doc/overview/core/strands.html": "doc.overview.core.strands",
        "doc/tutorial/tuttimer1.html": "doc.tutorial.timer1",
        "doc/examples/cpp20_examples.html": "doc.examples.cpp20",
        "doc/tutorial/tut.html": "doc.tutorial.tut",
        "index.html": "doc.index",
    }
    assert apply(spark, list(cases), lambda s: names.path_to_name(s, "doc")) == list(cases.values())


def test_split_part(spark):
    found = apply(spark, ["r/a/overload12.html", "doc/tutorial/t1/src.html", "r/a__static.html", "r/a.html"], names.split_part)
    assert [tuple(p) for p in found] == [
        ("r/a.html", 12, False, False), ("doc/tutorial/t1.html", None, True, False), (None, None, False, True), (None, None, False, False)
    ]


def test_ancestors(spark):
    assert apply(spark, ["a.b.c", "a"], names.ancestors) == [["a", "a.b"], []]


def test_first_sentence(spark):
    cases = {
        "One. Two.": "One.",
        "See e.g. Foo for it. Next": "See e.g. Foo for it.",
        "Uses x.y values": "Uses x.y values",
        "Is it? (Yes)": "Is it?",
        "a vs. B etc. C i.e. D! 'e'": "a vs. B etc. C i.e. D!",
        " spread \n out. Next": "spread out.",
        "ends here.": "ends here.",
    }
    assert apply(spark, list(cases), text.first_sentence) == list(cases.values())


def test_whitespace(spark):
    assert apply(spark, ["  a  \n b "], text.normalize_ws) == ["a b"]
    assert apply(spark, ["a   b \n"], text.normalize_ws_ascii) == ["a   b"]
    assert apply(spark, [" \t a b 　"], text.strip) == ["a b"]


def test_truncate_marked(spark):
    cut = apply(spark, ["x" * 9160, "x" * 12000], text.truncate_marked)
    assert cut[0] == "x" * 9160
    assert cut[1] == "x" * 9160 + " [... 2,840 more characters truncated]"


def test_result_key(spark):
    expected = hashlib.sha256("v2\nmodel\nlow\nFixed a bug.".encode()).hexdigest()
    key = lambda s: text.result_key(F.lit("v2"), F.lit("model"), F.lit("low"), s)
    assert apply(spark, ["Fixed a bug.", "  Fixed a bug.\n"], key) == [expected, expected]


def test_short_error_and_labels(spark):
    assert apply(spark, ["a.b.C(d.E)", "plain"], text.short_error) == ["C(E)", "plain"]
    assert apply(spark, [1, 0, 1234], lambda n: text.quantity(n, "entry", "entries"), "n bigint") == ["1 entry", "0 entries", "1,234 entries"]
    assert apply(spark, [("", "u"), ("u", "u"), ("t", "u")], text.link_text, "a string, b string") == ["<u>", "<u>", "t <u>"]


def test_code(spark):
    assert apply(spark, ["\n\n a \n\n\n\nb\t\n\n"], text.normalize_code) == [" a\n\nb"]
    lines = ["\t", "a\tb", "1234567\tx", "12345678\tx", "\t\ta", "é日\t\tz", "no tabs", "a\rbc\td", "", "ab\t\tc\td"]
    assert apply(spark, lines, text.expand_tabs) == [line.expandtabs(8) for line in lines]
    assert apply(spark, ["int a;\t// x\n\tb\t \n"], text.normalize_code) == ["int a;  // x\n        b"]
    assert apply(spark, ["Use <code>a</code> and <i>b</i>"], text.code_to_backticks) == ["Use `a` and b"]


def test_retry_rules(spark):
    headers = [({"retry-after-ms": "1500"},), ({"retry-after": "7"},), ({"retry-after": "nan"},), ({"retry-after": "-1"},), (None,), ({"retry-after": "99"},)]
    delays = apply(spark, headers, lambda h: costs.retry_delay(costs.requested_delay(h), F.lit(2)), "h map<string,string>")
    assert delays == [1.5, 7.0, 4.0, 4.0, 4.0, 30.0]
    statuses = apply(spark, [408, 429, 500, 404], lambda s: costs.is_retryable(s, F.lit(None).cast("string")), "s int")
    assert statuses == [True, True, True, False]
    assert apply(spark, [500], lambda s: costs.is_retryable(s, F.lit("false")), "s int") == [False]


def test_money(spark):
    assert apply(spark, [0.0004, 0.05, 1.234], costs.about_usd, "x double") == ["under $0.001", "about $0.050", "about $1.23"]
    assert apply(spark, [0.441], costs.round_up_cents, "x double") == [0.45]


def test_percent_encoding_works_on_whole_runs(spark):
    """No step is taken per character: runs are cut and coded together."""
    texts = ["", None, "a/b", "//", "é日\U0001f600x\n %", " é é ", "\x00a\x7f~", "plain"]
    coded = ["".join("".join(f"%{b:02X}" for b in c.encode()) if c in "/%\\" or not 32 <= ord(c) <= 126 else c for c in t) if t is not None else None for t in texts]
    assert apply(spark, texts, names.percent_encode) == coded
    plan = spark.createDataFrame([("a",)], "s string").select(names.percent_encode(F.col("s")))._jdf.queryExecution().analyzed().toString()
    assert "(?s)." not in plan
