"""Pages whose title was cut within a character reference: queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as driver
from check_oracle import compare

QUERIES, ORACLE = driver.queries(), driver.oracle_sql()
TITLES = ("a &amp;&amp;&amp", "b &am", "c &", "d &l", "e &quo", "f &amp;amp", "&amp;lt; &lt;i&gt; &amp")


@pytest.fixture(scope="module")
def cut_pages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cut")
    page = "<html><head><title>{0}</title></head><body><article><h1>{0}</h1><p>{0}<br>x &copy; y<p>end &amp; {0}</article></body></html>"
    rows = [(k, f"http://h{k}.example/p", page.format(title)) for k, title in enumerate(TITLES)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["h6_6_html_to_text", "h6_7_page_metadata", "k1_html_blocks", "k1_html_blocks_sql", "k1_html_headings"])
def test_query_on_cut_pages(spark, cut_pages, name):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW pages AS FROM '{cut_pages}/pages.parquet/*.parquet'")
    assert compare(QUERIES[name](spark, cut_pages), connection.sql(ORACLE[name])) == []
