"""Every registered query against its SQL, and independence from the number of partitions."""

import pytest

import __spark_entry__ as driver
from check_oracle import compare, connect

QUERIES, ORACLE = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, connection, name):
    found = QUERIES[name](spark, sf)
    if name in ORACLE:
        assert compare(found, connection.sql(ORACLE[name])) == []
    else:
        assert not found.isEmpty()


@pytest.mark.parametrize("partitions", ["1", "7"])
@pytest.mark.parametrize(
    "name", ["d1_group_entries", "d9_batch_payload_sizes", "d22_render_document", "e7_admit_under_caps", "i1_reachable", "d16_sweep_table", "f3_order_pages"]
)
def test_partition_count_does_not_matter(spark, sf, connection, name, partitions):
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert compare(QUERIES[name](spark, sf), connection.sql(ORACLE[name])) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


def test_entry(spark):
    counts = {r.grp: r.n_entries for r in driver.entry(spark).collect()}
    assert counts["total"] == sum(n for grp, n in counts.items() if grp != "total") == 90
