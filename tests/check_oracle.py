"""Run registered queries and compare them with their SQL: names, types, rows.

    python tests/check_oracle.py [--sf DIR] [--only TEXT] [--slow SECONDS]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def compare(spark_df, relation) -> list[str]:
    """Problems found; empty when both sides agree."""
    ours = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema}
    theirs = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    if ours != theirs:
        wrong = {n: (ours.get(n), theirs.get(n)) for n in {*ours, *theirs} if ours.get(n) != theirs.get(n)}
        return [f"schema (spark, sql): {wrong}"]
    names = sorted(ours)
    left = Counter(tuple(plain(r[n]) for n in names) for r in spark_df.collect())
    at = [relation.columns.index(n) for n in names]
    right = Counter(tuple(plain(r[i]) for i in at) for r in relation.fetchall())
    if left == right:
        return []
    show = lambda rows: [str(r)[:300] for r in list(rows)[:3]]
    return [
        f"{names}: {sum(left.values())} rows in spark, {sum(right.values())} in sql; "
        f"only spark {sum((left - right).values())} {show(left - right)}; only sql {sum((right - left).values())} {show(right - left)}"
    ]


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--only", default="")
    parser.add_argument("--slow", type=float, default=4.0)
    options = parser.parse_args()
    import __spark_entry__ as entry
    from docloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(options.sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if not any(part in name for part in options.only.split(",")):
            continue
        start = time.time()
        try:
            df = queries[name](spark, options.sf)
            if name in oracle:
                problems = compare(df, connection.sql(oracle[name]))
            else:
                count = df.count()
                problems = [] if count else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:900]}"]
        took = time.time() - start
        if problems or took > options.slow:
            print(f"{'BAD ' if problems else 'slow'} {name} {took:.1f}s {' '.join(problems)}", flush=True)
        bad += bool(problems)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
