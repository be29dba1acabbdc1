"""Run registered queries next to their SQL and compare the rows, order ignored. Usable as a script: see ``--help``."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value
    return str(value)


def normalized(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_cell(row[i]) for i in order) for row in rows)


# Types of the two engines that hold the same values.
SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(con, frame, sql: str) -> tuple[bool, str]:
    types = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    differing = [f"{n}: {t} / {types.get(n)}" for n, t in frame.dtypes if SAME_TYPE.get(t) != types.get(n)]
    if differing:
        return False, f"types differ: {differing}"
    spark_columns, spark_rows = normalized(frame.columns, [tuple(row) for row in frame.collect()])
    cursor = con.execute(sql)
    sql_columns = [c[0] for c in cursor.description]
    sql_columns, sql_rows = normalized(sql_columns, cursor.fetchall())
    if spark_columns != sql_columns:
        return False, f"columns {spark_columns} != {sql_columns}"
    if spark_rows != sql_rows:
        only_spark, only_sql = spark_rows - sql_rows, sql_rows - spark_rows
        return False, (
            f"rows {sum(spark_rows.values())} vs {sum(sql_rows.values())}; columns {spark_columns}\n"
            f"  only spark ({sum(only_spark.values())}): {list(only_spark)[:3]}\n"
            f"  only sql ({sum(only_sql.values())}): {list(only_sql)[:3]}"
        )
    return True, f"{sum(spark_rows.values())} rows"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*", help="queries to run; default all")
    parser.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    import __spark_entry__ as contract

    from bazaarflow.session import build_session

    spark = build_session("compare", master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf_dir)
    queries, statements = contract.queries(), contract.oracle_sql()
    failures = []
    for name in args.names or queries:
        started = time.time()
        try:
            if name in statements:
                ok, detail = compare(con, queries[name](spark, args.sf_dir), statements[name])
            else:
                frame = queries[name](spark, args.sf_dir)
                ok, detail = True, f"{len(frame.collect())} rows (no sql) {frame.columns}"
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, detail = False, f"{type(error).__name__}: {str(error)[:900]}"
        if not ok:
            failures.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - started:6.2f}s {detail}", flush=True)
    print(f"{len(failures)} failed: {failures}")
    spark.stop()
    return 1 if failures else 0


if __name__ == "__main__":
    raise SystemExit(main())
