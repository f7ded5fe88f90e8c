"""Compare a query with its SQL: columns, row count and values, order ignored.

Run as ``python -m tests.compare [sf_dir] [name ...]`` for a report over many queries.
"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

DIGITS = 6


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, datetime.date)):
        return value
    if isinstance(value, (int, float)) or hasattr(value, "as_tuple"):
        number = float(value)
        if math.isnan(number):
            return "nan"
        return round(number, DIGITS - 1) + 0.0
    return str(value)


def as_counter(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str:
    """Empty when both sides agree, else a short description."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    ours = df.collect()
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    a, b = as_counter(df.columns, ours), as_counter(names, theirs)
    if a != b:
        return (f"values: {sum((a - b).values())} differ, e.g. {sorted(df.columns)} "
                f"{list((a - b))[:2]} != {list((b - a))[:2]}")
    return ""


def main(argv: list[str]) -> int:
    from trialspark.plans import catalog, oracle
    from trialspark.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(
        "local[8]", "compare", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in argv[1:] or catalog.QUERIES:
        started = time.time()
        try:
            df = catalog.QUERIES[name](spark, sf_dir)
            if name in oracle.SELECTS:
                problem = difference(df, con, oracle.statement(name))
            else:
                problem = "" if df.collect() else "no rows"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4} {name:28} {time.time() - started:6.2f}s {problem}",
              flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
