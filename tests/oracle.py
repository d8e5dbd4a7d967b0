"""Run registered queries on Spark and their SQL on DuckDB and compare the sorted rows.

    python tests/oracle.py [sf-folder] [query ...]
"""

from __future__ import annotations

import datetime
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SPARK_SECONDS: list[float] = []
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(str([_plain(r[i]) for i in order]) for r in rows)


def compare(spark, con, folder, fn, text):
    began = time.time()
    got = fn(spark, folder)
    left = rows_of(got.columns, [tuple(r) for r in got.collect()])
    plan = got._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if banned in plan:
            return False, f"plan holds a {banned}"
    SPARK_SECONDS.append(time.time() - began)
    if text is None:
        return True, f"{len(left[1])} rows (no SQL)"
    cur = con.execute(text)
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left == right:
        return True, f"{len(left[1])} rows"
    if left[0] != right[0]:
        return False, f"columns {left[0]} / {right[0]}"
    only_left = sorted(set(left[1]) - set(right[1]))
    only_right = sorted(set(right[1]) - set(left[1]))
    return False, (
        f"rows {len(left[1])} / {len(right[1])}; spark only {len(only_left)}: {only_left[:3]}; "
        f"sql only {len(only_right)}: {only_right[:3]}"
    )


def session():
    from corpusloom.session import build_session

    spark = build_session(
        "oracle", "local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
            "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = session(), duck(folder)
    failed = 0
    for name, fn in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        began = time.time()
        try:
            ok, note = compare(spark, con, folder, fn, entry.oracle_sql().get(name))
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - began:.1f}s (spark {SPARK_SECONDS[-1] if SPARK_SECONDS else 0:.1f}s) {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
