"""Run registered queries and their SQL twins side by side.

    python -m tests.oracle [sf] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path("/root/testdata")


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("castloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return plain(tuple(value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    names, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    other_names, theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != other_names:
        return f"columns {names} != {other_names}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    if not mine:
        return "no rows"
    for a, b in zip(mine, theirs, strict=True):
        if repr(a) != repr(b):
            return f"{a!r:.600} !=\n      {b!r:.600}"
    return None


def main() -> int:
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = str(ROOT / f"sf{sf}")
    spark, con = session(), connect(folder)
    oracles, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                state = "ok" if problem is None else f"FAIL {problem}"
            else:
                problem, n = None, df.count()
                state = f"rows {n}"
        except Exception as error:  # report and go on with the next query
            problem = state = f"ERROR {str(error).splitlines()[0][:400]}"
            if os.environ.get("VERBOSE"):
                traceback.print_exc()
        bad += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {state}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
