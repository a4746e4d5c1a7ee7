"""Run registered queries against DuckDB on the same parquet tables."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple("" if v is None else str(v) for v in row)


def compare(spark, con, name, run, sql, sf_dir) -> str:
    """Empty text when rows, names and values agree exactly."""
    started = time.time()
    df = run(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    started = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    note = f"{len(mine)} rows, {spent:.1f}s / {time.time() - started:.1f}s"
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    order = [df.columns.index(n) for n in sorted(names)]
    other = [names.index(n) for n in sorted(names)]
    a = sorted((_key([r[i] for i in order]) for r in mine))
    b = sorted((_key([r[i] for i in other]) for r in theirs))
    print(f"  {name}: {note}", flush=True)
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        extra = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        return f"{len(bad)} of {len(a)} rows differ, {sorted(names)}: {extra}"
    return ""


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf_dir: str, wanted: list[str]) -> None:
    import __spark_entry__ as entry

    spark, con = session(), connect(sf_dir)
    sql, failed = entry.oracle_sql(), []
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            if name in sql:
                problem = compare(spark, con, name, run, sql[name], sf_dir)
            else:
                started = time.time()
                rows = run(spark, sf_dir).count()
                print(f"  {name}: rows only, {rows}, {time.time() - started:.1f}s", flush=True)
                problem = "" if rows else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        if problem:
            failed.append(name)
            print(f"FAIL {name}: {problem}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
