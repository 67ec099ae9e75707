"""Runs registered queries next to their check SQL: ``python -m checks.run [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

from checks.catalog import QUERIES
from checks.oracle import ORACLES
from visitlens.session import build

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return value if value is None else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(normal(r[i]) for i in order) for r in rows], key=lambda r: tuple(str(x) for x in r))


def compare(spark, con, sf_dir, name, df=None):
    started = time.time()
    df = QUERIES[name](spark, sf_dir) if df is None else df
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if name not in ORACLES:
        return "no-sql", len(got), took, ""
    result = con.sql(ORACLES[name])
    want_names = result.columns
    want = rows_of(want_names, result.fetchall())
    if sorted(want_names) != sorted(df.columns):
        return "COLUMNS", len(got), took, f"{sorted(df.columns)} vs {sorted(want_names)}"
    if got == want:
        return "ok", len(got), took, ""
    only_got = [r for r in got if r not in set(want)][:3]
    only_want = [r for r in want if r not in set(got)][:3]
    return "DIFF", len(got), took, f"{sorted(df.columns)}\n   spark {len(got)}: {only_got}\n   sql   {len(want)}: {only_want}"


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(
        "checks",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    bad = 0
    for name in names:
        try:
            status, n, took, note = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            status, n, took, note = "ERROR", 0, 0.0, str(error)[:600]
        bad += status not in ("ok", "no-sql")
        print(f"{status:8} {name:32} rows={n:<7} {took:6.2f}s {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
