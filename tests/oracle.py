"""Run a catalogue query in Spark and its SQL twin in DuckDB and compare the rows.

    python tests/oracle.py [sf] [name-prefix ...]

With ORACLE_ONLY=sql, queries without a SQL twin are left out.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf{}"


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    if value is None:
        return ("null",)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        return ("f", "nan") if math.isnan(value) else ("f", value + 0.0)
    if isinstance(value, int):
        return ("i", value)
    return ("s", str(value))


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(cell(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    """Return a problem description, or None when the two results are equal."""
    df = fn(spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = canonical(cur.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)}/{len(got)} rows differ on {sorted(columns)}: {bad[0]}"
    return None


def main() -> int:
    from sigloom.plans import catalog
    from sigloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = DATA.format(sf)
    con = connect(sf_dir)
    failures = 0
    for name, fn in catalog.QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        if os.environ.get("ORACLE_ONLY") == "sql" and name not in catalog.ORACLES:
            continue
        started = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, fn, catalog.ORACLES.get(name))
        except Exception as error:  # report and keep going
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += problem is not None
        kind = "sql" if name in catalog.ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {kind:4} {time.time() - started:6.2f}s {name} {problem or ''}", flush=True)
    print("failures", failures)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
