"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python tests/compare.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tablegauge.session import scratch  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        # Sums differ in their last bits, so a value halfway between two roundings may go either way.
        return a == b or abs(a - b) <= max(1e-9, 1e-8 * max(abs(a), abs(b)))
    return type(a) is type(b) and a == b


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    cols = sorted(names)
    order = [names.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def compare(spark, con, sf_dir, name, fn, sql) -> str:
    """'ok', or a description of the first difference."""
    with scratch(spark):
        cols, rows = spark_rows(fn(spark, sf_dir))
    if sql is None:
        return f"rows only ({len(rows)})"
    want_cols, want = duck_rows(con, sql)
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}: {rows[:2]} vs {want[:2]}"
    for a, b in zip(rows, want):
        for c, x, y in zip(cols, a, b):
            if not same(x, y):
                return f"{c}: {x!r} != {y!r} in\n    {a}\n    {b}"
    return f"ok ({len(rows)})"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tablegauge.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:
            verdict = "ERROR " + str(e)[:1500]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        good = verdict.startswith(("ok", "rows only"))
        bad += not good
        print(f"{time.time() - start:6.2f}s {'   ' if good else 'BAD'} {name}: {verdict}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
