"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(d: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    return v


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(spark, con, plan, sql, d):
    """(rows, message or None)."""
    df = plan(spark, d)
    s_names, s_rows = _sorted(df.columns, [tuple(r) for r in df.collect()])
    con.execute(sql)
    raw = con.fetchall()
    names = [c[0] for c in con.description]
    o_names, o_rows = _sorted(names, raw)
    if s_names != o_names:
        return len(s_rows), f"columns differ: {s_names} vs {o_names}"
    if len(s_rows) != len(o_rows):
        return len(s_rows), f"row counts differ: {len(s_rows)} vs {len(o_rows)}"
    s_map, o_map = {}, {}
    if s_rows != o_rows:
        s_left = [r for r in s_rows if r not in set(o_rows)][:2]
        o_left = [r for r in o_rows if r not in set(s_rows)][:2]
        n = len(set(s_rows) - set(o_rows))
        if n == 0 and set(s_rows) == set(o_rows) and sorted(map(repr, s_rows)) == sorted(map(repr, o_rows)):
            return len(s_rows), None
        return len(s_rows), f"{n} rows differ on {s_names}\n   spark {s_left}\n   duck  {o_left}"
    return len(s_rows), None


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from sloframe.session import get_session

    sf = "sf0.01"
    if argv and argv[0].startswith("sf"):
        sf = argv.pop(0)
    d = f"/root/testdata/{sf}"
    spark = get_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
                        spark__sql__warehouse__dir="/tmp/sloframe-warehouse")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(d)
    plans, sqls = queries(), oracle_sql()
    names = [n for n in plans if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            if n in sqls:
                rows, msg = compare(spark, con, plans[n], sqls[n], d)
            else:
                rows, msg = len(plans[n](spark, d).collect()), None
        except Exception as e:  # noqa: BLE001
            rows, msg = -1, f"{type(e).__name__}: {str(e)[:900]}"
        mark = "ok " if msg is None else "BAD"
        bad += msg is not None
        print(f"{mark} {n:34s} rows={rows} {time.time() - t:.1f}s{'' if n in sqls else ' (no oracle)'}{'' if msg is None else chr(10) + '   ' + msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
