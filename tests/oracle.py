"""Run a query and its SQL side by side; used by the tests and by hand: python tests/oracle.py SF NAME..."""

from __future__ import annotations

import math
import os
import sys

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([canon(x) for x in v])
    if isinstance(v, dict):
        return str(sorted((k, canon(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(df, sql: str, sf_dir: str):
    """(equal, message) for a Spark result and the SQL over the same tables."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return False, f"rows {len(got[1])} != {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return not bad, f"{len(bad)} of {len(got[1])} rows differ, first {bad[:1]}" if bad else f"{len(got[1])} rows"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    os.environ["PYTHONPATH"] = sys.path[0]
    import time

    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config(map={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC"}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = f"/root/testdata/{sys.argv[1]}"
    q, o = e.queries(), e.oracle_sql()
    for name in [n for a in sys.argv[2:] for n in (sorted(x for x in q if not x.startswith(("op", "pipeline"))) if a == "own" else [a])] or q:
        t = time.time()
        try:
            df = q[name](spark, sf)
            if name in o:
                ok, say = compare(df, o[name], sf)
            else:
                rows = df.collect()
                ok, say = None, f"{len(rows)} rows, no SQL; first {str(rows[:1])[:300]}"
            print("OK " if ok else "-- " if ok is None else "BAD", name, f"{time.time() - t:.1f}s", say[:1500], flush=True)
        except Exception as x:
            print("ERR", name, str(x)[:1500], flush=True)
