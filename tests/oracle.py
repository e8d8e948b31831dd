"""Run catalogue queries on Spark and their SQL on DuckDB and compare the rows.

    python -m tests.oracle [scale] [name ...]
"""
from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cpus: str = "8") -> SparkSession:
    from lexloom.session import configure
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("lexloom")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message) for one query."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    if os.environ.get("AUDIT"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        odd = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython") if w in plan]
        print("PLAN", name, odd, flush=True) if odd else None
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return True, f"rows only: {len(got[1])} rows, {t1 - t0:.1f}s"
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    note = f"{len(got[1])} rows, spark {t1 - t0:.1f}s, duckdb {t2 - t1:.1f}s"
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return False, f"{note}; {len(want[1])} expected; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    types = dict(df.dtypes)
    wide = {"bigint": ("BIGINT",), "double": ("DOUBLE",), "string": ("VARCHAR",), "boolean": ("BOOLEAN", "bool")}
    odd = [(n, types[n], str(d[1])) for n, d in zip([d[0] for d in cur.description], cur.description)
           if types[n] in wide and str(d[1]).upper() not in [w.upper() for w in wide[types[n]]] + {"string": ["STRING"], "double": ["NUMBER"], "bigint": ["NUMBER"]}.get(types[n], [])]
    return True, note + (f" TYPES {odd}" if odd else "")


def main(argv):
    scale = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{scale}"
    import __spark_entry__ as e
    queries, oracles = e.queries(), e.oracle_sql()
    names = argv[1:] or list(queries)
    names = [n for p in names for n in queries if n == p or (p.endswith("*") and n.startswith(p[:-1]))]
    spark, con, bad = session(), duck(sf_dir), []
    for n in names:
        try:
            ok, msg = compare(spark, con, n, queries[n], oracles.get(n), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, msg = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        print(("ok   " if ok else "FAIL ") + n + ": " + msg, flush=True)
        bad += [] if ok else [n]
    print(f"{len(names) - len(bad)}/{len(names)} agree", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    code = main(sys.argv[1:])
    os._exit(code)
