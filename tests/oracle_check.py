"""Runs registered queries against their SQL: python tests/oracle_check.py [sf] [name or prefix* ...]

``--buckets N`` sets the rows of a value bucket, so that small tables are cut into many."""
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cores="8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("obsloom-check")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, sf):
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if not sql:
        return "rows", len(got), df.schema.simpleString()
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return "FAIL", len(got), f"columns {sorted(df.columns)} vs {sorted(rel.columns)}"
    names = sorted(df.columns)
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    duck_types = {c: str(t).lower() for c, t in zip(rel.columns, rel.types)}
    alias = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean"}
    bad = [(c, spark_types[c], duck_types[c]) for c in names
           if alias.get(spark_types[c]) and alias[spark_types[c]] != duck_types[c]]
    if len(got) != len(want):
        return "FAIL", len(got), f"rows {len(got)} vs {len(want)} first {got[:2]} | {want[:2]}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        g, w = diff[0]
        cells = [(n, a, b) for n, a, b in zip(names, g, w) if a != b]
        return "FAIL", len(got), f"{len(diff)} rows differ: {cells} in {g}"
    if bad:
        return "FAIL", len(got), f"types {bad}"
    return ("ok" if got else "EMPTY"), len(got), ""


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


if __name__ == "__main__":
    import __spark_entry__ as entry
    if "--buckets" in sys.argv:
        from obsloom.operators import order
        at = sys.argv.index("--buckets")
        rows, plain = int(sys.argv[at + 1]), order._bucketed
        del sys.argv[at:at + 2]
        order._bucketed = lambda df, value, _: plain(df, value, rows)
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    want = sys.argv[2:]
    spark, con, queries, oracles = session(), connect(sf), entry.queries(), entry.oracle_sql()
    tally = {}
    for name, fn in queries.items():
        if want and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in want):
            continue
        t = time.time()
        try:
            status, n, note = compare(spark, con, fn, oracles.get(name), sf)
        except Exception as e:  # noqa: BLE001
            status, n, note = "ERROR", 0, f"{type(e).__name__}: {str(e)[:700]}"
        tally[status] = tally.get(status, 0) + 1
        quiet = status == "ok" and not want
        print(f"{status:6s} {name:28s} rows={n:<7d} {time.time() - t:5.1f}s {note[:900] if status != 'rows' else ''}",
              flush=True) if not (quiet and time.time() - t < 4) else None
    print(tally)
