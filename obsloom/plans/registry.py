"""Query registry: each entry is a Spark callable and, where possible, its SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def _shape(df: DataFrame, dbl, big) -> DataFrame:
    cols = []
    for c in df.columns:
        if c in dbl:
            cols.append((F.round(F.col(c).cast("double"), dbl[c]) + F.lit(0.0)).alias(c))
        elif c in big:
            cols.append(F.col(c).cast("long").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def query(name: str, sql: str | None = None, dbl: str = "", big: str = "", d: int = 6):
    """Registers a query. Columns in ``dbl`` are rounded, those in ``big`` cast, on both engines alike.

    ``name:3`` in ``dbl`` sets the digits of one column."""
    dbl = {c.split(":")[0]: int((c.split(":") + [d])[1]) for c in dbl.split()}
    big = big.split()

    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: _shape(fn(spark, sf_dir), dbl, big)
        if sql:
            edits = [f'round(CAST("{c}" AS DOUBLE), {k}) + 0.0 AS "{c}"' for c, k in dbl.items()]
            edits += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in big]
            head = f"SELECT * REPLACE ({', '.join(edits)})" if edits else "SELECT *"
            ORACLES[name] = f"{head} FROM (\n{sql.strip()}\n) AS result_rows"
        return fn

    return wrap
