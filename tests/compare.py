"""Run registered queries on Spark and their SQL on DuckDB; report differences.

``python tests/compare.py [data folder] [query ...]``
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def difference(spark_df, con, sql: str) -> tuple[int, str]:
    """Row count and what differs ('' if nothing)."""
    ours = spark_df.toPandas()
    middle = time.time()
    theirs = con.execute(sql).df()
    print(f"  (sql {time.time() - middle:.1f}s)", end=" ")
    if sorted(ours.columns) != sorted(theirs.columns):
        return len(ours), f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    names = sorted(ours.columns)

    def rows(frame):
        plain = frame[names].astype(object).where(frame[names].notna(), None)
        return sorted((tuple(map(str, r)) for r in plain.itertuples(index=False)))

    a, b = rows(ours), rows(theirs)
    if len(a) != len(b):
        only = [r for r in set(a) ^ set(b)][:2]
        return len(a), f"rows {len(a)} / {len(b)}; e.g. {only}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return len(a), f"{len(bad)} values differ; e.g.\n  {bad[0][0]}\n  {bad[0][1]}"
    types = con.execute(f"DESCRIBE {sql}").df().set_index("column_name")["column_type"]
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    odd = [(n, t, types[n]) for n, t in spark_df.dtypes if pairs.get(t, t) != types[n]]
    return len(a), f"types {odd}" if odd else ""


if __name__ == "__main__":
    from keysift.catalog.oracles import ORACLES
    from keysift.catalog.queries import QUERIES
    from keysift.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in wanted:
        start = time.time()
        try:
            result = QUERIES[name](spark, sf_dir)
            n, diff = difference(result, con, ORACLES[name]) if name in ORACLES else (result.count(), "no oracle")
        except Exception as error:
            n, diff = -1, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if not diff else 'DIFF'} {name:28s} {n:7d} rows {time.time() - start:6.1f}s {diff}", flush=True)
