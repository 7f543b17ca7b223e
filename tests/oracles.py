"""Spark's and DuckDB's answers to the queries, side by side: python tests/oracles.py DIR [NAME...]"""

import math
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))


def views(folder):
    import duckdb

    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: float(v) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(([tidy(r[i]) for i in order] for r in data), key=repr), sorted(columns)


def differ(spark, con, name, query, sql, folder):
    df = query(spark, folder)
    a, ca = rows(df.columns, df.collect())
    q = con.sql(sql)
    b, cb = rows(q.columns, q.fetchall())
    if ca != cb:
        return f"columns {ca} {cb}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if u != v and not (isinstance(u, float) and isinstance(v, (int, float)) and math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9)):
                return f"{x} and {y}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    queries, sql, con = e.queries(), e.oracle_sql(), views(sys.argv[1])
    for n in sys.argv[2:] or [k for k in queries if not k.startswith("op") and k != "pipeline"]:
        try:
            print(n, (differ(s, con, n, queries[n], sql[n], sys.argv[1]) or "same") if n in sql else f"{queries[n](s, sys.argv[1]).count()} rows", flush=True)
        except Exception as x:
            print(n, "ERROR", str(x)[:400].replace("\n", " "), flush=True)
