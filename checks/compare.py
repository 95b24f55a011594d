"""Run queries in Spark and their SQL in DuckDB, and compare all values.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(folder: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        path = os.path.join(folder, f"{table}.parquet")
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    """Columns by name, values as text, rows sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return [columns[i] for i in order], sorted(tuple(text(row[i]) for i in order) for row in rows)


def difference(spark_frame, connection, sql: str) -> str | None:
    """None when both sides agree, else what differs first."""
    result = connection.execute(sql)
    want = canonical([d[0] for d in result.description], result.fetchall())
    got = canonical(spark_frame.columns, spark_frame.collect())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows against {len(want[1])}"
    for mine, theirs in zip(got[1], want[1]):
        if mine != theirs:
            return f"{mine}\n   against {theirs}"
    return None


def main() -> int:
    from checks.oracles import statements
    from checks.queries import queries
    from palisade import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("local[8]", spark_sql_shuffle_partitions="8", spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql, failed = database(folder), statements(), 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            if name in sql:
                problem = difference(query(spark, folder), connection, sql[name])
                rows = ""
            else:
                rows, problem = f" ({query(spark, folder).count()} rows, no SQL)", None
        except Exception as error:  # a broken query must not hide the others
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - began:.1f}s{rows}", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print(f"{failed} differ")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
