"""Compare registered queries with their SQL: python -m tests.compare [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return "NaN" if value != value else round(value, 6) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def difference(spark, con, sf_dir: str, query, sql: str) -> str | None:
    """None when both sides return the same columns and rows."""
    ours = query(spark, sf_dir)
    theirs = con.execute(sql)
    names = [d[0] for d in theirs.description]
    if sorted(names) != sorted(ours.columns):
        return f"columns {sorted(ours.columns)} vs {sorted(names)}"
    left, right = _rows(ours.columns, [tuple(r) for r in ours.collect()]), _rows(names, theirs.fetchall())
    if left == right:
        return None
    a, b = set(map(repr, left)), set(map(repr, right))
    return f"{len(left)} vs {len(right)} rows; only ours {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from traincover import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, query in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        started = time.time()
        sql = oracle_sql().get(name)
        try:
            if sql:
                result = difference(spark, con, sf_dir, query, sql)
            else:
                result = None
                print(name, query(spark, sf_dir).toPandas().to_string())
        except Exception as error:  # report and go on
            result = f"{type(error).__name__}: {str(error)[:600]}"
        failed += result is not None
        print(f"{'FAIL' if result else 'ok  '} {name} {time.time() - started:.1f}s {result or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
