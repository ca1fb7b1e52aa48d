"""Run queries and their SQL side by side on one folder of tables.

    python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES
from spoor.session import local_session


def _key(value):
    if isinstance(value, float):
        value = 0.0 if value == 0 else value
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def compare(spark, connection, name: str, folder: str) -> tuple[str, float, float]:
    start = time.time()
    df = QUERIES[name](spark, folder)
    ours = [tuple(r) for r in df.collect()]
    spark_seconds = time.time() - start
    if name not in ORACLE:
        return f"{len(ours)} rows, no SQL", spark_seconds, 0.0
    start = time.time()
    cursor = connection.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    sql_seconds = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {df.columns} / {names}", spark_seconds, sql_seconds
    a, b = _rows(df.columns, ours), _rows(names, theirs)
    if a == b:
        return f"ok {len(a)} rows", spark_seconds, sql_seconds
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    report = f"DIFFERENT {len(a)} / {len(b)} rows, spark {only_a[:3]}, sql {only_b[:3]}"
    return report, spark_seconds, sql_seconds


def connect(folder: str):
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, connection = local_session(8), connect(folder)
    for name in sys.argv[2:] or QUERIES:
        try:
            result, ours, theirs = compare(spark, connection, name, folder)
        except Exception as error:  # report and go on with the next query
            result, ours, theirs = f"ERROR {str(error)[:1500]}", 0.0, 0.0
        print(f"{name:32s} {ours:6.1f}s {theirs:6.1f}s  {result}", flush=True)


if __name__ == "__main__":
    main()
