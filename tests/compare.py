"""Side-by-side comparison of the registered queries with DuckDB (also usable as a script)."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return 0.0 if number == 0 else number
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(shaped, key=repr)


KINDS = {"long": "int", "int": "int", "bigint": "int", "integer": "int", "hugeint": "HUGEINT", "double": "float", "float": "float",
         "string": "text", "varchar": "text", "boolean": "bool", "date": "date"}


def kind(name: str) -> str:
    name = str(name).lower()
    return KINDS.get(name, name)


def differences(spark_frame, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    result = con.execute(sql)
    sql_columns = [d[0] for d in result.description]
    sql_kinds = {d[0]: kind(d[1]) for d in result.description}
    sql_rows = result.fetchall()
    frame_kinds = {f.name: kind(f.dataType.simpleString()) for f in spark_frame.schema.fields}
    rows = spark_frame.collect()
    a_columns, a = canonical(spark_frame.columns, rows)
    b_columns, b = canonical(sql_columns, sql_rows)
    if a_columns != b_columns:
        return f"columns {a_columns} vs {b_columns}"
    if frame_kinds != sql_kinds:
        return f"types {dict(set(frame_kinds.items()) - set(sql_kinds.items()))} vs {dict(set(sql_kinds.items()) - set(frame_kinds.items()))}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; first only here {[r for r in a if r not in set(b)][:2]} there {[r for r in b if r not in set(a)][:2]}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, columns {a_columns}; e.g. {wrong[0]}"
    return None


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    from ferryload.session import local_session

    spark = SparkSession.builder.master("local[8]").getOrCreate() if os.environ.get("PLAIN_SESSION") else local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, failed = duck(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = query(spark, folder)
            problem = differences(frame, con, oracle[name]) if name in oracle else None
            count = "" if name in oracle else f"rows only: {frame.count()}"
        except Exception as error:  # report and go on with the next query
            problem, count = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += problem is not None
        print(f"{'OK  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name} {count} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
