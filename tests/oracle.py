"""Compare registered queries with their SQL texts: `python tests/oracle.py [folder] [names…]`."""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _value(value) -> str:
    if value is None or value is pd.NaT:
        return "NULL"
    if isinstance(value, float):
        return "NULL" if value != value else repr(value)
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return str(value)


def normal(columns, rows) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "SMALLINT": "smallint",
    "FLOAT": "float",
}


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    kinds = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    expected = normal(columns, result.fetchall())
    actual = normal(df.columns, [tuple(r) for r in df.collect()])
    if expected[0] != actual[0]:
        return f"columns {actual[0]} != {expected[0]}"
    if len(expected[1]) != len(actual[1]):
        return f"rows {len(actual[1])} != {len(expected[1])}"
    wrong = [(a, e) for a, e in zip(actual[1], expected[1], strict=True) if a != e]
    if wrong:
        return f"{len(wrong)} of {len(actual[1])} rows differ: {str(wrong[:2])[:700]}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    odd = {k: (types[k], v) for k, v in kinds.items() if types[k] != v}
    return f"types differ (ours, sql): {odd}" if odd else None


def main() -> None:
    import __spark_entry__ as entry
    from casewell.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(folder), entry.oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                rows = ""
            else:
                problem, rows = None, f"no SQL, {df.count()} rows"
        except Exception as error:
            problem, rows = "".join(traceback.format_exception_only(error))[:900], ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem or rows}", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")


if __name__ == "__main__":
    main()
