"""Run registered queries next to their SQL and report differences.

    python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.oracle import ORACLE
from checks.registry import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows sorted."""
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.columns:
        values = frame[column]
        if str(values.dtype).startswith("datetime"):
            values = values.astype("datetime64[us]").astype(str)
        elif values.dtype == object and values.map(lambda v: hasattr(v, "isoformat")).any():
            values = pd.to_datetime(values).astype("datetime64[us]").astype(str)
        elif str(values.dtype).lower().startswith("float"):
            values = values.map(lambda v: "null" if pd.isna(v) else repr(float(v)))
        frame[column] = values.map(lambda v: "null" if v is None or v is pd.NA or v != v or v == "NaT" else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def difference(spark, folder: str, name: str, connection) -> str | None:
    """None if query and SQL agree, else what differs."""
    mine = QUERIES[name](spark, folder).toPandas()
    other = connection.execute(ORACLE[name]).df()
    if sorted(mine.columns) != sorted(other.columns):
        return f"columns {sorted(mine.columns)} / {sorted(other.columns)}"
    if len(mine) != len(other):
        return f"rows {len(mine)} / {len(other)}"
    left, right = canonical(mine), canonical(other)
    kinds = [
        (c, mine[c].dtype.kind, other[c].dtype.kind)
        for c in left.columns
        if {mine[c].dtype.kind, other[c].dtype.kind} & set("iuf") and len(mine)
        and mine[c].notna().all() and mine[c].dtype != other[c].dtype
    ]
    if kinds:
        return f"types {kinds}"
    if not left.equals(right):
        where = (left != right).any(axis=1)
        return f"{where.sum()} rows differ\n{left[where].head(5)}\n{right[where].head(5)}"
    return None


def main() -> int:
    from eventide.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, connection = local_session(), connect(folder)
    failed = 0
    for name in names:
        begun = time.time()
        if name not in ORACLE:
            rows = QUERIES[name](spark, folder).count()
            print(f"{name:32s} {time.time() - begun:6.2f}s  no SQL, {rows} rows", flush=True)
            continue
        try:
            found = difference(spark, folder, name, connection)
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += found is not None
        print(f"{name:32s} {time.time() - begun:6.2f}s  {'ok' if found is None else 'DIFFERS ' + found}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
