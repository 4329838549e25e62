"""Holds a query's rows against its SQL in DuckDB."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype == bool:
        return bool(v)
    if hasattr(v, "tolist") and getattr(v, "shape", ()) != ():
        return [plain(x) for x in v.tolist()]
    return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


def rows(df):
    cols = sorted(df.columns)
    return sorted(str([plain(v) for v in r]) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist())


def same(con, sql, frame):
    want = con.sql(sql).df()
    assert sorted(want.columns) == sorted(frame.columns)
    assert rows(want) == rows(frame)
