"""Order-insensitive comparison of a Spark result with its SQL twin."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value: object) -> str:
    if isinstance(value, (list, tuple, np.ndarray)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    if value is None or value is pd.NaT or (isinstance(value, float) and np.isnan(value)) or value is pd.NA:
        return "null"
    if isinstance(value, (float, np.floating)):
        return repr(float(value) + 0.0)
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value)).lower()
    return str(value)


def _kind(series: pd.Series) -> str:
    kind = series.dtype.kind
    return {"i": "int", "u": "int", "f": "float", "b": "bool", "M": "time"}.get(kind, "text")


def rows_of(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(zip(*[[_cell(v) for v in frame[c].tolist()] for c in columns], strict=True))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else a short description of the first difference."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = {c: (_kind(got[c]), _kind(want[c])) for c in got.columns}
    wrong = {c: k for c, k in kinds.items() if k[0] != k[1]}
    if wrong and len(got):
        return f"types {wrong}"
    a, b = rows_of(got), rows_of(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        return f"{len(diff)} rows differ, first {diff[0]}"
    return None
