"""A query's rows against those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb


def connection(sf_dir: str):
    found = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        source = p / "*.parquet" if p.is_dir() else p
        found.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{source}'")
    return found


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


def difference(df, sql: str, con) -> str:
    """Empty where columns and rows agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, not {sorted(names)}"
    order = sorted(names)
    rows = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    at = [names.index(c) for c in order]
    wanted = sorted(repr(tuple(plain(r[i]) for i in at)) for r in cursor.fetchall())
    if rows == wanted:
        return ""
    odd = next(((a, b) for a, b in zip(rows, wanted) if a != b), "")
    return f"{len(rows)} rows, {len(wanted)} wanted; first difference {odd}"
