"""Compares a query with its SQL, run by DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb


def connect(folder):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(row[k]) for k in order) for row in data), key=repr)


def check(frame, sql, folder):
    expected = connect(folder).sql(sql)
    assert sorted(frame.columns) == sorted(expected.columns)
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(expected.columns, expected.fetchall())
