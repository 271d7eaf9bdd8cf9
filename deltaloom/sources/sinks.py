"""Writes the rows that differ."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_artifact(df: DataFrame, rows: int, folder: str, name: str, kind: str) -> None:
    """``<folder>/<name>.<kind>``, a directory of part files; nothing if there are no rows.

    The rows are written by the executors in as many parts as the plan has: at size one file would be one task.
    """
    if not rows:
        return
    if kind not in ("csv", "parquet"):
        raise NotImplementedError(f"No writer for {kind!r}: csv and parquet can be written")
    writer = df.write.mode("overwrite")
    path = f"{folder.rstrip('/')}/{name}.{kind}"
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)
