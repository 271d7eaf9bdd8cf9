"""Words, names and small helpers that several operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def words(text: str | None) -> list[bytes]:
    r"""The runs of ``[^\x20\x09-\x0D]+`` as UTF-8; bytes.split() without arguments cuts at exactly these six."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def folded_words(text: str | None) -> list[bytes]:
    """The same with A-Z lower-cased; bytes.lower() touches no other letter."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def place_of(df: DataFrame, name: str) -> int:
    """Where the column of that name stands: in that very case if there is one, else in any."""
    if name in df.columns:
        return df.columns.index(name)
    folded = [c.lower() for c in df.columns]
    if name.lower() in folded:
        return folded.index(name.lower())
    raise ValueError(f"no column {name!r} among {df.columns}")


def by_place(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ... in place of its names, which may differ in case only or be the operator's own."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def named(df: DataFrame, *names: str) -> DataFrame:
    """The columns of these names and nothing else of df."""
    return by_place(df).select(*[F.col(f"c{place_of(df, name)}").alias(name) for name in names])


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """doc_id as bigint, text as string: whatever else docs has stays behind."""
    return named(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values in Spark's signed bigint."""
    return values.astype(np.uint64).view(np.int64)
