"""Key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltaloom.errors import ConfigError
from deltaloom.functions.types import is_integer, same_type
from deltaloom.operators.align import quoted


def key_profile(df: DataFrame, keys: list[Column], first_key: Column) -> DataFrame:
    """One row: ``duplicates``, the rows in groups of equal keys (nulls are equal here), and ``total``, the non-null
    values of the first key after normalisation. One shuffle of the keys, combined before it."""
    names = [f"p{k}" for k in range(len(keys))]
    groups = (
        df.select(*[key.alias(name) for key, name in zip(keys, names, strict=True)], first_key.isNotNull().cast("bigint").alias("_present"))
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_present").alias("_present"))
    )
    return groups.agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).cast("bigint").alias("duplicates"),
        F.coalesce(F.sum("_present"), F.lit(0)).cast("bigint").alias("total"),
    )


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row with the number of rows whose key is not theirs alone."""
    columns = [F.col(quoted(k)) for k in keys]
    return key_profile(df, columns, columns[0]).select(F.col("duplicates").alias("duplicate_rows"))


def check_key_types(names: list[str], source: list[T.DataType], target: list[T.DataType]) -> None:
    """Keys are never cast to meet: their types must agree, integers of any width among themselves."""
    for name, a, b in zip(names, source, target, strict=True):
        if not same_type(a, b) and not (is_integer(a) and is_integer(b)):
            raise ConfigError(f"Key {name} is {a.simpleString()} in the source and {b.simpleString()} in the target")
