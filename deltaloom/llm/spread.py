"""Joins that spread the rows of hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows, so there are fewer than its inverse of them.
HOT_SHARE = 1e-4


def join_each(rows: DataFrame, of_keys: DataFrame, key: str, total: int) -> DataFrame:
    """Adds to each row what ``of_keys`` has for its key: one row for each key, with the number of rows in ``n``.

    Keys of more than HOT_SHARE of all rows are at most 1 / HOT_SHARE, so what they have is broadcast and their rows stay
    where they are. All others meet by shuffle, where no key has more than that share.
    """
    hot = F.col("n") > total * HOT_SHARE
    few = F.broadcast(of_keys.where(hot).drop("n"))
    spread = rows.join(few, key)
    rest = rows.join(F.broadcast(of_keys.where(hot).select(key)), key, "left_anti")
    return spread.unionByName(rest.join(of_keys.where(~hot).drop("n"), key))
