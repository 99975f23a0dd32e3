"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot above this share of all rows, so there are fewer hot keys than its inverse, whatever the data.
SHARE = 1 / 200


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> list:
    """The keys that hold more than SHARE of ``total`` rows, for a table with one row and its count for each key; 200 at most."""
    return [r[0] for r in counts.where(F.col(n) > F.lit(total * SHARE)).select(key).collect()]


def join_hot(rows: DataFrame, table: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``rows.join(table, key, how)`` for a table with one row a key; rows of hot keys stay where they are.

    The hot part of the table has no more rows than there are hot keys, so it
    is broadcast; all other keys are shuffled.
    """
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(table.where(~is_hot), key, how).unionByName(rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key, how))
