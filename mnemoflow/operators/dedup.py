"""First-seen deduplication in order.

A null value or owner is one like any other; of equal places in the order any row may stand; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

STORED = 300


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def first_of_each(df: DataFrame, keys: list[str], value: str, seq: list[str]) -> DataFrame:
    """The first row of each exact value within keys."""
    w, nth = Window.partitionBy(*keys, value).orderBy(*seq), fresh(df, "nth")
    return df.withColumn(nth, F.row_number().over(w)).where(F.col(nth) == 1).drop(nth)


def episodes_kept(df: DataFrame, keys: list[str], user_input: str, seq: list[str]) -> DataFrame:
    """Episodes that a store keeps: it compares a new input with the first 300 characters of those stored.

    So a longer input never equals a stored one, an empty one isn't compared, and else the first of equal inputs stays.  Inputs are stripped ones.
    """
    key, nth = fresh(df, "key_"), fresh(df, "nth_")
    marked = df.withColumn(key, X.strip(F.lower(F.left(F.col(user_input), F.lit(STORED)))))
    marked = marked.withColumn(nth, F.row_number().over(Window.partitionBy(*keys, key).orderBy(*seq)))
    return marked.where((F.length(user_input) > STORED) | (F.col(key) == "") | (F.col(nth) == 1)).drop(key, nth)


def over_cap(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, n of the owners that hold most statements or more, and so condense."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= most)
