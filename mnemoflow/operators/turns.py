"""Turns of conversations: cleaning, pairing, batches and rendering.

``keys`` names a conversation, and its session where it has several; ``turn`` orders it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

END_OF_TEXT = "<|endoftext|>"
ROLES = ("user", "assistant")


def cleaned(df: DataFrame) -> DataFrame:
    """User and assistant turns only, without end-of-text marks."""
    return df.where(F.col("role").isin(*ROLES)).withColumn("text", F.replace("text", F.lit(END_OF_TEXT), F.lit("")))


def paired(df: DataFrame, keys: list[str], turn: str = "turn") -> DataFrame:
    """An assistant turn right after a user turn, with it: keys, turn, user_text, assistant_text."""
    w = Window.partitionBy(*keys).orderBy(turn)
    two = df.select(*keys, turn, "role", "text", F.lag("role").over(w).alias("before"), F.lag("text").over(w).alias("user_text"))
    return two.where("role = 'assistant' and before = 'user'").select(*keys, turn, "user_text", F.col("text").alias("assistant_text"))


def _joined(df: DataFrame, keys: list[str], one: Column, turn: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), one.alias("x"))))
    return df.groupBy(*keys).agg(F.count("*").alias("n_turns"), F.array_join(F.transform(rows, lambda r: r["x"]), "\n").alias("text"))


def batches(df: DataFrame, keys: list[str], turn: str = "turn", roles: bool = True) -> DataFrame:
    """One text for each session, "ROLE: content" lines or contents alone: keys, n_turns, text."""
    one = F.concat(F.upper("role"), F.lit(": "), F.coalesce("text", F.lit(""))) if roles else F.coalesce("text", F.lit(""))
    return _joined(df, keys, one, turn)


def rendered(role: Column | str, text: Column | str) -> Column:
    """Role and content of one line of a prompt's history."""
    return F.concat(X.capitalized(role), F.lit(": "), text if isinstance(text, Column) else F.col(text))
