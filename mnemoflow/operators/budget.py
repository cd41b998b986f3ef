"""What a memory of limited tokens keeps.

An entry's fate depends only on the tokens that came after it, so dropping the oldest while over budget is one window sum.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Token limits of a memory block and of the summary agent's, and of the short-term queue.
BLOCK_LIMIT, AGENT_LIMIT = 60_000, 50
SHORT_LIMIT, SHORT_SHARE, FLUSH = 50, 0.7, 10


def _from_newest(keys: list[str], seq: str, tokens: str) -> Column:
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(tokens).over(w)


def recent(df: DataFrame, keys: list[str], seq: str, tokens: str, limit: int) -> DataFrame:
    """The newest entries that fit in limit tokens together; none if the very last exceeds it."""
    return df.withColumn("tokens_from_here", _from_newest(keys, seq, tokens)).where(F.col("tokens_from_here") <= limit)


def joined(df: DataFrame, keys: list[str], seq: str, text: str) -> DataFrame:
    """keys, memory: the entries in order, a line each."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("t"), F.col(text).alias("x"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["x"]), "\n").alias("memory"))


def condensed(df: DataFrame, keys: list[str], seq: str, tokens: str, text: str, limit: int) -> DataFrame:
    """keys, n, memory of every owner; an owner of whom nothing fits has an empty memory.  One shuffle serves window and sum."""
    marked = df.withColumn("kept_", _from_newest(keys, seq, tokens) <= limit)
    rows = F.array_sort(F.collect_list(F.when(F.col("kept_"), F.struct(F.col(seq).alias("t"), F.col(text).alias("x")))))
    return marked.groupBy(*keys).agg(F.count(F.when(F.col("kept_"), 1)).alias("n"), F.array_join(F.transform(rows, lambda r: r["x"]), "\n").alias("memory"))


def tiers(df: DataFrame, keys: list[str], seq: str, tokens: str, limit: int = SHORT_LIMIT, share: float = SHORT_SHARE) -> DataFrame:
    """df with tier: 'short' for what fits in share of the limit, 'long' for what is archived."""
    return df.withColumn("tier", F.when(_from_newest(keys, seq, tokens) <= limit * share, "short").otherwise("long"))


def flushed(df: DataFrame, keys: list[str], seq: str, tokens: str, limit: int = SHORT_LIMIT, share: float = SHORT_SHARE, chunk: int = FLUSH) -> DataFrame:
    """keys, seq, wave: when each entry leaves a first-in first-out queue, null if it stays.

    Our contract for flushing with hysteresis: whenever the queue holds more than limit * share tokens, entries leave oldest first
    until it holds no more than that and chunk tokens have left in this wave.  The fold runs within one conversation.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys, seq).dtypes) + ", wave int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq)
        sizes, waves = pdf[tokens].tolist(), [None] * len(pdf)
        head = held = wave = 0
        for i, n in enumerate(sizes):
            held += n
            if held > limit * share:
                wave, out = wave + 1, 0
                while head <= i and (held > limit * share or out < chunk):
                    held, out, waves[head], head = held - sizes[head], out + sizes[head], wave, head + 1
        return pdf[[*keys, seq]].assign(wave=pd.array(waves, dtype="Int32"))

    return df.select(*keys, seq, tokens).groupBy(*keys).applyInPandas(fold, schema)


def by_priority(df: DataFrame, keys: list[str], priority: str, tokens: str, limit: int, tie: str) -> DataFrame:
    """Blocks kept within limit: priority 0 always, then the lower numbers first."""
    w = Window.partitionBy(*keys).orderBy(priority, tie).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("tokens_up_to_here", F.sum(tokens).over(w)).where((F.col(priority) == 0) | (F.col("tokens_up_to_here") <= limit))
