"""Incremental forms of the ordered operators: arrivals in any order, results as of the whole history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TokenBuffer(StatefulProcessor):
    """The newest entries within a token limit.

    State is the entries held and the highest sequence number ever dropped: an old entry that comes late, below that mark, would not
    have survived, and stays out.  A row without tok clears the memory as of its sequence number.
    """

    def __init__(self, limit: int, key: str):
        self.limit, self.key = limit, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "seq bigint", "tok bigint, text string")
        self.dropped = handle.getValueState("dropped", "seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        mark = self.dropped.get()[0] if self.dropped.exists() else -1
        held = {int(k[0]): (int(v[0]), v[1]) for k, v in self.entries.iterator()}
        was = set(held)
        for pdf in rows:
            for seq, tok, text in zip(pdf["seq"], pdf["tok"], pdf["text"], strict=True):
                if pd.isna(tok):
                    mark = max(mark, int(seq))
                elif seq > mark:
                    held[int(seq)] = (int(tok), text)
        held = {seq: entry for seq, entry in held.items() if seq > mark}
        total = 0
        kept = {}
        for seq in sorted(held, reverse=True):
            total += held[seq][0]
            if total > self.limit:
                mark = max(mark, seq)
                break
            kept[seq] = held[seq]
        for seq in was - set(kept):
            self.entries.removeKey((seq,))
        for seq in set(kept) - was:
            self.entries.updateValue((seq,), kept[seq])
        if mark >= 0:
            self.dropped.update((mark,))
        yield pd.DataFrame({self.key: [key[0]], "n": [len(kept)], "memory": ["\n".join(kept[s][1] for s in sorted(kept) if kept[s][1] is not None)]})

    def close(self) -> None: ...


def token_buffer(stream: DataFrame, key: str, limit: int) -> DataFrame:
    """key, n, memory after each micro-batch, from a stream of (key, seq, tok, text); update mode, RocksDB state store."""
    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).transformWithStateInPandas(TokenBuffer(limit, key), f"`{key}` {kind}, n bigint, memory string", "Update", "None")


class FirstSeen(StatefulProcessor):
    """Each value of a key once, numbered by its first arrival."""

    def __init__(self, key: str, value: str):
        self.key, self.value = key, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "value string", "nth bigint")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        n = self.count.get()[0] if self.count.exists() else 0
        values, places = [], []
        for pdf in rows:
            for v in pdf.sort_values("seq")[self.value]:
                if pd.notna(v) and not self.seen.containsKey((v,)):
                    n += 1
                    self.seen.updateValue((v,), (n,))
                    values.append(v)
                    places.append(n)
        self.count.update((n,))
        if values:
            yield pd.DataFrame({self.key: [key[0]] * len(values), "nth": places, self.value: values})

    def close(self) -> None: ...


def first_seen(stream: DataFrame, key: str, value: str) -> DataFrame:
    """key, nth, value from a stream of (key, seq, value); append mode.  Where order doesn't matter, dropDuplicates does."""
    types = dict(stream.dtypes)
    return stream.groupBy(key).transformWithStateInPandas(FirstSeen(key, value), f"`{key}` {types[key]}, nth bigint, `{value}` string", "Append", "None")


def distinct_values(stream: DataFrame, keys: list[str], time: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of each key; with a time and delay, state older than the watermark is let go."""
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, delay or "1 hour").dropDuplicatesWithinWatermark(keys)


def append_once(stream: DataFrame, path: str, checkpoint: str, id_column: str = "question_id", time: str | None = None, delay: str | None = None):
    """Appends each id once as JSON lines: the state knows the ids of earlier batches, and a batch is written to a folder of its number, so a
    replay overwrites itself.  With a time and delay, ids older than the watermark are forgotten."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number:08d}")

    return distinct_values(stream, [id_column], time, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class Progress(StreamingQueryListener):
    """Tells of every n-th micro-batch: its number and its rows."""

    def __init__(self, every: int = 5, tell: Callable[[str], None] = print):
        self.every, self.tell = every, tell

    def onQueryStarted(self, event) -> None: ...  # noqa: N802  Spark's names

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if event.progress.batchId % self.every == 0:
            self.tell(f"batch {event.progress.batchId}: {event.progress.numInputRows} rows")

    def onQueryIdle(self, event) -> None: ...  # noqa: N802

    def onQueryTerminated(self, event) -> None: ...  # noqa: N802


def latest(updates: DataFrame, key: str, order: str) -> DataFrame:
    """The last update of each key, of a sink that kept them all."""
    return updates.groupBy(key).agg(F.max_by(F.struct(*[c for c in updates.columns if c != key]), order).alias("u")).select(key, "u.*")
