"""Passages that also stand in an earlier document: depth-limited most-significant-digit passes over suffixes.

Every 50-byte window of every text is a suffix cut at depth 50.  What decides is its own prefix: big-endian digits of
eight bytes, three of them in a first pass and the rest in a second.  After each pass the suffixes that only
one document holds leave; groups that are equal to the end are exactly the repeated windows.

Most suffixes are settled before that, by two passes over stretches of neighbouring ones, so that a row stands for many:

1. a window's anchor is the place of its least gram of 20 bytes (the least in 32 bits of hash, the leftmost of equals), a run is the
   windows of one anchor, 16 in the mean.  Equal windows have equal grams at their anchors, so runs whose gram one document alone
   holds leave.  A run that stands whole in an earlier document is done;
2. runs that are still open are cut in blocks of up to 8 windows by their distance to the anchor.  Equal windows lie in equal
   blocks and share the 43 bytes that all windows of such a block have; so blocks whose 43 bytes one document alone holds
   leave, and a block that stands whole in an earlier document is done.

Only windows of blocks that are open after this are ordered one by one.  (Ordering all suffixes alone by their first digits would
move 32 bytes for each byte of text; README has the figures.)  Stretches are compared by two hashes of 64 bits, windows by all their bytes.

Groups are never gathered: each pass takes the smallest and largest doc_id of a digit by partial aggregation and joins
them back by two plain shuffles, which adaptive execution splits where a digit is hot.

Defined cases: null text counts as empty; texts under 50 bytes keep all; rows that repeat a doc_id are never earlier
than each other, each has its own result; a null doc_id is neither earlier nor later, its text stays whole.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_runs, table, text_or_empty

LEAST = 50
GRAM = 20
BLOCK = 8
SHARED = LEAST - BLOCK + 1  # bytes that all windows of a block have
CHUNK = 1 << 16  # numpy steps over texts of so many bytes stay in a core's cache

_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_29, _32 = np.uint64(29), np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
_ODD, _ODD_2, _15 = np.uint32(0x9E3779B9), np.uint32(0x85EBCA6B), np.uint32(15)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _P
    h ^= h >> _29
    h += b
    h *= _M
    h ^= h >> _32
    return h


class Texts:
    """Some texts laid end to end, and their windows."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.at = np.cumsum([0, *self.sizes])
        self.joined = np.frombuffer(b"".join(texts), np.uint8)

    def longs(self, start: np.ndarray, kind: str = "<u8") -> np.ndarray:
        """The eight bytes from each start."""
        each = np.ndarray((max(len(self.joined) - 7, 0),), kind, self.joined, strides=(1,))
        return each[start].astype(kind[1:])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each run: its text's number, its first window's start, how far the anchor is from there, its windows less one, its gram's hash."""
        n = len(self.joined) - LEAST + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none, none, none.view(np.uint64)
        of_4 = np.ndarray((len(self.joined) - 3,), "<u4", self.joined, strides=(1,)) * _ODD
        of_4 ^= of_4 >> _15
        of_8 = of_4[:-4] * _ODD + of_4[4:]
        of_16 = of_8[:-8] * _ODD_2 + of_8[8:]
        gram = of_16[: len(of_4) - 16] * _ODD + of_4[16:]
        gram ^= gram >> _15
        gram *= _ODD_2
        low, span, wanted = gram.astype(np.uint64) << _32 | np.arange(len(gram), dtype=np.uint64), 1, LEAST - GRAM + 1
        while 2 * span <= wanted:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[:n], low[wanted - span : n + wanted - span])
        # windows of one anchor are neighbours; those that reach over a text's end are runs of their own, and left out
        new = np.ones(n + 1, bool)
        np.not_equal(low[1:], low[:-1], out=new[1:n])
        ends = np.maximum(self.at[1:] - LEAST + 1, self.at[:-1])
        new[self.at[:-1][self.at[:-1] < n]] = new[ends[ends < n]] = True
        first = np.flatnonzero(new)
        start, more = first[:-1], np.diff(first) - 1
        text = np.searchsorted(self.at, start, "right") - 1
        good = start < ends[text]
        text, start, more = text[good], start[good], more[good]
        anchor = (low[start] & _LOW).astype(np.int64)
        digit = _join(_join(self.longs(anchor), self.longs(anchor + 8)), self.longs(anchor + GRAM - 8))
        return text, start, anchor - start, more, digit

    def content(self, start: np.ndarray, more: np.ndarray) -> np.ndarray:
        """A hash of all bytes of a stretch of at most 32 windows, and of their number."""
        h = more.astype(np.uint64)
        for k in (*range(0, LEAST - 8, 8), LEAST - 8):
            h = _join(h, self.longs(start + k))
        for k in (8, 16, 24, 32):
            h = _join(h, self.longs(start + more + LEAST - k))
        return h


def _pack(start: np.ndarray, far: np.ndarray | int, more: np.ndarray | int) -> pa.Array:
    return pa.array((start << 16) | (far << 8) | more)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 16, (at >> 8) & 255, at & 255


def _ints(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


#: From some texts and stretches of their windows (text, start, anchor's distance, windows less one) to columns and each row's text.
Rows = Callable[[Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[dict[str, pa.Array], np.ndarray]]


def _stretch_rows(t: Texts, text: np.ndarray, start: np.ndarray, far: np.ndarray, more: np.ndarray):
    return {"content": _ints(t.content(start, more)), "at": _pack(start - t.at[text], far, more)}, text


def _block_rows(t: Texts, text: np.ndarray, start: np.ndarray, far: np.ndarray, more: np.ndarray):
    anchor, near = start + far, far - more
    n = far // BLOCK - near // BLOCK + 1
    run = np.repeat(np.arange(len(start)), n)
    block = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + (near // BLOCK)[run]
    lo, hi = np.maximum(near[run], BLOCK * block), np.minimum(far[run], BLOCK * block + BLOCK - 1)
    common, digit = anchor[run] - BLOCK * block, block.astype(np.uint64)
    for k in (*range(0, SHARED - 8, 8), SHARED - 8):
        digit = _join(digit, t.longs(common + k))
    cols, text = _stretch_rows(t, text[run], anchor[run] - hi, hi, hi - lo)
    return cols | {"digit": _ints(digit)}, text


FIRST, REST = ["d0", "d1", "d2"], ["d3", "d4", "d5", "d6"]


def _suffix_rows(t: Texts, text: np.ndarray, start: np.ndarray, far: np.ndarray, more: np.ndarray):
    """A row for each window: its big-endian digits of eight bytes, the last of two."""
    n = more + 1
    of = np.repeat(np.arange(len(start)), n)
    at = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    text = text[of]
    cols = {f"d{k}": _ints(t.longs(at + 8 * k, ">u8")) for k in range(LEAST // 8)}
    cols["d6"] = pa.array(t.joined[at + 48].astype(np.int64) * 256 + t.joined[at + 49])
    return cols | {"at": _pack(at - t.at[text], 0, 0)}, text


def _mapped(texts: DataFrame, keys: list[str], rows: Rows | None, names: list[str], given: bool = True) -> DataFrame:
    """texts(keys, text, [ats]) to rows(names, keys): of the stretches that are given, or else of all runs."""
    kinds = {c: texts.schema[c].dataType.simpleString() for c in keys}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, items in byte_runs(batch.column("text"), CHUNK):
                t = Texts(items)
                if given:
                    ats = batch.column("ats").slice(lo, hi - lo)
                    text = np.repeat(np.arange(hi - lo), np.diff(ats.offsets.to_numpy()))
                    start, far, more = _unpack(ats.flatten().to_numpy())
                    start = start + t.at[text]
                else:
                    text, start, far, more, gram = t.runs()
                for k in range(0, len(text), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    cols, of = ({}, text[part]) if rows is None else rows(t, text[part], start[part], far[part], more[part])
                    if not given:
                        cols["digit"] = _ints(gram[part])
                    own = pa.array(lo + of)
                    yield pa.RecordBatch.from_pydict({c: cols[c] for c in names} | {c: batch.column(c).take(own) for c in keys})

    read = ["text", "ats"] if given else ["text"]
    return texts.select(*keys, *read).mapInArrow(run, ", ".join([*(f"{c} bigint" for c in names), *(f"{c} {k}" for c, k in kinds.items())]))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, [at] or null) to what is left of each text."""
    for batch in batches:
        ids, gone = batch.column(0), batch.column(2)
        for lo, hi, items in byte_runs(batch.column(1)):
            kept, removed, spans = [], [], []
            for t, at in zip(items, gone.slice(lo, hi - lo), strict=True):
                if not at.is_valid:
                    kept.append(t)
                    removed.append(0)
                    spans.append(0)
                    continue
                start, _, more = _unpack(at.values.to_numpy())
                edge = np.bincount(start, minlength=len(t) + 1) - np.bincount(start + more + LEAST, minlength=len(t) + 1)
                stays = np.cumsum(edge)[:-1] == 0
                kept.append(np.frombuffer(t, np.uint8)[stays].tobytes())
                removed.append(len(t) - len(kept[-1]))
                spans.append(int(np.count_nonzero(np.diff(np.append(True, stays).astype(np.int8)) == -1)))
            sizes = [len(t) for t in items]
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids.slice(lo, hi - lo), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary()),
            })


def _held_by_several(rows: DataFrame, digits: list[str]) -> DataFrame:
    """(digits, lo): the smallest doc_id of each group that more than one document holds."""
    return rows.groupBy(*digits).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi")


def _sifted(light: DataFrame, rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(what stands whole in an earlier document, what stays open) of rows(digit, content, keys, at); light has their digits and doc_ids."""
    several = scratch.cut(_held_by_several(light, ["digit"]), f"{name}-digits")
    held = scratch.cut(rows.join(several, "digit").select("digit", "lo", "content", *keys, "at"), name)
    scratch.drop(several)
    equal = scratch.cut(_held_by_several(held, ["digit", "content"]).withColumnRenamed("lo", "first"), f"{name}-equal")
    done = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    judged = held.join(equal, ["digit", "content"], "left").select("digit", *keys, "at", (F.col("doc_id") > F.col("lo")).alias("later"), done.alias("done"))
    judged = scratch.cut(judged, f"{name}-judged")
    scratch.drop(held, equal)
    # digits with a later stretch that isn't done: all their stretches that are no copies of earlier ones stay, those of the first holders too
    wanted = scratch.cut(judged.where("later and not done").select("digit").distinct(), f"{name}-wanted")
    return judged.where("done").select(*keys, "at"), judged.where("not done").join(wanted, "digit").select(*keys, "at")


def _with_stretches(texts: DataFrame, stretches: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """(keys, text, ats) of texts; a text's stretches are no more than its bytes."""
    return texts.select(*keys, "text").join(stretches.groupBy(*keys).agg(F.collect_list("at").alias("ats")), keys, how)


def without_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of docs; kept are the bytes that stay."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts, keys = docs.select("doc_id", text_or_empty("text").alias("text")), ["doc_id"]
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        # rows that repeat a doc_id are told apart by 128 bits of their texts
        texts, keys = texts.withColumn("own", F.unhex(F.md5(F.col("text").cast("binary")))), ["doc_id", "own"]
    long = texts.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LEAST))

    stretch = ["digit", "content", "at"]
    light = _mapped(long, ["doc_id"], None, ["digit"], given=False)
    done, open_runs = _sifted(light, _mapped(long, keys, _stretch_rows, stretch, given=False), keys, scratch, "runs")
    held = scratch.cut(_with_stretches(long, open_runs, keys), "open-texts")

    blocks = scratch.cut(_mapped(held, keys, _block_rows, stretch), "blocks")
    done_blocks, open_blocks = _sifted(blocks, blocks, keys, scratch, "blocks")
    last = scratch.cut(_with_stretches(held, open_blocks, keys), "last-texts")
    scratch.drop(held, blocks)

    prefixes = scratch.cut(_held_by_several(_mapped(last, ["doc_id"], _suffix_rows, FIRST), FIRST).select(*FIRST, F.monotonically_increasing_id().alias("prefix")), "prefixes")
    suffixes = _mapped(last, keys, _suffix_rows, [*FIRST, *REST, "at"]).join(prefixes, FIRST).select("prefix", *REST, *keys, "at")
    suffixes = scratch.cut(suffixes, "suffixes")
    scratch.drop(last, prefixes)
    equal = scratch.cut(_held_by_several(suffixes, ["prefix", *REST]), "equal")
    found = suffixes.join(equal, ["prefix", *REST]).where("doc_id > lo").select(*keys, "at")

    gone = scratch.cut(done.union(done_blocks).union(found), "gone")
    out = _with_stretches(texts, gone, keys, "left").select("doc_id", "text", "ats")
    return out.mapInArrow(_cut_out, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op9"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (
    SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
    SELECT doc_id, k, array_slice(b, k, k + 49) AS g FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS k FROM d WHERE n >= 50)
), f AS (
    SELECT g, min(doc_id) AS m FROM w GROUP BY g
), x AS (
    SELECT w.doc_id, k FROM w JOIN f ON w.g = f.g WHERE w.doc_id > m
), i AS (
    SELECT doc_id, k, sum(CASE WHEN k <= p + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS span
    FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM x)
), s AS (
    SELECT doc_id, span, min(k) AS lo, max(k) + 50 AS hi FROM i GROUP BY ALL
), q AS (
    SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 1) AS since FROM s
), t AS (
    SELECT q.doc_id, count(*) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_removed, max(hi) AS last,
           string_agg(CASE WHEN lo > since THEN hex(array_slice(b, since, lo - 1)) ELSE '' END, '' ORDER BY lo) AS kept
    FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY q.doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN t.doc_id IS NULL THEN b WHEN last > n THEN unhex(kept) ELSE unhex(kept || hex(array_slice(b, last, n))) END) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
