"""Byte-level BPE with a local rank file: encoding of whole texts, and decoding back to bytes.

Long texts are split before encoding, only where a match of the pattern must end: between an ASCII letter or digit
and a space.  No alternative of the pattern goes from one to the other, and none that ends there looks further, so
the pieces' ids, end to end, are the whole text's ids.  A text without such a place is encoded at once.

Defined cases: null text counts as empty (no ids, no bytes); repeated rows get equal results; ties do not arise;
an empty table gives an empty result.  The operator's column names avoid those of its input.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, runs_by_bytes, table

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECE = 1 << 16
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?= )")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of size characters or a little more, cut at safe boundaries only."""
    at = 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encoding(ranks: bytes, pattern: str):
    """A tiktoken encoding without special tokens, from the bytes of a rank file."""
    import tiktoken

    by_bytes = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=by_bytes, special_tokens={})


def encode_decode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> tuple[DataFrame, str, str]:
    """docs without its text, with two columns more: the ids, and the bytes that they decode to; and those columns' names.

    ranks are a rank file's bytes, read by the caller: a vocabulary's size bounds what goes to the executors.
    """
    ids, decoded = fresh(docs, "token_ids"), fresh(docs, "decoded")
    others = [c for c in docs.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, pattern)
        for batch in batches:
            texts = batch.column(len(others))
            sizes = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
            for lo, hi in runs_by_bytes(sizes):
                all_ids, ends, raw = [], [0], []
                for t in texts.slice(lo, hi - lo).to_pylist():
                    parts = [np.array(enc.encode_ordinary(p), np.int32) for p in pieces(t or "")]
                    all_ids += parts
                    ends.append(ends[-1] + sum(map(len, parts)))
                    raw.append(b"".join(enc.decode_bytes(p.tolist()) for p in parts))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *all_ids])))
                cols = [batch.column(k).slice(lo, hi - lo) for k in range(len(others))]
                yield pa.RecordBatch.from_arrays([*cols, lists, pa.array(raw, pa.binary())], [*others, ids, decoded])

    kept = [docs.schema[c] for c in others]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.BinaryType())])
    return docs.select(*others, F.col(text)).mapInArrow(run, schema), ids, decoded


def id_counts(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> tuple[DataFrame, str]:
    """docs without its text, with the number of ids of the whole text; and that column's name."""
    n_ids = fresh(docs, "n_ids")
    others = [c for c in docs.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value, pattern)
        for batch in batches:
            texts = batch.column(len(others))
            counts = [sum(len(enc.encode_ordinary(p)) for p in pieces(t.as_py() or "")) for t in texts]
            cols = [batch.column(k) for k in range(len(others))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], [*others, n_ids])

    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField(n_ids, T.LongType())])
    return docs.select(*others, F.col(text)).mapInArrow(run, schema), n_ids


def default_ranks(name: str = RANKS) -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, ids, decoded = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), *default_ranks())
    joined = F.concat_ws(",", F.col(ids).cast("array<string>"))
    return out.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))
