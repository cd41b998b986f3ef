"""Nearest neighbours by randomly rotated one-bit codes with error bounds (after RaBitQ, Gao and Long, 2024).

A vector o near centroid c is r = o - c; its code is the signs of the rotated r, and two numbers go with it: |r| and
s, the inner product of r / |r| and its code's unit vector.  For a query q, <q, o> is estimated as <q, c> + |r| / s * <q, code>, off
by at most EPSILON * |r| * |q| * sqrt((1 - s^2) / (s^2 * (d - 1))) but for about one vector in a thousand, on one side.  <q, code> is looked up
by the bytes of the packed code, which is never unpacked.  In each block of vectors the FIRST * k best estimates are ranked by original vectors; their k-th
score is a floor, and only vectors whose upper bound reaches it are ranked as well.

The centroids come from at most SAMPLE vectors (those of smallest hash); every vector is indexed.  Queries and
vectors are dealt in blocks, each pair of blocks is one row of a join, and each query brings at most k rows out of a
block, merged by rank.  No row count is capped: a block's size only sets how many there are.

Defined cases: vectors null, empty, all zero, or with null or non-finite components take no part, nor do null ids; vectors of
other lengths than the query's aren't its candidates; repeated rows (same id and vector) count once; a
candidate with the query's id is its own row; ties go to the smaller id; with fewer candidates than k all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

NEAREST, EVERY = 20, 20
EPSILON = 3.0
FIRST = 4
SAMPLE, CENTROIDS = 4096, 16
VECTORS_A_BLOCK, QUERIES_A_BLOCK = 8192, 512
#: Copies of the index that are dealt out, so that one block of vectors is searched by several tasks.
COPIES = 8


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, k: int = CENTROIDS, rounds: int = 10) -> np.ndarray:
    """Lloyd's rounds from the first k rows of the sample."""
    c = sample[:k].copy()
    for _ in range(rounds):
        own = nearest(sample, c)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = sample[own == j].mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


def encode(x: np.ndarray, c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, centroid, |r| and s of each vector."""
    own = nearest(x, c)
    turned = (x - c[own]) @ p
    length = np.linalg.norm(turned, axis=1)
    bits = turned > 0
    s = np.abs(turned).sum(axis=1) / (np.maximum(length, 1e-300) * np.sqrt(x.shape[1]))
    return np.packbits(bits, axis=1), own, length, np.where(length > 0, s, 1.0)


def looked_up(turned: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Inner product of each turned query and the signs of each packed code, added up by the code's bytes."""
    padded = np.zeros((len(turned), 8 * bits.shape[1]), np.float32)
    padded[:, : turned.shape[1]] = turned
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1
    out = np.zeros((len(bits), len(turned)), np.float32)
    for j in range(bits.shape[1]):
        out += (signs @ padded[:, 8 * j : 8 * j + 8].T)[bits[:, j]]
    return out.T


def bounds(q: np.ndarray, c: np.ndarray, p: np.ndarray, bits: np.ndarray, own: np.ndarray, length: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the inner product of each query and each coded vector."""
    d = q.shape[1]
    with_code = looked_up((q @ p).astype(np.float32), bits) / np.sqrt(d)
    middle = (q @ c.T)[:, own] + with_code * (length / s)
    size = np.linalg.norm(q, axis=1)[:, None]
    # the least s of d signs is 1 / sqrt(d); the last term is for rounding to single precision
    slack = size * length * (EPSILON * np.sqrt(np.maximum(1 - s * s, 0) / (s * s * max(d - 1, 1))) + 1e-5)
    return middle - slack, middle + slack


def exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, in double precision."""
    out = np.zeros(len(v))
    for j in range(len(q)):
        out += v[:, j] * q[j]
    return out


def _search(c: np.ndarray, p: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(p)
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q"]).reshape(-1, d)
                ids, v = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["v"]).reshape(-1, d)
                bits = np.frombuffer(row["bits"], np.uint8).reshape(len(ids), -1)
                own, length, s = np.frombuffer(row["own"], np.int64), np.frombuffer(row["length"]), np.frombuffer(row["s"])
                out_q, out_v, out_s = [], [], []
                for at in range(0, len(q), 128):
                    low, high = bounds(q[at : at + 128], c, p, bits, own, length, s)
                    for j, one in enumerate(q[at : at + 128]):
                        other = ids != q_ids[at + j]
                        floor, m = -np.inf, FIRST * k
                        if len(ids) > m:
                            first = np.argpartition(np.where(other, low[j] + high[j], -np.inf), -m)[-m:]
                            first = first[other[first]]
                            if len(first) >= k:
                                floor = np.partition(v[first] @ one, -k)[-k]
                                floor -= 1e-9 * (abs(floor) + 1)
                        chosen = np.flatnonzero(other & (high[j] >= floor))
                        if len(chosen) > k:
                            about = v[chosen] @ one
                            least = np.partition(about, -k)[-k]
                            chosen = chosen[about >= least - 1e-9 * (abs(least) + 1)]
                        score = exact(v[chosen], one)
                        best = np.lexsort((ids[chosen], -score))[:k]
                        out_q.append(np.full(len(best), q_ids[at + j]))
                        out_v.append(ids[chosen][best])
                        out_s.append(score[best])
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], ["query_id", "vec_id", "score"])

    return run


def _indexed(c: np.ndarray, p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, v = np.array([x["vec_id"] for x in row["rows"]], np.int64), np.array([x["e"] for x in row["rows"]], float)
                cols = {"block": row["block"], "ids": ids.tobytes(), "v": v.tobytes()}
                cols |= dict(zip(("bits", "own", "length", "s"), (np.ascontiguousarray(a).tobytes() for a in encode(v, c, p)), strict=True))
                yield pa.RecordBatch.from_pylist([cols], pa.schema([("block", pa.int32()), *[(c, pa.binary()) for c in cols if c != "block"]]))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, v = np.array([x["vec_id"] for x in row["rows"]], np.int64), np.array([x["e"] for x in row["rows"]], float)
            yield pa.RecordBatch.from_pylist([{"g": row["block"] % COPIES, "q_ids": ids.tobytes(), "q": v.tobytes()}], pa.schema([("g", pa.int32()), ("q_ids", pa.binary()), ("q", pa.binary())]))


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, e) of sound vectors, once each; e in double precision."""
    rows = vectors.where("vec_id is not null and embedding is not null")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(sound & F.exists("e", lambda x: x != 0)).dropDuplicates(["vec_id", "e"])


def search(vectors: DataFrame, scratch: Scratch, k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by every."""
    rows = scratch.cut(taking_part(vectors), "vectors")
    answer = None
    for d, n, n_q in rows.groupBy(F.size("e")).agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).collect():  # a row for each length
        own = rows.where(F.size("e") == d)
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # at most SAMPLE rows
        c, p = centroids(np.array([r["e"] for r in sample])), rotation(d)
        blocks, q_blocks = -(-n // VECTORS_A_BLOCK), max(1, -(-n_q // QUERIES_A_BLOCK))
        dealt = lambda df, m: df.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int").alias("block")).agg(F.collect_list(F.struct("vec_id", "e")).alias("rows"))
        index = dealt(own, blocks).mapInArrow(_indexed(c, p), "block int, ids binary, v binary, bits binary, own binary, length binary, s binary")
        index = scratch.cut(index, "index")
        asked = dealt(own.where(F.col("vec_id") % every == 0), q_blocks).mapInArrow(_packed, "g int, q_ids binary, q binary")
        asked = scratch.cut(asked, "queries").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        copies = index.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(min(q_blocks, COPIES) - 1))))
        pairs = asked.join(copies, ["block", "g"]).drop("block", "g")
        found = pairs.mapInArrow(_search(c, p, k), "query_id bigint, vec_id bigint, score double")
        answer = found if answer is None else answer.union(found)
    if answer is None:
        answer = scratch.spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return answer.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Scratch(spark, "op10"))


ORACLE = """
WITH v AS (
    SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
    FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
