"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, connected components.

All 128 coordinates of a signature come from two permutations of 32-bit positions: ``_sigma`` scatters the hashed
shingles once, and coordinate k is the minimum of ``_pi`` over the positions shifted circularly by k (Li and Li, 2022).
32 bands of 4 coordinates find candidates: of two documents at similarity 0.75 the chance to share no band is 5e-6.

How hot groups are handled:

* documents with equal shingle sets collapse into one vertex first, and those of a repeated doc_id are joined by edges;
* a band's bucket links its members only to its smallest one, so candidates grow with the members, not their square;
* a second round looks at the buckets which still hold members of different components, in blocks, and there compares members across
  components whose signatures agree in 71 places or more (at similarity 0.75 the chance of fewer is 1e-6), exactly and in
  place.  It gives out a link only where that joins two components.  So none is lost for not being to a bucket's smallest member,
  and no task makes all pairs.

Defined cases: null text counts as empty; without words the set is empty and linked with nothing; rows that repeat a doc_id, with equal or
other texts, are one vertex, and each gets its own set's size and that vertex's component; a null doc_id is linked with nothing, gets
a null component and stays.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, as_bytes, runs_by_bytes, table
from .components import components

COORDINATES, ROWS_PER_BAND = 128, 4
LEAST_EQUAL = 71
SHINGLE, PERCENT = 5, 75
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 1_000_000

_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
_32 = np.uint64(32)


class _Hashes(dict):
    """64-bit hashes of words; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _32)) * _M
    return h ^ (h >> _32)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles, words lower-cased (A to Z)."""
    cache = _Hashes()
    out = []
    for t in texts:
        words = t.lower().split()
        if not words:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.array(list(map(cache.__getitem__, words)), np.uint64)
        width = min(k, len(h))
        s = np.full(len(h) - width + 1, width, np.uint64)
        for j in range(width):
            s = s * _P + h[j : len(h) - width + 1 + j]
        out.append(np.unique(_mix(s)))
    return out


def _sigma(h: np.ndarray) -> np.ndarray:
    """Hashed shingles to positions: the low half of the 64-bit hash, permuted."""
    x = h.astype(np.uint32)
    x ^= x >> np.uint32(17)
    x *= np.uint32(0xED5AD4BB)
    x ^= x >> np.uint32(11)
    x *= np.uint32(0xAC4C1B51)
    x ^= x >> np.uint32(15)
    return x


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES uint32 for each set; none may be empty."""
    where = np.cumsum([0, *map(len, sets)])
    at = _sigma(np.concatenate(sets))
    x, y = np.empty_like(at), np.empty_like(at)
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        np.add(at, np.uint32(k), out=x)  # circular: uint32 wraps around
        np.right_shift(x, 16, out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x7FEB352D), out=x)
        np.right_shift(x, 15, out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x846CA68B), out=x)
        np.right_shift(x, 16, out=y)
        np.bitwise_xor(x, y, out=x)
        out[:, k] = np.minimum.reduceat(x, where[:-1])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), COORDINATES // ROWS_PER_BAND, ROWS_PER_BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]) + np.uint64(1)
    for j in range(ROWS_PER_BAND):
        key = _mix(key * _P + parts[:, :, j])
    return key.view(np.int64)


PREPARED = "struct<n:bigint,d1:bigint,d2:bigint,bands:array<bigint>,sig:binary>"


def _prepare():
    @F.arrow_udf(PREPARED)
    def prepare(texts: pa.Array) -> pa.Array:
        items, rows = as_bytes(texts), []
        for lo, hi in runs_by_bytes(items):
            sets = shingle_sets(items[lo:hi])
            full = [s for s in sets if len(s)]
            sig = signatures(full) if full else np.zeros((0, COORDINATES), np.uint32)
            bands, short = band_keys(sig), sig.astype("<u2")
            k = 0
            for s in sets:
                if not len(s):
                    rows.append({"n": 0})
                    continue
                digest = xxhash.xxh3_128_digest(s.tobytes())
                d1, d2 = (int.from_bytes(x, "little", signed=True) for x in (digest[:8], digest[8:]))
                rows.append({"n": len(s), "d1": d1, "d2": d2, "bands": bands[k], "sig": short[k].tobytes()})
                k += 1
        kind = pa.struct([("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
        return pa.array(rows, kind)

    return prepare


@F.arrow_udf(T.IntegerType())
def _equal_places(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = (np.frombuffer(b"".join(s.to_pylist()), "<u2").reshape(-1, COORDINATES) for s in (a, b))
    return pa.array((x == y).sum(axis=1).astype(np.int32))


@F.arrow_udf(T.BooleanType())
def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    """Exact: whether the full shingle sets reach the similarity."""
    left, right, out, last = as_bytes(a), as_bytes(b), [], (None, None)
    for x, y in zip(left, right, strict=True):
        if x != last[0]:
            last = (x, shingle_sets([x])[0])
        s = shingle_sets([y])[0]
        both = len(np.intersect1d(last[1], s, assume_unique=True))
        out.append(100 * both >= PERCENT * (len(last[1]) + len(s) - both) > 0)
    return pa.array(out, pa.bool_())


def _verified(pairs: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(a, b) that are similar: first by their signatures, then exactly.  sigs says where each one's text is."""
    for end in ("b", "a"):
        pairs = pairs.join(sigs.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("sig", "rep", "key")]), end)
    pairs = pairs.where(_equal_places("sig_a", "sig_b") >= LEAST_EQUAL).drop("sig_a", "sig_b")
    for end in ("b", "a"):
        pairs = pairs.join(texts.select(*[F.col(c).alias(f"{c}_{end}") for c in ("rep", "key", "text")]), [f"rep_{end}", f"key_{end}"])
    return pairs.where(_similar("text_a", "text_b")).select("a", "b")


def _pairs_of(band: int, i: int, j: int, group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(x, its partners) by row number: the pairs of one block pair of a bucket that are still to be compared.

    Left out: equal components, the bucket's smallest member (compared in round one), sizes that can't reach the
    similarity, signatures that agree too seldom, and pairs whose first common band is another one.
    """
    ids, comp, block, low, n = (group.column(c).to_numpy() for c in ("id", "comp", "block", "lo", "n"))
    bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES // ROWS_PER_BAND)
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(-1, COORDINATES)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for x in left:
        if ids[x] == low[x]:
            continue
        y = right[(comp[right] != comp[x]) & (ids[right] != low[x]) & (100 * np.minimum(n[right], n[x]) >= PERCENT * np.maximum(n[right], n[x]))]
        y = y[ids[y] > ids[x]] if i == j else y
        # the bands' whole keys, as the buckets have them: signatures are kept cut to 16 bits
        first = (bands[y] == bands[x]).argmax(axis=1)
        yield x, y[((sig[y] == sig[x]).sum(axis=1) >= LEAST_EQUAL) & (first == band)]


def _open_rows(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """The rows of a block pair that have a partner to be compared with."""
    _, k, i, j = (x.as_py() for x in key)
    wanted = np.zeros(group.num_rows, bool)
    for x, y in _pairs_of(k, i, j, group):
        wanted[y] = True
        wanted[x] |= len(y) > 0
    return group.filter(pa.array(wanted))


def _links(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Links that join components of a block pair, by exact comparison: fewer than its components, never all pairs."""
    _, k, i, j = (x.as_py() for x in key)
    ids, comp = group.column("id").to_numpy(), group.column("comp").to_numpy()
    sets = shingle_sets(as_bytes(group.column("text").combine_chunks()))
    up = {int(c): int(c) for c in comp}

    def root(c: int) -> int:
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    a_out, b_out = [], []
    for x, partners in _pairs_of(k, i, j, group):
        for y in partners:
            p, q = root(int(comp[x])), root(int(comp[y]))
            if p == q:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * both >= PERCENT * (len(sets[x]) + len(sets[y]) - both):
                up[q] = p
                a_out.append(min(ids[x], ids[y]))
                b_out.append(max(ids[x], ids[y]))
    return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})


def near_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    key = F.xxhash64(F.col("text")).alias("key")
    prepared = scratch.cut(docs.select("doc_id", key, _prepare()(F.col("text")).alias("p")).select("doc_id", "key", "p.*"), "prepared")
    # a vertex is a set; its text is that of one row, of the smallest doc_id
    rows = prepared.where("d1 is not null and doc_id is not null")
    sets = rows.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "key")).alias("own"))
    sets = scratch.cut(sets.select("d1", "d2", "own.doc_id", "own.key", F.monotonically_increasing_id().alias("id")).withColumnRenamed("doc_id", "rep"), "sets")
    held = scratch.cut(rows.select("doc_id", "d1", "d2").join(sets.select("d1", "d2", "id"), ["d1", "d2"]).select("doc_id", "id"), "held")
    reps = rows.join(sets, ["d1", "d2", "key"]).where("doc_id = rep").select("id", "rep", "key", "n", "bands", "sig").dropDuplicates(["id"])
    reps = scratch.cut(reps, "reps")
    sizes = scratch.cut(prepared.select("doc_id", "n"), "sizes")
    scratch.drop(prepared, sets)
    texts = docs.select(F.col("doc_id").alias("rep"), key, "text").dropDuplicates(["rep", "key"])
    # a doc_id is one vertex, whatever texts its rows have
    several = held.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a < last")
    same = scratch.cut(held.join(several, "doc_id").where("id > a").select("a", F.col("id").alias("b")).distinct(), "same-id")

    bands = reps.select("id", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    buckets = scratch.cut(buckets.select("band", "lo", "n"), "buckets")
    pairs = bands.join(buckets, "band").where("id > lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct()
    pairs = scratch.cut(pairs, "pairs")
    links = scratch.cut(_verified(pairs, reps, texts).union(same).distinct(), "links")
    scratch.drop(pairs)
    comps = scratch.cut(components(links, scratch), "components")

    own = reps.join(comps, "id", "left").select("id", "n", "bands", F.coalesce("component", "id").alias("comp"))
    placed = own.select("id", "n", "comp", F.posexplode("bands").alias("k", "band"))
    mixed = placed.groupBy("band").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("n"), F.sum("n").alias("size"), F.min("id").alias("lo"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("size") / BLOCK_SHINGLES)).cast("int")
    mixed = scratch.cut(mixed.where("n > 2 and c1 < c2").select("band", "lo", blocks.alias("blocks")), "mixed")
    inside = placed.join(mixed, "band").join(reps.select("id", "sig", "bands"), "id")
    inside = inside.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    inside = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    inside = inside.select("band", "k", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "comp", "lo", "block", "n", "sig", "bands")
    keys = ["band", "k", "i", "j"]
    still = scratch.cut(inside.groupBy(*keys).applyInArrow(_open_rows, inside.schema), "still-open")
    still = still.join(reps.select("id", "rep", "key"), "id").join(texts, ["rep", "key"]).select(*keys, "id", "comp", "lo", "block", "n", "sig", "bands", "text")
    more_links = scratch.cut(still.groupBy(*keys).applyInArrow(_links, "a bigint, b bigint").distinct(), "more-links")
    if more_links.limit(1).count():
        comps = scratch.cut(components(links.union(more_links), scratch), "components")

    ends = held.join(comps, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component"))
    lowest = scratch.cut(ends.groupBy("component").agg(F.min("doc_id").alias("component_id")), "lowest")
    ends = ends.join(lowest, "component").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = sizes.join(scratch.cut(ends, "ends"), "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with one document of each group; repeated rows of the same id and text become one."""
    gone = near_duplicates(docs, scratch).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    return left.dropDuplicates(["doc_id", "text"])


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "op4"))


ORACLE = """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM w WHERE len(w) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
    SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 75 * (na.n + nb.n - n_both)
), e AS (
    SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
    SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a
), m AS (
    SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
