"""Token counts by source, language and tokenizer version, kept by signed deltas.

A batch of changes is summed to one row for each key and written under its name; it counts once Spark's success mark stands
beside it.  A batch that is committed is never written again, and one that was cut off halfway is written anew, so
replaying is harmless.  Totals are the sum of all committed deltas; compaction folds them into one that
names what it holds.

Changes: ``insert`` (+1 document, +n tokens), ``delete`` (-1, -n) and ``revise`` (0, n - old).

Defined cases: null text has 0 tokens; null source or lang is a key of its own; repeated rows each count; keys whose documents and
tokens come to 0 aren't listed; an empty batch commits and adds nothing.  Other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import Scratch, n_words, table, text_or_empty

KEY = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, documents bigint, tokens bigint"

#: Tokenizer versions: words, and ids of op6's encoder over whole texts.
WORDS, BPE = "words-1", "byte_bpe_multi_50k-1"


class Rollup:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, kind: str) -> list[str]:
        """Of committed batches or snapshots."""
        fs, p = self._fs(f"{self.root}/{kind}")
        if not fs.exists(p):
            return []
        found = [x.getPath() for x in fs.listStatus(p)]
        there = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(x.getName() for x in found if fs.exists(there(x, "_SUCCESS")))

    def committed(self) -> list[str]:
        return sorted({*self._names("deltas"), *self._folded()})

    def _folded(self) -> list[str]:
        snapshots = self._names("snapshots")
        if not snapshots:
            return []
        return [r["batch"] for r in self.spark.read.parquet(f"{self.root}/names/{snapshots[-1]}").collect()]

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits changes(kind, source, lang, tokenizer, tokens, old_tokens); False if the batch was there already."""
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch):
            raise ValueError(f"a batch is named by letters, digits and hyphens, not {batch!r}")
        if batch in self.committed():
            return False
        sign = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).otherwise(0)
        tokens = F.when(F.col("kind") == "revise", F.col("tokens") - F.col("old_tokens")).otherwise(sign * F.col("tokens"))
        delta = changes.groupBy(*KEY).agg(F.sum(sign).cast("long").alias("documents"), F.sum(tokens).cast("long").alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.root}/deltas/{batch}")
        return True

    def _live(self) -> list[str]:
        snapshots, folded = self._names("snapshots"), set(self._folded())
        return [f"{self.root}/snapshots/{x}" for x in snapshots[-1:]] + [f"{self.root}/deltas/{x}" for x in self._names("deltas") if x not in folded]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents and tokens."""
        paths = self._live()
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        sums = rows.groupBy(*KEY).agg(F.sum("documents").cast("long").alias("documents"), F.sum("tokens").cast("long").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """One snapshot of all committed batches; the names are written first, the snapshot's success mark commits both."""
        names, last = self.committed(), self._names("snapshots")[-1:]
        name = f"s{int(last[0][1:]) + 1 if last else 0:06d}"
        self.spark.createDataFrame([(x,) for x in names], "batch string").write.mode("overwrite").parquet(f"{self.root}/names/{name}")
        self.totals().write.mode("overwrite").parquet(f"{self.root}/snapshots/{name}")

    def vacuum(self) -> None:
        """Removes the deltas that the last snapshot holds, and the snapshots before it; for when nobody reads totals of before."""
        folded, snapshots = set(self._folded()), self._names("snapshots")
        gone = [f"deltas/{x}" for x in self._names("deltas") if x in folded] + [f"{kind}/{x}" for x in snapshots[:-1] for kind in ("snapshots", "names")]
        for path in gone:
            fs, p = self._fs(f"{self.root}/{path}")
            fs.delete(p, True)


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents, by words and by the ids of op6's encoder.

    All documents come in, their ids estimated from their bytes; exact copies go and come back; the estimates are
    revised to the numbers of ids; the first batch is replayed.
    """
    scratch = Scratch(spark, "op8")
    text = text_or_empty("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.sha2(text.cast("binary"), 256).alias("digest"),
        n_words(text).alias("words"), F.ceil(F.octet_length(text) / 4).cast("long").alias("guess"), text.alias("text")
    )
    counted, ids = bpe.id_counts(docs, *bpe.default_ranks())
    counted = scratch.cut(counted, "counted")
    first = scratch.cut(counted.groupBy("digest").agg(F.min("doc_id").alias("first")), "first")
    one = lambda name, n, old: F.struct(F.lit(name).alias("tokenizer"), F.col(n).alias("n"), F.col(old).alias("old"))
    both = F.array(one(WORDS, "words", "words"), one(BPE, ids, "guess"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy")
    held = scratch.cut(counted.join(first, "digest").select("lang", "source", copy, both.alias("t")), "held")
    each = held.select("lang", "source", "copy", F.explode("t").alias("x")).select("lang", "source", "copy", "x.tokenizer", "x.n", "x.old")
    change = lambda rows, kind, n: rows.select(F.lit(kind).alias("kind"), "source", "lang", "tokenizer", F.col(n).alias("tokens"), F.col("old").alias("old_tokens"))
    rollup = Rollup(spark, f"{scratch.root}/rollup")
    rollup.apply("ingest", change(each, "insert", "old"))
    rollup.apply("copies-out", change(each.where("copy"), "delete", "old"))
    rollup.apply("copies-back", change(each.where("copy"), "insert", "old"))
    rollup.apply("count-ids", change(each.where(F.col("tokenizer") == BPE), "revise", "n"))
    rollup.apply("ingest", change(each, "insert", "old"))
    rollup.compact()
    return rollup.totals()
