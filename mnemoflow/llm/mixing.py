"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Every source has a target of words, and a weight schedule over training time t from 0 to 1, 1 + slope * (2t - 1).
The integral of the schedule, scaled to the target, is the source's cumulative demand.  A source's documents lie end
to end in hashed order, pass after pass; a document's place there is the demand that it meets, and the demand's
inverse is its time.  Range-sorting by that time gives the order of training.

Places are prefix sums.  A source may hold most of all rows, so they are taken in two levels: within hashed slices
of a source (SLICES of them), and over the slices' sums.  No task holds a source.

Defined cases: null text has size 0; a null source is a source, the last; sources of size 0 have target 0; documents
of size 0 are taken 0 times; repeated rows each have a place of their own; an empty table gives an empty result.  A document whose
middle is beyond the target in some pass isn't taken in it, so a source misses its target by at most half of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, n_words, table, text_or_empty

SLICES = 4096
WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (-0.5, 0.0, 0.5)
SHARE, MOST = 1.5, 2.0


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, slope) from (source, source_size): a row for each source, however many sources.

    Filling by weight up to MOST times each size: in the order of size over weight, a source is full if what is left
    of the total, shared among it and those after it, reaches its limit.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(values))) + 1).cast("int"))
    s = sizes.select("source", "source_size", pick(WEIGHTS).alias("w"), pick(SLOPES).alias("slope"))
    s = s.withColumn("most", F.col("source_size") * F.lit(MOST)).withColumn("ratio", F.col("most") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(SHARE) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("full", F.col("level") >= F.col("ratio"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    return s.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(level * F.col("w")).alias("target"), "slope")


def _time(met: Column, target: Column, slope: Column) -> Column:
    """When a source's demand has reached met: the root of slope * t^2 + (1 - slope) * t = met / target."""
    q, b = met / target, 1 - slope
    return F.when(slope == 0, q).otherwise((F.sqrt(b * b + 4 * slope * q) - b) / (2 * slope))


def plan(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each row of docs: doc_id, row_key, size, source_size, target, taken, times (of each time it is taken)."""
    size = n_words(text_or_empty("text"))
    sized = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "source", "text").alias("row_key"))
    sized = scratch.cut(sized.withColumn("slice", F.pmod("row_key", F.lit(SLICES)).cast("int")), "sizes")
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    ordered = Window.partitionBy("source").orderBy("slice")
    slices = slices.select("source", "slice", (F.sum("n").over(ordered) - F.col("n")).alias("ahead"), F.sum("n").over(Window.partitionBy("source")).alias("source_size"))
    slices = scratch.cut(slices, "slices")
    per_source = scratch.cut(targets(slices.groupBy("source").agg(F.max("source_size").alias("source_size"))), "targets")

    keyed = sized.withColumn("s1", F.coalesce("source", F.lit(""))).withColumn("s2", F.col("source").isNull())
    here = Window.partitionBy("s1", "s2", "slice").orderBy("row_key", "doc_id")
    placed = keyed.withColumn("inside", F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    of = slices.select(F.coalesce("source", F.lit("")).alias("s1"), F.col("source").isNull().alias("s2"), "slice", "ahead")
    to = per_source.select(F.coalesce("source", F.lit("")).alias("s1"), F.col("source").isNull().alias("s2"), "source_size", "target", "slope")
    ahead = of.join(to, ["s1", "s2"])
    placed = placed.join(ahead, ["s1", "s2", "slice"])
    middle = lambda k: F.col("ahead") + F.col("inside") + F.col("size") / 2 + F.lit(k) * F.col("source_size")
    passes = F.array(*[F.when((F.col("size") > 0) & (middle(k) < F.col("target")), _time(middle(k), F.col("target"), F.col("slope"))) for k in range(int(MOST))])
    placed = placed.withColumn("times", F.array_compact(passes))
    return placed.select("doc_id", "row_key", "size", "source_size", "target", (F.col("size") * F.size("times")).alias("taken"), "times")


def mix(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The training order: docs' columns, a row for each time that a document is taken, range-sorted by time.

    Texts move twice, to meet their times and to be sorted; those of rows that are alike in all that the key hashes once more, to be numbered.
    """
    key, rank, time = (fresh(docs, c) for c in ("row_key", "rank_of_key", "time"))
    alike = Window.partitionBy("row_key")
    wanted = plan(docs, scratch).select("row_key", F.row_number().over(alike.orderBy("taken", "times")).alias("r"), F.count("*").over(alike).alias("n"), "times")
    wanted = wanted.select(F.col("row_key").alias(key), F.col("r").alias(rank), "n", F.col("times").alias(time))
    wanted = scratch.cut(wanted.where((F.col("n") > 1) | (F.size(time) > 0)), "wanted")
    own = docs.withColumn(key, F.xxhash64("doc_id", "source", "text"))
    single = own.join(wanted.where("n = 1").drop("n", rank), key)
    repeated = own.join(wanted.where("n > 1").select(key).distinct(), key, "left_semi")
    other = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])  # so that reruns agree
    repeated = repeated.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(other))).join(wanted.where("n > 1").drop("n"), [key, rank]).drop(rank)
    out = single.unionByName(repeated).withColumn(time, F.explode(time))
    return out.repartitionByRange(F.col(time), F.col(key)).sortWithinPartitions(time, key).select(*docs.columns)


def positions(mixed: DataFrame) -> DataFrame:
    """mixed, which must be read from the files that mix wrote, with its rows' positions in the training order, from 0.

    Files are named in the order of the ranges, and rows lie in them in order; only a row for each file is summed up.
    """
    name, row, ahead, position = (fresh(mixed, c) for c in ("file_name", "row_in_file", "rows_ahead", "position"))
    own = mixed.select("*", F.col("_metadata.file_name").alias(name), F.col("_metadata.row_index").alias(row))
    files = own.groupBy(name).agg(F.count("*").alias("n"))
    before = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(name, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(ahead))
    return own.join(F.broadcast(files), name).select(*mixed.columns, (F.col(ahead) + F.col(row)).alias(position))


def mixing_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), Scratch(spark, "op7"))
    out = out.withColumn("first_time", F.try_element_at("times", F.lit(1)))
    out = out.repartitionByRange(F.col("first_time"), F.col("row_key")).sortWithinPartitions("first_time", "row_key")
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_time", "times")


