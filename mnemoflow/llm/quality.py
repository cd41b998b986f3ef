"""Quality by boosted trees over document statistics: rules with monotonic constraints, and a classifier.

Both learn from ``labels(doc_id, quality)``.  The learning sample is bounded (``max_rows`` labelled rows, those of
smallest xxhash64(doc_id), a documented parameter); scoring covers every row and every whole text.

Defined cases: null text counts as empty; an empty text has zeros in every statistic (rules: base_failed;
classifier: scored like any other); repeated rows get equal results; label rows with null id or label are
ignored; conflicting labels of one id: the smallest counts, and of several texts that of smallest hash; an empty table gives an empty result; no labels:
the rules keep what the base keeps, the classifier scores 0.5; one class only: its share.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boost, stats
from .common import as_bytes, crc_mod, fresh, runs_by_bytes, table

MAX_TRAINING_ROWS = 20_000
KEEP_AT = 0.5
PREDICT_AT = 0.7
MIN_WORDS = 50

#: The rules' direction: more of it may only lower the verdict.
FALLING = ("symbol_share", "symbol_words", "upper_share", "exclaim_share", "dup_line_share", "repeat_share", "same_next_share", "top_word_share", "pipe_share")


def _chunks(texts: pa.Array):
    items = as_bytes(texts)
    for lo, hi in runs_by_bytes(items):
        yield stats.describe_all(items[lo:hi])


def sample_features(docs: DataFrame, labels: DataFrame, max_rows: int, wanted: Callable[[Column], Column] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most max_rows labelled documents, on the driver."""
    rows = labels.where("doc_id is not null and quality is not null")
    if wanted is not None:
        rows = rows.where(wanted(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # at most max_rows pairs of numbers: the bound makes the broadcast safe at any size
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    @F.arrow_udf("array<double>")
    def feats(texts: pa.Array) -> pa.Array:
        return pa.array([f.tolist() for _, part in _chunks(texts) for f in part], pa.list_(pa.float64()))

    own = docs.select(F.col("doc_id"), F.col("text"))
    got = own.join(F.broadcast(rows), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("h"), feats("text").alias("f"))
    # of texts that share a doc_id, the one of smallest hash, so that reruns learn the same
    got = got.groupBy("doc_id").agg(F.min(F.struct("h", "quality", "f")).alias("r")).select("doc_id", "r.quality", "r.f")
    pdf = got.toPandas().sort_values("doc_id")
    if not len(pdf):
        return np.zeros((0, len(stats.FEATURES))), np.zeros(0)
    return np.array(pdf["f"].tolist(), float), (pdf["quality"].to_numpy() > 0).astype(float)


def fit_rules(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> boost.Trees | None:
    x, y = sample_features(docs, labels, max_rows)
    falling = {stats.FEATURES.index(f): -1 for f in FALLING}
    return boost.fit(x, y, monotone=falling) if len(y) else None


def fit_classifier(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> boost.Trees:
    x, y = sample_features(docs, labels, max_rows, lambda c: crc_mod(c, 4) != 2)
    return boost.fit(x, y, trees=120, depth=5, rate=0.1)


RULES_TYPE = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,score:double,kept:boolean>"


def rules_udf(model: boost.Trees | None, keep_at: float = KEEP_AT):
    """Column function from texts to the base counts, the base verdict, the trees' score and the final verdict."""

    def judge(texts: pa.Array) -> pa.Array:
        counts, scores = [], []
        for c, f in _chunks(texts):
            counts.append(c)
            scores.append(model.score(f) if model is not None else np.ones(len(c)))
        c = np.concatenate(counts) if counts else np.zeros((0, len(stats.COUNTS)), np.int64)
        score = np.concatenate(scores) if scores else np.zeros(0)
        failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > 50 * c[:, 0])
        cols = [pa.array(c[:, k]) for k in range(c.shape[1])]
        cols += [pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_at))]
        return pa.StructArray.from_arrays(cols, [*stats.COUNTS, "base_failed", "score", "kept"])

    judge.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(judge, RULES_TYPE)


def classifier_udf(model: boost.Trees):
    def judge(texts: pa.Array) -> pa.Array:
        scores = [model.score(f) for _, f in _chunks(texts)]
        return pa.array(np.concatenate(scores) if scores else np.zeros(0))

    judge.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(judge, "double")


def apply_rules(docs: DataFrame, model: boost.Trees | None, keep_at: float = KEEP_AT) -> DataFrame:
    """Every row with its columns and one struct column more (its name is the last of the columns)."""
    return docs.withColumn(fresh(docs, "rules"), rules_udf(model, keep_at)(F.col("text")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the rules keep, with docs' own columns."""
    out = apply_rules(docs, fit_rules(docs, labels))
    return out.where(F.col(out.columns[-1])["kept"]).drop(out.columns[-1])


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_rules(docs, fit_rules(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", f"{out.columns[-1]}.*")


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_classifier(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), classifier_udf(model)(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
