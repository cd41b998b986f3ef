"""From raw documents to a tokenised training mix, one operator after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.llm import bpe, minhash, mixing, private, quality
from mnemoflow.llm.common import Scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_first(docs, Scratch(spark, "pipeline-near"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and disclosing terms generalised."""
    return private.redact(docs, Scratch(spark, "pipeline-private"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the curriculum takes a document, in order."""
    return mixing.mix(docs, Scratch(spark, "pipeline-mix"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row's text, with its position in the training order, id, source and language."""
    own = mixing.positions(docs.select("doc_id", "source", "lang", "text"))
    out, ids, decoded = bpe.encode_decode(own, *bpe.default_ranks())
    return out.select("position", "doc_id", "source", "lang", F.size(ids).cast("long").alias("n_tokens"), F.col(ids).alias("token_ids"), F.sha2(decoded, 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mix", mix),
    ("encode", encode),
]

#: SQL can't express trained trees; tests/llm checks run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
