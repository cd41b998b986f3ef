"""Result records and the summary of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cost

PARTS = ("input_tokens", "output_tokens", "cost", "time")


def records(df: DataFrame) -> DataFrame:
    """The result columns from question_id, hypothesis, and memory_ and query_ tokens and times.

    error: the hypothesis where it is one, or else the failure (and its traceback) of a call that was answered by the apology.
    """
    absent = [F.lit(None).cast("string").alias(c) for c in ("failure", "failure_trace") if c not in df.columns]
    df = df.select("*", *absent)
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind)
    df = df.select("question_id", "hypothesis", "failure", "failure_trace", *[zero(f"{side}_{p}", "double" if p == "time" else "bigint").alias(f"{side}_{p}") for side in ("memory", "query") for p in ("input_tokens", "output_tokens", "time")])
    for side in ("memory", "query"):
        df = df.withColumn(f"{side}_cost", cost.cost(F.col(f"{side}_input_tokens"), F.col(f"{side}_output_tokens")))
    for p in PARTS:
        df = df.withColumn(f"question_{p}", F.col(f"memory_{p}") + F.col(f"query_{p}"))
    error = F.when(F.startswith("hypothesis", F.lit("Error:")), F.col("hypothesis")).otherwise(F.col("failure"))
    return df.select("question_id", "hypothesis", *[f"{side}_{p}" for side in ("memory", "query", "question") for p in PARTS], error.alias("error"), F.col("failure_trace").alias("traceback"))


def per_owner(df: DataFrame, keys: list[str], seq: str, last_only: bool = False) -> DataFrame:
    """Sums of input_tokens and output_tokens over an owner's calls, or its last call's."""
    how = (lambda c: F.max_by(c, seq)) if last_only else F.sum
    return df.groupBy(*keys).agg(*[how(c).alias(c) for c in ("input_tokens", "output_tokens")])


def summary(results: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row of totals and means over all rows, failed ones too; means of no rows are null."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    s = results.agg(
        *[F.coalesce(total(f"{side}_{p}"), F.lit(0)).alias(f"{side}_{p}") for side in ("memory", "query", "question") for p in ("input_tokens", "output_tokens", "cost")],
        F.count("*").alias("n"),
    )
    mean = lambda c: F.try_divide(F.col(c), F.col("n"))
    out = s.select(
        F.col("memory_input_tokens").alias("memory_loading_prompt_tokens"), F.col("memory_output_tokens").alias("memory_loading_completion_tokens"), F.col("memory_cost").alias("memory_loading_cost"),
        F.col("query_input_tokens").alias("query_prompt_tokens"), F.col("query_output_tokens").alias("query_completion_tokens"), "query_cost",
        F.col("question_input_tokens").alias("total_prompt_tokens"), F.col("question_output_tokens").alias("total_completion_tokens"),
        (F.col("question_input_tokens") + F.col("question_output_tokens")).alias("total_tokens"), F.col("question_cost").alias("total_cost"),
        mean("question_input_tokens").alias("average_prompt_tokens_per_question"), mean("question_output_tokens").alias("average_completion_tokens_per_question"), mean("question_cost").alias("average_total_cost_per_question"),
    )
    return out if seconds is None else out.withColumn("total_evaluation_time_seconds", F.lit(float(seconds)))


def consistent(results: DataFrame) -> DataFrame:
    """The rows whose overall input tokens are not memory's and query's together; none should be."""
    return results.where(F.col("question_input_tokens") != F.col("memory_input_tokens") + F.col("query_input_tokens"))
