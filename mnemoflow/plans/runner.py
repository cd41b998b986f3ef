"""The resumable evaluation job: slice, leave out what is done, remember, answer, record, append, sum up."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import Completer, Extractive
from ..operators import metrics
from ..sources import tables
from .agents import STRATEGIES, Strategy, answered


def results(instances: DataFrame, strategy: Strategy, factory: Callable[[], Completer] = Extractive, attempts: int = 1, parallel: int | None = None, count: Callable[[str], int] | None = None) -> DataFrame:
    """A result record for each instance; failed calls have an error and a traceback."""
    questions = instances.select("question_id", "question")
    return metrics.records(answered(strategy(tables.turns(instances), questions), factory, attempts, parallel=parallel, count=count))


def evaluate(
    spark: SparkSession,
    dataset: str,
    output: str,
    strategy: str | Strategy = "summary",
    factory: Callable[[], Completer] = Extractive,
    first: int = 0,
    count: int | None = None,
    parallel: int | None = None,
    retry_errors: bool = False,
    lines: bool = False,
    attempts: int = 8,
    count_tokens: Callable[[str], int] | None = None,
) -> DataFrame:
    """Runs the instances at positions first and on that have no result yet, appends theirs, and returns the run's summary.

    first == 0 starts the output anew.  parallel bounds how many tasks ask the model at once,
    a call at a time each.  Results are written before they
    are summed, so no call is made twice.
    """
    began = time.time()
    todo = tables.instances(spark, dataset, lines, first, count)
    if first:
        todo = tables.remaining(todo, tables.completed_ids(spark, output, retry_errors))
    plan = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    batch = results(todo, plan, factory, attempts, parallel, count_tokens)
    own = batch.withColumn("run", F.lit(int(began * 1000)))
    tables.write_results(own, output, append=first > 0)
    done = spark.read.schema(tables.RESULT + ", run bigint").json(output).where(F.col("run") == int(began * 1000))
    if metrics.consistent(done).limit(1).count():
        warnings.warn("overall input tokens are not memory's and query's together", stacklevel=2)
    out = metrics.summary(done, time.time() - began)
    tables.write_summary(out, output.rstrip("/").rpartition("/")[0] or ".")
    return out
