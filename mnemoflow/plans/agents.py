"""Agents: a memory strategy, what it retrieves for a question, the prompt, and the model's answer.

Each strategy takes turns(question_id, session, turn, role, text) and questions(question_id, question) and gives one row for each question
with its context, the text whose tokens its query counts (null: the prompt), memory tokens and time; ``answered`` turns that into
hypotheses.  All is one plan up to the prompt; only completion is a Python stage.

Questions without turns have an empty context (reductive: null, so the sentinel answer); null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.models import EMPTY, Completer, Embedder, Extractive, Hashed, Statements, completed, counted, embedding
from ..operators import budget, episodes, metrics, prompts, propositions, retrieval, vectors
from ..operators.turns import batches, cleaned, paired

#: What a failed and an empty memory answer.
APOLOGY = "I'm sorry, I'm having trouble processing your request. Please try again."
NO_PROPOSITIONS = "ERROR: NO PROPOSITIONS STORED"
KEY = ["question_id"]

Strategy = Callable[[DataFrame, DataFrame], DataFrame]


def _asked(out: DataFrame, questions: DataFrame, context: Column, query: Column | None = None) -> DataFrame:
    """The columns of a strategy's result; counters that are missing are 0."""
    zero = lambda c, kind: (F.coalesce(F.col(c), F.lit(0)) if c in out.columns else F.lit(0)).cast(kind).alias(c)
    counts = [zero("memory_input_tokens", "long"), zero("memory_output_tokens", "long"), zero("memory_time", "double")]
    return out.select(*questions.columns, context.alias("context"), (F.lit(None).cast("string") if query is None else query).alias("query_text"), *counts)


def summary_memory(turns: DataFrame, questions: DataFrame, limit: int = budget.AGENT_LIMIT) -> DataFrame:
    """The newest turns within the token limit; the query counts question and memory."""
    own = cleaned(turns).withColumns({"tok": X.quarter_tokens("text"), "seq": F.struct("session", "turn")})
    kept = budget.joined(budget.recent(own, KEY, "seq", "tok", limit), KEY, "seq", "text")
    loaded = own.groupBy(*KEY).agg(F.sum("tok").alias("memory_input_tokens"))
    out = questions.join(kept, KEY, "left").join(loaded, KEY, "left")
    context = F.coalesce("memory", F.lit(""))
    return _asked(out, questions, context, F.concat(F.col("question"), context))


def reductive_memory(
    turns: DataFrame, questions: DataFrame, factory: Callable[[], Completer] = Statements, most: int = propositions.MOST, attempts: int = 1, parallel: int | None = None
) -> DataFrame:
    """All statements learnt; null context if there are none."""
    sessions = batches(cleaned(turns), [*KEY, "session"], roles=False)
    known = propositions.learnt(sessions, KEY, "session", "text", factory, most, attempts, parallel)
    rows = F.array_sort(F.collect_list(F.struct("seq", "proposition")))
    got = known.groupBy(*KEY).agg(
        F.array_join(F.transform(rows, lambda r: r["proposition"]), "\n").alias("memory"), F.max("input_tokens").alias("memory_input_tokens"),
        F.max("output_tokens").alias("memory_output_tokens"), F.max("seconds").alias("memory_time"),
    )
    return _asked(questions.join(got, KEY, "left"), questions, F.nullif("memory", F.lit("")))


def episode_calls(turns: DataFrame, factory: Callable[[], Completer], attempts: int = 1, parallel: int | None = None) -> DataFrame:
    """One model call for each session: its history, the model's text, and what the call counts.  Held on disk, so that no call is made twice."""
    calls = batches(cleaned(turns), [*KEY, "session"]).withColumn("prompt", prompts.filled(prompts.EPISODE, history=F.col("text")))
    got = completed(calls, "prompt", factory, attempts, parallel=parallel)
    tokens = {"input_tokens": X.quarter_tokens(F.concat_ws("\n", "text", "prompt")), "output_tokens": X.quarter_tokens("completion")}
    return got.withColumns(tokens).persist()


def _stored(rows: DataFrame) -> DataFrame:
    stamp = F.concat(F.lpad(F.col("session").cast("string"), 10, "0"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 10, "0"))
    return episodes.stored(rows, KEY, ["session", "turn"], stamp)


def episodes_of_calls(calls: DataFrame) -> DataFrame:
    """Stored episodes of episode_calls; a failed call, and one without both summaries, gives none."""
    rows = calls.withColumn("e", episodes.parsed("completion")).select(*KEY, "session", F.lit(0).cast("long").alias("turn"), "e.*")
    return _stored(episodes.usable(rows).withColumnsRenamed({"user_summary": "user_input", "agent_summary": "agent_output"}))


def episodes_of_pairs(turns: DataFrame) -> DataFrame:
    """Stored episodes of the pairs of turns as they are, without a model."""
    rows = paired(cleaned(turns), [*KEY, "session"]).select(
        *KEY, "session", "turn", X.strip("user_text").alias("user_input"), X.strip("assistant_text").alias("agent_output"),
        *[F.lit(None).cast("string").alias(c) for c in ("outcome", "location", "reflection")], F.array().cast("array<string>").alias("categorical_tags"),
    )
    return _stored(rows.where("user_input <> '' and agent_output <> ''"))


def episodic_memory(
    turns: DataFrame, questions: DataFrame, factory: Callable[[], Completer] | None = None, attempts: int = 1, last_only: bool = False, parallel: int | None = None
) -> DataFrame:
    """The best episodes, read back and rendered as history; the query counts what was said in them, and the question.

    Without a factory episodes are the pairs of turns as they are, and their tokens are the memory's; with one they are what the model
    makes of each session, and the memory's tokens are its calls', or (last_only) the last call's.
    """
    if factory is None:
        held = episodes_of_pairs(turns)
        loaded = held.groupBy(*KEY).agg(F.sum(X.quarter_tokens("text")).alias("memory_input_tokens"))
    else:
        calls = episode_calls(turns, factory, attempts, parallel)
        held = episodes_of_calls(calls)
        spent = metrics.per_owner(calls, KEY, "session", last_only).withColumnsRenamed({"input_tokens": "memory_input_tokens", "output_tokens": "memory_output_tokens"})
        loaded = spent.join(calls.groupBy(*KEY).agg(F.sum("completion_seconds").alias("memory_time")), KEY)
    held = held.withColumn("seq", F.struct("session", "turn"))
    got = retrieval.retrieved(questions.select(*KEY, F.col("question_id").alias("query_id"), F.col("question").alias("query")), held, KEY)
    read = episodes.read_back(got.select(F.col("query_id").alias("question_id"), "memory"), KEY, "memory")
    rows = F.array_sort(F.collect_list(F.struct("nth", episodes.history(F.col("fields")).alias("x"), episodes.said(F.col("fields")).alias("y"))))
    listed = lambda c, by: F.array_join(F.transform(rows, lambda r: r[c]), by).alias(c)
    context = read.groupBy(*KEY).agg(listed("x", "\n"), listed("y", " "))
    out = questions.join(context, KEY, "left").join(loaded, KEY, "left")
    empty = F.lit("")
    return _asked(out, questions, F.coalesce("x", empty), F.concat(F.coalesce("y", empty), F.lit(" "), "question"))


def _numbered(turns: DataFrame) -> DataFrame:
    return cleaned(turns).withColumn("seq", F.row_number().over(Window.partitionBy(*KEY).orderBy("session", "turn")).cast("long"))


def tree_memory(turns: DataFrame, questions: DataFrame, factory: Callable[[], Embedder] = Hashed, mode: str = "collapsed", k: int = vectors.TOP) -> DataFrame:
    """The nearest nodes of a tree over the turns; mode collapsed or tree_traversal."""
    own = _numbered(turns)
    nodes = vectors.tree(own.select(*KEY, "seq", "text", embedding(F.col("text"), factory).alias("embedding")), KEY, "seq")
    asked = questions.select(*KEY, F.col("question_id").alias("query_id"), embedding(F.col("question"), factory).alias("q"))
    found = vectors.collapsed(asked, nodes, KEY, k) if mode == "collapsed" else vectors.traversed(asked, nodes, KEY)
    order = "rank" if mode == "collapsed" else "level"
    rows = F.array_sort(F.collect_list(F.struct(order, "node", "text")))
    context = found.groupBy(F.col("query_id").alias("question_id")).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("memory"))
    loaded = own.groupBy(*KEY).agg(F.sum(X.quarter_tokens("text")).alias("memory_input_tokens"))
    return _asked(questions.join(context, KEY, "left").join(loaded, KEY, "left"), questions, F.coalesce("memory", F.lit("")))


def remembered(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """The turns with each question and its answer stored behind the last of its own, as a session of one exchange; apologies aren't stored."""
    last = turns.groupBy(*KEY).agg(F.max("session").alias("last"))
    said = answers.where(F.col("hypothesis").isNotNull() & F.col("failure").isNull()).join(last, KEY, "left")
    both = F.array(*[F.struct(F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.col(c).alias("text")) for n, (role, c) in enumerate((("user", "question"), ("assistant", "hypothesis")))])
    new = said.select(*KEY, (F.coalesce("last", F.lit(-1)) + 1).cast("long").alias("session"), F.inline(both))
    return turns.unionByName(new.select(*turns.columns))


def static_memory(turns: DataFrame, questions: DataFrame, text: str = "") -> DataFrame:
    """The same text for every question."""
    return _asked(questions.withColumn("memory_input_tokens", F.lit(len(text) // 4)), questions, F.lit(text))


def batch_memory(turns: DataFrame, questions: DataFrame, factory: Callable[[], Embedder] = Hashed, k: int = vectors.TOP) -> DataFrame:
    """The sessions nearest to the question, nearest first."""
    own = batches(cleaned(turns), [*KEY, "session"])
    held = own.select(*KEY, "session", "text", embedding(F.col("text"), factory).alias("v"))
    asked = questions.select(*KEY, embedding(F.col("question"), factory).alias("q"))
    near = held.join(asked, KEY).withColumn("near", vectors.cosine("q", "v")).where("near is not null")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("near").desc(), "session"))).where(F.col("rank") <= k)
    context = budget.joined(near, KEY, "rank", "text")
    loaded = own.groupBy(*KEY).agg(F.sum(X.quarter_tokens("text")).alias("memory_input_tokens"))
    return _asked(questions.join(context, KEY, "left").join(loaded, KEY, "left"), questions, F.coalesce("memory", F.lit("")))


STRATEGIES: dict[str, Strategy] = {
    "summary": summary_memory, "reductive": reductive_memory, "episodic": episodic_memory, "hierarchical": tree_memory,
    "static": static_memory, "facts": partial(reductive_memory, most=50), "vector": batch_memory,
}


def answered(
    asked: DataFrame, factory: Callable[[], Completer] = Extractive, attempts: int = 1, after_context: bool = False, parallel: int | None = None, count: Callable[[str], int] | None = None
) -> DataFrame:
    """asked with hypothesis, query_input_tokens, query_output_tokens and query_time, and a failed call's failure and traceback.

    A null context: the sentinel answer, without a call.  A call that raised: the apology, with zero tokens.  Empty answers at every
    attempt, or a model that couldn't be made: "Error: " and the reason.  count: a tokenizer instead of a quarter of the characters.
    """
    shape = prompts.answer_after_context if after_context else prompts.answer
    prompt = F.when(F.col("context").isNotNull(), shape(F.col("question"), F.col("context")))
    got = completed(asked.withColumn("prompt", prompt), "prompt", factory, attempts, parallel=parallel)
    failure = F.col("failure")
    error = F.when((failure == EMPTY) | F.startswith(failure, F.lit("setup: ")), F.concat(F.lit("Error: "), failure)).otherwise(F.lit(APOLOGY))
    reply = F.when(F.col("context").isNull(), F.lit(NO_PROPOSITIONS)).when(failure.isNotNull(), error).otherwise(X.strip("completion"))
    tokens = X.quarter_tokens if count is None else lambda c: counted(c, count)
    paid = lambda c: F.when(failure.isNull() & F.col("context").isNotNull(), c).otherwise(F.lit(0)).cast("long")
    query = F.coalesce("query_text", "prompt") if "query_text" in asked.columns else F.col("prompt")
    return got.withColumns({
        "hypothesis": reply, "query_input_tokens": paid(tokens(query)), "query_output_tokens": paid(tokens(F.col("completion"))), "query_time": F.col("completion_seconds"),
    }).drop("completion", "prompt", "completion_seconds", "query_text")
