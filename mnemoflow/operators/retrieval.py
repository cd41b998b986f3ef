"""Lexical retrieval: episodes by words shared with a query, and by tags that hold one of its words.

Two plans give the same rows.  ``indexed`` joins queries and episodes on words, so a pair that shares nothing is
never made; the tag bonus joins the queries' words with the distinct tags (a substring test) first.  ``scanned`` scores every
pair and needs the episodes to be few; the caller's bound on them is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Episodes returned, and what is returned without a query or without episodes.
TOP = 5
NO_QUERY, NO_EPISODES = "ERROR: No Query Provided", "ERROR: No Memory Entries Stored"
FEW_EPISODES = 10_000


def query_words(query: Column | str) -> Column:
    return F.array_distinct(X.words(X.strip(query if isinstance(query, Column) else F.col(query))))


def episode_words(user: Column | str, agent: Column | str, tags: Column | str | None = None) -> Column:
    """Distinct words of both sides, lower-cased, and of the tags as they are."""
    col = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    own = X.words(F.concat_ws(" ", col(user), col(agent)))
    if tags is not None:
        own = F.concat(own, X.raw_words(F.array_join(F.col(tags) if isinstance(tags, str) else tags, " ")))
    return F.array_distinct(own)


def tag_bonus(query: Column, tags: Column) -> Column:
    """How many tags hold a query word."""
    return F.size(F.filter(tags, lambda g: F.exists(query, lambda q: F.contains(F.lower(g), q))))


def scanned(queries: DataFrame, episodes: DataFrame, scope: list[str]) -> DataFrame:
    """query_id, seq, score > 0 by scoring every pair of a scope; queries(scope, query_id, words), episodes(scope, seq, words, tags)."""
    if (n := episodes.limit(FEW_EPISODES + 1).count()) > FEW_EPISODES:
        raise ValueError(f"{n} episodes or more; use indexed()")
    few = F.broadcast(episodes.select(*scope, "seq", F.col("words").alias("has"), "tags"))
    pairs = queries.select(*scope, "query_id", "words").join(few, scope) if scope else queries.select("query_id", "words").crossJoin(few)
    score = F.size(F.array_intersect("words", "has")) + tag_bonus(F.col("words"), F.col("tags"))
    return pairs.select("query_id", "seq", score.cast("long").alias("score")).where("score > 0")


def indexed(queries: DataFrame, episodes: DataFrame, scope: list[str]) -> DataFrame:
    """The same by joins on words and on tags."""
    asked = queries.select(*scope, "query_id", F.explode("words").alias("word"))
    held = episodes.select(*scope, "seq", F.explode("words").alias("word"))
    shared = asked.join(held, [*scope, "word"]).select("query_id", "seq")
    tags = episodes.select(*scope, "seq", F.posexplode("tags").alias("k", "tag")).withColumn("tag", F.lower("tag"))
    meant = asked.select("word").distinct().join(F.broadcast(tags.select("tag").distinct()) if _few_tags(tags) else tags.select("tag").distinct(), F.contains("tag", F.col("word")))
    bonus = asked.join(meant, "word").select(*scope, "query_id", "tag").distinct().join(tags, [*scope, "tag"]).select("query_id", "seq")
    return shared.union(bonus).groupBy("query_id", "seq").agg(F.count("*").alias("score"))


def _few_tags(tags: DataFrame, most: int = 10_000) -> bool:
    return tags.select("tag").distinct().limit(most + 1).count() <= most


def best(scores: DataFrame, top: int = TOP, stamp: str | None = None) -> DataFrame:
    """The top rows of each query: higher score, then later stamp, then earlier place."""
    order = [F.col("score").desc(), *([F.col(stamp).desc()] if stamp else []), F.col("seq").asc()]
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def newest(episodes: DataFrame, scope: list[str], top: int = TOP) -> DataFrame:
    """The last episodes of each scope, which answer a query that shares nothing; in their order."""
    w = Window.partitionBy(*scope).orderBy(F.col("seq").desc())
    return episodes.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= top).drop("from_end")


def retrieved(queries: DataFrame, episodes: DataFrame, scope: list[str], top: int = TOP) -> DataFrame:
    """query_id, memory: what a query gets back as text; queries(scope, query_id, query), episodes(scope, seq, timestamp, user_input, agent_output, categorical_tags, text)."""
    q = queries.withColumn("words", query_words("query"))
    e = episodes.withColumns({"words": episode_words("user_input", "agent_output", "categorical_tags"), "tags": F.col("categorical_tags")})
    scores = indexed(q, e, scope).join(queries.select("query_id", *scope), "query_id").join(e.select(*scope, "seq", "timestamp", "text"), [*scope, "seq"])
    got = best(scores, top, "timestamp").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("got"))
    last = newest(e, scope, top).groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(F.col("seq").alias("rank"), "text"))).alias("last"))
    out = queries.join(got, "query_id", "left").join(last, scope, "left")
    text = lambda c: F.array_join(F.transform(c, lambda r: r["text"]), "\n")
    answer = F.when(F.col("query").isNull(), F.lit(NO_QUERY)).when(F.col("last").isNull(), F.lit(NO_EPISODES)).otherwise(F.coalesce(text("got"), text("last")))
    return out.select("query_id", *scope, "query", answer.alias("memory"))
