"""Episodes: parsed from tagged text, stored, written as text, and read back from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .dedup import STORED, episodes_kept
from .turns import rendered

#: The fields of a tagged text, in order.
FIELDS = ("user_summary", "agent_summary", "outcome", "location", "reflection")
#: The marks of an episode's lines, in order.
MARKS = ("[USER INPUT]", "[AGENT OUTPUT]", "[OUTCOME]", "[LOCATION]", "[REFLECTION]")


def parsed(text: Column | str, strict: bool = False) -> Column:
    """struct of FIELDS and categorical_tags from <result> tags.

    Empty results are left out, which shifts those behind them; strict keeps each at its place, as null.
    """
    c = F.col(text) if isinstance(text, str) else text
    if strict:
        found = F.transform(F.regexp_extract_all(c, F.lit(r"(?s)<result>(.*?)</result>"), F.lit(1)), X.strip)
    else:
        found = X.tagged(c, "result")
    at = lambda k: F.nullif(F.try_element_at(found, F.lit(k + 1)), F.lit(""))
    tags = F.filter(F.slice(found, len(FIELDS) + 1, F.greatest(F.size(found), F.lit(1))), lambda x: x != "")
    return F.struct(*[at(k).alias(f) for k, f in enumerate(FIELDS)], tags.alias("categorical_tags"))


def usable(df: DataFrame, user: str = "user_summary", agent: str = "agent_summary") -> DataFrame:
    """Rows with both summaries."""
    return df.where((F.coalesce(user, F.lit("")) != "") & (F.coalesce(agent, F.lit("")) != ""))


def as_text(user: Column, agent: Column, outcome: Column, location: Column, reflection: Column) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"{m}: "), X.or_none(v)) for m, v in zip(MARKS, (user, agent, outcome, location, reflection), strict=True)])


def stored(df: DataFrame, keys: list[str], seq: list[str], stamp: Column | None = None) -> DataFrame:
    """Episodes as a store holds them, from user_input, agent_output, outcome, location, reflection, categorical_tags.

    id is a hash of owner and order, so reruns agree; timestamp is the given one, or the time of the query.
    """
    kept = episodes_kept(df, keys, "user_input", seq)
    own = F.sha2(F.concat_ws("\u001f", *[F.col(c).cast("string") for c in (*keys, *seq)]), 256)
    text = as_text(*map(F.col, ("user_input", "agent_output", "outcome", "location", "reflection")))
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if stamp is None else stamp
    cut = lambda c: F.left(F.col(c), F.lit(STORED)).alias(c)
    tags = F.coalesce("categorical_tags", F.array().cast("array<string>")).alias("categorical_tags")
    return kept.select(*keys, *seq, own.alias("id"), when.alias("timestamp"), cut("user_input"), cut("agent_output"), "outcome", "location", "reflection", tags, X.strip(text).alias("text"))


def read_back(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, nth, fields: the memories that episodes' joined text holds, each a map from mark to value.

    A memory starts at a [USER INPUT] line and is given out at each [REFLECTION] line while it has fields; what follows still
    goes into it, up to the next start, and the last value of a mark counts.
    """
    lines = df.select(*keys, F.posexplode(F.transform(X.lines(text), X.strip)).alias("n", "line")).where("line <> ''")
    starts = F.sum(F.when(F.startswith("line", F.lit(MARKS[0])), 1).otherwise(0))
    lines = lines.withColumn("memory", starts.over(Window.partitionBy(*keys).orderBy("n")))
    key, value = X.key_value("line")
    lines = lines.withColumns({"key": key, "value": value, "ends": F.startswith("line", F.lit(MARKS[-1]))})
    first = F.min(F.when(F.col("key").isNotNull(), F.col("n"))).over(Window.partitionBy(*keys, "memory"))
    lines = lines.withColumn("given", F.col("ends") & (first <= F.col("n")))
    fields = lines.where("key is not null").groupBy(*keys, "memory", "key").agg(F.max_by("value", "n").alias("value"))
    fields = fields.groupBy(*keys, "memory").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("fields"))
    given = lines.where("given").select(*keys, "memory", "n")
    out = given.join(fields, [*keys, "memory"])
    return out.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("n")).cast("long").alias("nth"), "fields")


def history(fields: Column) -> Column:
    """The prompt lines of one memory: what the user said, what the agent answered and what came of it."""
    user, agent = _parts(fields)
    return F.concat_ws("\n", rendered(F.lit("user"), user), rendered(F.lit("assistant"), agent))


def _parts(fields: Column) -> tuple[Column, Column]:
    """The user's part of one memory, and the agent's with what came of it; null where there is none."""
    v = lambda m: F.try_element_at(fields, F.lit(m))
    more = lambda label, m: F.when(F.coalesce(v(m), F.lit("")) != "", F.concat(F.lit(f"{label}: "), v(m)))
    agent = F.concat_ws("\n", v(MARKS[1]), more("Outcome", MARKS[2]), more("Location", MARKS[3]), more("Reflection", MARKS[4]))
    return v(MARKS[0]), F.when(v(MARKS[1]).isNotNull(), agent)


def said(fields: Column) -> Column:
    """Both parts of one memory without their speakers; what a query's tokens are counted of."""
    return F.concat_ws(" ", *_parts(fields))
