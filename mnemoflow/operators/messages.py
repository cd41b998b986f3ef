"""Chat messages as entries of a condensed memory."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = ("session_id", "tool_call_id")
TOOL_CALLS = "array<struct<function:struct<name:string,arguments:string>>>"


def block_text(blocks: Column) -> Column:
    """The text blocks of array<struct<type, text>>, a line each."""
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])
    return F.coalesce(F.array_join(texts, "\n"), F.lit(""))


def shown_kwargs(kwargs: Column) -> Column:
    """Of map<string, JSON>: without session and call ids; tool calls cut to name and args, as JSON."""
    left = F.map_filter(kwargs, lambda k, v: ~k.isin(*HIDDEN))

    def short(k: Column, v: Column) -> Column:
        calls = F.transform(F.from_json(v, TOOL_CALLS), lambda c: F.struct(c["function"]["name"].alias("name"), c["function"]["arguments"].alias("args")))
        parts = F.transform(calls, lambda c: F.concat(F.lit('{"name": '), F.to_json(F.array(c["name"])).substr(F.lit(2), F.length(F.to_json(F.array(c["name"]))) - 2), F.lit(', "args": '), c["args"], F.lit("}")))
        return F.when(k == "tool_calls", F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))).otherwise(v)

    return F.transform_values(left, short)


@F.pandas_udf(T.StringType())
def _as_python(pairs: pd.Series) -> pd.Series:
    def one(found) -> str | None:
        if found is None or not len(found):
            return None
        return repr({p["key"]: json.loads(p["value"]) for p in found})

    return pairs.map(one)


def entry(blocks: Column, kwargs: Column) -> Column:
    """Text, and the shown kwargs in parentheses on a line of their own, written as Python writes a dict."""
    shown = _as_python(F.map_entries(shown_kwargs(kwargs)))
    return F.concat(block_text(blocks), F.coalesce(F.concat(F.lit("\n("), shown, F.lit(")")), F.lit("")))
