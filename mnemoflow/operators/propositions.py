"""Statements learnt from sessions in order: extract what is new, and condense at the cap.

A prompt holds what was known before its session, so an owner's sessions are one sequential fold, owners in parallel.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import cost
from ..functions.models import Completer, Statements, with_retry
from .prompts import CONDENSE, EXTRACT

#: The cap, and the answers that add nothing and that merge nothing.
MOST = 50
NOTHING_NEW, NOTHING_CONDENSED = "NO NEW PROPOSITIONS", "NO CONDENSED PROPOSITIONS"


def fill(template: str, **fields: object) -> str:
    for k, v in fields.items():
        template = template.replace("{{ " + k + " }}", str(v))
    return template


def learn(known: list[str], segment: str, model: Completer, most: int = MOST, trim_sentinel: bool = False) -> tuple[list[str], int, int]:
    """What is known after a segment, and the estimated tokens in and out (a quarter of the characters).

    Extraction counts its whole prompt, condensing only the statements; an answer that adds nothing counts as empty.
    """

    def said(answer: str, nothing: str) -> str:
        return "" if (answer.strip() if trim_sentinel else answer) == nothing else answer

    def lines(text: str) -> list[str]:
        return [x.strip() for x in text.strip().splitlines() if x.strip()]

    prompt = fill(EXTRACT, existing="\n".join(known), segment=segment)
    new = said(model.complete(prompt), NOTHING_NEW)
    tokens_in, tokens_out = len(prompt) // 4, len(new) // 4
    known = list(dict.fromkeys([*known, *lines(new)]))
    if len(known) >= most:
        listed = "\n".join(known)
        short = said(model.complete(fill(CONDENSE, existing=listed, most=most)), NOTHING_CONDENSED)
        tokens_in, tokens_out = tokens_in + len(listed) // 4, tokens_out + len(short) // 4
        known = lines(short) or known
    return known, tokens_in, tokens_out


class _Retried:
    def __init__(self, model: Completer, attempts: int):
        self.model, self.attempts = model, attempts

    def complete(self, prompt: str) -> str:
        return with_retry(self.model.complete, prompt, self.attempts, cost.STORE_CAP)


def learnt(
    sessions: DataFrame, keys: list[str], seq: str, text: str, factory: Callable[[], Completer] = Statements, most: int = MOST, attempts: int = 1, parallel: int | None = None
) -> DataFrame:
    """keys, seq, proposition, input_tokens, output_tokens, seconds: each owner's statements in order, and the sums of its calls.

    A session whose calls fail at every attempt is left out, as is a null or empty one; repeated statements are one; an empty
    table gives an empty result.  parallel: owners are dealt to so many tasks.
    """
    types = dict(sessions.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", seq bigint, proposition string, input_tokens bigint, output_tokens bigint, seconds double"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        model, known, i, o, began = _Retried(factory(), attempts), [], 0, 0, time.time()
        for segment in pdf.sort_values(seq)[text]:
            if segment:
                try:
                    known, more_in, more_out = learn(known, segment, model, most)
                except Exception:  # noqa: BLE001  the session is skipped, what was known stays
                    continue
                i, o = i + more_in, o + more_out
        n = len(known)
        cols = {k: pd.Series([pdf[k].iloc[0]] * n, dtype=pdf[k].dtype) for k in keys}
        cols |= {"seq": pd.Series(range(n), dtype="int64"), "proposition": pd.Series(known, dtype=object)}
        cols |= {"input_tokens": pd.Series([i] * n, dtype="int64"), "output_tokens": pd.Series([o] * n, dtype="int64")}
        return pd.DataFrame(cols | {"seconds": pd.Series([time.time() - began] * n, dtype="float64")})

    rows = sessions.select(*keys, seq, text)
    return (rows if parallel is None else rows.repartition(parallel, *keys)).groupBy(*keys).applyInPandas(fold, schema)
