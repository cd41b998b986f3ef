"""Language models, embedders and tokenizers behind small protocols, with deterministic offline stand-ins.

A completer or embedder is made once in each task by its factory, and called on batches.  Calls are keyed by a hash of
the prompt, so a retried task that finds the answer in the completer's cache need not pay twice.
"""

from __future__ import annotations

import hashlib
import random
import re
import time
import traceback
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cost


class Completer(Protocol):
    def complete(self, prompt: str) -> str: ...


class Embedder(Protocol):
    size: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Extractive:
    """Answers with the line of the known context that shares most words with the question, the first of equals.

    Lines are read without their speaker; those that only say that something is None are no answer.
    """

    def complete(self, prompt: str) -> str:
        head, _, rest = prompt.partition("Known context (may be empty):\n")
        context, _, tail = rest.rpartition("\n\n")
        question = re.search(r"User: (.*)", head + tail, re.DOTALL)
        asked = set(re.findall(r"\w+", question[1].partition("\nAssistant:")[0].lower())) if question else set()
        lines = [re.sub(r"^(User|Assistant): ", "", x.strip()) for x in context.splitlines()]
        lines = [x for x in lines if x and not re.fullmatch(r"(Outcome|Location|Reflection): None", x)]
        best = max(lines, key=lambda x: len(asked & set(re.findall(r"\w+", x.lower()))), default="")
        return best or "I don't know."


class Scripted:
    """Answers by the first pattern that the prompt holds; for tests."""

    def __init__(self, script: list[tuple[str, str]], otherwise: str = ""):
        self.script, self.otherwise = script, otherwise

    def complete(self, prompt: str) -> str:
        return next((answer for pattern, answer in self.script if re.search(pattern, prompt)), self.otherwise)


class Statements:
    """Offline model of statements: those of a segment, a sentence each; or, asked to merge known ones, the newest of them."""

    def complete(self, prompt: str) -> str:
        if "<segment>" not in prompt:
            most = int(re.search(r"at most (\d+)", prompt)[1])
            known = [x for x in prompt.partition("<known>\n")[2].rpartition("\n</known>")[0].splitlines() if x.strip()]
            return "\n".join(known[-most:]) or "NO CONDENSED PROPOSITIONS"
        segment = prompt.rpartition("<segment>")[2].partition("</segment>")[0]
        found = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n", segment) if s.strip()]
        return "\n".join(found) if found else "NO NEW PROPOSITIONS"


class Hashed:
    """Unit vectors of hashed words."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts, strict=True):
            for w in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                row[h % self.size] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


#: Fixed value: what an empty answer fails with.
EMPTY = "Response has no candidates"


def with_retry(
    complete: Callable[[str], str], prompt: str, attempts: int = cost.ATTEMPTS, cap: float = cost.ANSWER_CAP, sleep: Callable[[float], None] = time.sleep,
    jitter: Callable[[], float] = lambda: random.uniform(0.8, 1.2),
) -> str:
    """The first non-empty answer; every failure is tried again, after a wait by its kind."""
    last: Exception = ValueError(EMPTY)
    for k in range(1, attempts + 1):
        try:
            if answer := complete(prompt):
                return answer
            last = ValueError(EMPTY)
        except Exception as e:  # noqa: BLE001  any failure of a remote model is worth another try
            last = e
        if k < attempts:
            sleep(cost.wait(str(last), getattr(last, "status", None), k, cap, jitter()))
    raise last


def completed(
    df: DataFrame, prompt: str, factory: Callable[[], Completer], attempts: int = 1, answer: str = "completion", failure: str = "failure", parallel: int | None = None,
    cap: float = cost.ANSWER_CAP,
) -> DataFrame:
    """df with the model's answer, the failure's text and traceback where every attempt failed, and the call's seconds.

    Rows are independent; a null prompt is no call; a model that can't be made fails every row, with "setup: " before the text.  parallel: the
    prompts are dealt to so many tasks, so no more call at once.
    """
    trace, seconds = f"{failure}_trace", f"{answer}_seconds"
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.StringType()) for c in (answer, failure, trace)), T.StructField(seconds, T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes | None, tuple] = {None: (None, None, None, 0.0)}
        try:
            model, broken = factory(), None
        except Exception as e:  # noqa: BLE001  becomes every row's failure
            model, broken = None, (None, f"setup: {e}", traceback.format_exc(), 0.0)
        for frame in frames:
            got = []
            for p in frame[prompt]:
                key = None if p is None else hashlib.sha256(p.encode()).digest()
                if key not in known:
                    began = time.time()
                    try:
                        known[key] = broken or (with_retry(model.complete, p, attempts, cap), None, None, time.time() - began)
                    except Exception as e:  # noqa: BLE001  becomes the row's failure
                        known[key] = (None, str(e), traceback.format_exc(), time.time() - began)
                got.append(known[key])
                if len(known) > 10_000:
                    known = {None: known[None]}
            yield frame.assign(**{c: pd.Series([g[k] for g in got], index=frame.index, dtype=object) for k, c in enumerate((answer, failure, trace))}, **{seconds: [g[3] for g in got]})

    return (df if parallel is None else df.repartition(parallel)).mapInPandas(run, schema)


def embedding(text: Column, factory: Callable[[], Embedder] = Hashed) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield pd.Series(list(model.embed(texts.fillna("").tolist())))

    return run(text)


def counted(text: Column, count: Callable[[str], int]) -> Column:
    """Tokens by any Python tokenizer."""

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0 if t is None else count(t)).astype("int64")

    return run(text)
