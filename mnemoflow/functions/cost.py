"""Prices, backoff and status tests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dollars for 1000 tokens in and out; first delay in seconds and its cap; attempts.
INPUT_PRICE, OUTPUT_PRICE = 0.00010, 0.00040
BASE_DELAY, STORE_CAP, ANSWER_CAP, RATE_CAP, ATTEMPTS = 1.5, 20.0, 30.0, 15.0, 8


def cost(tokens_in: Column, tokens_out: Column, price_in: float = INPUT_PRICE, price_out: float = OUTPUT_PRICE) -> Column:
    return tokens_in / F.lit(1000.0) * F.lit(price_in) + tokens_out / F.lit(1000.0) * F.lit(price_out)


def backoff(attempt: Column, cap: float = STORE_CAP, jitter_seed: int | None = None) -> Column:
    """Seconds to wait after the attempt, counted from 1; with a seed, times 0.8 to 1.2."""
    delay = F.least(F.lit(BASE_DELAY) * F.pow(F.lit(2.0), attempt - 1), F.lit(cap))
    return delay if jitter_seed is None else delay * (F.lit(0.8) + F.lit(0.4) * F.rand(jitter_seed))


def delay(attempt: int, cap: float = STORE_CAP) -> float:
    """The same on the driver or an executor, without jitter."""
    return min(BASE_DELAY * 2 ** (attempt - 1), cap)


def wait(message: str, status: int | None, attempt: int, cap: float, jitter: float) -> float:
    """Seconds before the next attempt after a failure; jitter from 0.8 to 1.2.

    A rate limit met while answering waits up to RATE_CAP without jitter; all else, server errors and empty answers
    among it, backs off to the cap with jitter.
    """
    limited = "Rate limit" in message or "429" in message or status == 429
    return delay(attempt, RATE_CAP) if limited and cap == ANSWER_CAP else delay(attempt, cap) * jitter


def is_rate_limit(message: Column) -> Column:
    return F.contains(message, F.lit("Rate limit")) | F.contains(message, F.lit("429"))


def is_transient(status: Column) -> Column:
    return status.isin(502, 503, 504)
