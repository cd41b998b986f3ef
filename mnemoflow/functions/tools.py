"""Tools an agent may call, as Column functions and, once registered, in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def multiply(a: Column, b: Column) -> Column:
    return a * b


def divide(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return F.try_divide(a, b)


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def clock(at: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd HH:mm:ss")


def weather(city: Column) -> Column:
    return F.concat(F.lit("The weather in "), city, F.lit(" is sunny."))


def echo(text: Column) -> Column:
    return F.concat(F.lit("Echo: "), text)


TOOLS: dict[str, Callable[..., Column]] = {f.__name__: f for f in (multiply, divide, add, subtract, clock, weather, echo)}


def register(spark: SparkSession, name: str, body: Callable, returns: str) -> None:
    """A user's own Python tool under a SQL name; rows go to it in Arrow batches."""
    spark.udf.register(name, F.udf(body, returns, useArrow=True))
