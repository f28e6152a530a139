"""Constant lookups, required and shared values as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, even where the body
    uses it inside a lambda: the optimizer would otherwise move a projected
    expression into the lambda and evaluate it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def name_of(index: Column, names: list[str]) -> Column:
    """The name at a 0-based index; an index outside the list fails the job."""
    position = index.cast("int")
    return F.when(
        (position >= 0) & (position < len(names)),
        F.get(F.array(*[F.lit(n) for n in names]), position),
    ).when(
        position.isNotNull(),
        F.raise_error(F.concat(F.lit("no name for index "), position.cast("string"))),
    )


def required(value: Column, name: str) -> Column:
    """The value; a NULL fails the job."""
    return F.when(value.isNotNull(), value).otherwise(
        F.raise_error(F.lit(f"{name} must not be NULL"))
    )


def renamed_by(value: Column, names: dict[str, str]) -> Column:
    """Value mapped through a constant dictionary, NULL when absent."""
    result = F.lit(None).cast("string")
    for old, new in names.items():
        result = F.when(value == old, F.lit(new)).otherwise(result)
    return result
