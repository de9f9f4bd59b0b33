"""Small helpers for building column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def replace_first(text: Column, token: str, value: Column) -> Column:
    """Replace the first ``token`` in ``text``; unchanged when there is none."""
    at = F.locate(token, text)
    return F.when(at > 0, F.overlay(text, value, at, len(token))).otherwise(text)
