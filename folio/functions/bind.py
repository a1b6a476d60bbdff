"""Binding: a value computed once and used many times within one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it (a lambda's variable is not computed again)."""
    return F.element_at(F.transform(F.array(value), use), 1)
