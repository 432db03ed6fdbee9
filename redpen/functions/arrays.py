"""Helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` over a struct of ``values``, each computed once per row.

    An expression used inside a lambda is computed again for every element;
    bound first, it is only looked up there.
    """
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    return F.get(F.transform(F.array(row), body), F.lit(0))
