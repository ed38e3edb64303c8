"""Pandas UDFs that are made when they are called, so that modules can be imported before a session exists."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def lazy_udf(returns: str) -> Callable:
    def mark(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def column(*cols) -> Column:
            return F.pandas_udf(f, returns)(*cols)

        return column

    return mark
