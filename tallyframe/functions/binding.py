"""Name a sub-expression once. A Column that is used n times is otherwise n copies in the plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)
