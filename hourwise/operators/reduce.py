"""Merging of arrays that tasks have added up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups of tasks whose arrays are merged first; then these are merged.
FANIN = 64


def sum_arrays(col: str, size: int | Column) -> Column:
    """Aggregate: the element-wise sum of arrays of ``size`` numbers."""
    zero = F.array_repeat(F.lit(0.0), size)
    return F.aggregate(F.collect_list(col), zero, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
