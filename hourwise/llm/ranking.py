"""The first rows of each group, without one task for a whole group."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, per: str, order: list[Column], rows: int, spread: list[str], n_rows: int) -> DataFrame:
    """The first ``rows`` of each ``per`` by ``order``, with ``rank`` from 1: first inside parts (by a hash of the columns
    ``spread``) whose number grows with the root of ``n_rows``, the rows of ``df``; then among what these leave. A task so
    sorts about sqrt(n_rows * rows) rows of a group at most, twice."""
    parts = max(1, isqrt(n_rows // max(1, rows)))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    part = F.pmod(F.xxhash64(*(F.col(c) for c in spread)), F.lit(parts))
    best = df.withColumn("_part", part).withColumn("rank", rank(per, "_part")).filter(F.col("rank") <= rows)
    return best.withColumn("rank", rank(per)).filter(F.col("rank") <= rows).drop("_part")
