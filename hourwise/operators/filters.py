"""Filters and predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.operators.joins import null_safe_join, with_constants
from hourwise.functions import time as tf


def between_ts(df: DataFrame, lo=None, hi=None, col: str = "ds", closed: str = "both") -> DataFrame:
    """range filter on the timestamp; ``closed`` in both / right / left / neither.

    Plain comparisons on the scan column, so Parquet scans receive them as pushed filters.
    """
    c = F.col(col)
    cond = F.lit(True)
    if lo is not None:
        cond = cond & ((c >= tf.ts_bound(lo)) if closed in ("both", "left") else (c > tf.ts_bound(lo)))
    if hi is not None:
        cond = cond & ((c <= tf.ts_bound(hi)) if closed in ("both", "right") else (c < tf.ts_bound(hi)))
    return df.filter(cond)


def at_ts(df: DataFrame, ts, col: str = "ds") -> DataFrame:
    """rows of one hour."""
    return df.filter(F.col(col) == tf.ts_bound(ts))


def validate_range(start, end, min_ts=None, max_ts=None) -> None:
    """driver-side check of argument bounds."""
    import datetime as _dt

    def p(v):
        return v if isinstance(v, _dt.datetime) else _dt.datetime.fromisoformat(str(v))

    s, e = p(start), p(end)
    if s > e:
        raise ValueError(f"start {s} is after end {e}")
    if (min_ts is not None and s < p(min_ts)) or (max_ts is not None and e > p(max_ts)):
        raise ValueError(f"the range {s} to {e} reaches outside the data")


def data_bounds(df: DataFrame, col: str = "ds", group_cols: Iterable[str] = ()) -> DataFrame:
    """Count, min and max of the timestamp (one aggregate, map-side partial)."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count(col).alias("n_valid"), F.min(col).alias("min_ds"), F.max(col).alias("max_ds")]
    g = list(group_cols)
    return df.groupBy(*g).agg(*aggs) if g else df.agg(*aggs)


def validate_range_from_data(df: DataFrame, start, end, col: str = "ds") -> None:
    """bounds taken from the data; ``start <= end`` and both inside [min, max]."""
    b = data_bounds(df, col).first()
    validate_range(start, end, b["min_ds"], b["max_ds"])


def require_non_empty(df: DataFrame, what: str = "filtered data") -> DataFrame:
    """F6."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def drop_null_ts(df: DataFrame, col: str = "ds", report: bool = False):
    """drop rows without a timestamp; optionally report how many were dropped."""
    out = df.filter(F.col(col).isNotNull())
    if report:
        return out, df.agg(F.count_if(F.col(col).isNull())).first()[0]
    return out


def drop_nulls(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """F8: drop a row with any missing value (in ``cols`` or all columns)."""
    return df.na.drop("any", subset=list(cols) if cols is not None else None)


def filter_scores(scores: DataFrame, regex: str, negate: bool = False, col: str = "feature") -> DataFrame:
    """name regex on a score table, or its negation."""
    m = F.col(col).rlike(regex)
    return scores.filter(~m if negate else m)


def is_in(col: str, values) -> "F.Column":
    """F10."""
    return F.col(col).isin(list(values))


def has_nulls(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """one-row frame, one boolean per column, from a single aggregate."""
    cols = list(cols) if cols is not None else df.columns
    return df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in cols])


def remove_outliers(df: DataFrame, col: str = "y", z: float = 3.0, partition_cols: Iterable[str] = ()) -> DataFrame:
    """drop rows with |(x - mean) / std_pop| > z.

    Statistics come from one aggregate (per series when ``partition_cols``); the statistics table has one
    row per series and is joined back (AQE broadcasts it when its measured size is small).
    Rows whose value is NULL are kept (they have no z-score), like the reference's index-based drop.
    """
    pc = list(partition_cols)
    aggs = [F.avg(col).alias("_mu"), F.stddev_pop(col).alias("_sd")]
    # per-series tables are left to AQE's runtime size check (broadcast when small, else a shuffle join with skew
    # splitting); global statistics are a scalar subquery
    joined = null_safe_join(df, df.groupBy(*pc).agg(*aggs), pc) if pc else with_constants(df, df.agg(*aggs))
    zc = F.abs((F.col(col) - F.col("_mu")) / F.col("_sd"))
    keep = F.col(col).isNull() | F.col("_sd").isNull() | (F.col("_sd") == 0) | (zc <= F.lit(z))
    return joined.filter(keep).drop("_mu", "_sd")
