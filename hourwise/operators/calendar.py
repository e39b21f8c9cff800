"""Calendar parts and date helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.functions import time as tf
from hourwise.operators.filters import between_ts

ALL_PARTS = ("hour", "day_of_week", "month", "week_of_year", "quarter", "is_weekend", "hour_of_week")


def calendar_features(df: DataFrame, ts: str = "ds", parts: Sequence[str] = ALL_PARTS,
                      day_col: str | None = None, hour_col: str | None = None) -> DataFrame:
    """T1-T7 in one projection.  ``hour_of_week = Day*24 + H`` from input columns when named, else derived."""
    c = tf.ntz(ts)
    wd = tf.weekday(ts)
    exprs = {
        "hour": F.hour(c),
        "day_of_week": wd,
        "month": F.month(c),
        "week_of_year": F.weekofyear(c),
        "quarter": F.quarter(c),
        "is_weekend": wd.isin(5, 6).cast("int"),
        "hour_of_week": ((F.col(day_col) if day_col else wd) * 24 + (F.col(hour_col) if hour_col else F.hour(c))).cast("int"),
    }
    return df.select("*", *[exprs[p].alias(p) for p in parts])


def month_bucket(df: DataFrame, ts: str = "ds", out: str = "month") -> DataFrame:
    """T8."""
    return df.withColumn(out, tf.month_start(ts))


def format_minutes(df: DataFrame, ts: str = "ds", out: str | None = None) -> DataFrame:
    """``yyyy-MM-dd HH:mm`` text."""
    return df.withColumn(out or ts, tf.format_minutes(ts))


def date_range(df: DataFrame, ts: str = "ds", group_cols: Sequence[str] = ()) -> DataFrame:
    """Min / max (and counts) after coercion."""
    from hourwise.operators.filters import data_bounds

    return data_bounds(df, ts, group_cols)


def show_between(df: DataFrame, lo, hi, ts: str = "ds", n: int = 20, order: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows (by time) inside a range; the limit is the feature (a preview)."""
    return between_ts(df, lo, hi, ts).orderBy(*(order or [ts])).limit(n)
