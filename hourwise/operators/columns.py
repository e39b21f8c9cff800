"""Projections, typing and column management."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourwise.functions import time as tf
from hourwise.functions.names import filter_names


def parse_ts(df: DataFrame, col: str, fmt: str | None = None, strict: bool = True, out: str | None = None) -> DataFrame:
    """Text -> wall-clock timestamp.  strict raises on a bad value (ANSI cast), else NULL."""
    src = F.col(col)
    if strict:
        parsed = F.to_timestamp_ntz(src, F.lit(fmt)) if fmt else src.cast("timestamp_ntz")
        if not fmt:
            # ANSI casting raises on bad text; make it raise even with ANSI off
            parsed = F.when(src.isNull() | parsed.isNotNull(), parsed).otherwise(
                F.raise_error(F.concat(F.lit("unparseable timestamp: "), src.cast("string")))
            )
    else:
        s = src.cast("string")
        parsed = F.try_to_timestamp(s, F.lit(fmt)) if fmt else F.try_to_timestamp(s)
        parsed = parsed.cast("timestamp_ntz")
    return df.withColumn(out or col, parsed)


def round_hour(df: DataFrame, col: str = "ds", out: str | None = None) -> DataFrame:
    """Nearest hour, ties to even."""
    return df.withColumn(out or col, tf.round_hour(col))


def to_numeric(df: DataFrame, cols: Iterable[str] | None = None, report: bool = False):
    """``try_cast(c as double)``.  With ``report`` also returns {column: values that became NULL}
    computed in one aggregate."""
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in ("ds", "series_id")]
    casted = df.select(*[F.expr(f"try_cast(`{c}` as double)").alias(c) if c in cols else F.col(c) for c in df.columns])
    if not report:
        return casted
    bad = df.agg(
        *[F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as double)").isNull()).alias(c) for c in cols]
    ).first()
    lost = {c: bad[c] for c in cols if bad[c]}
    for c, n in lost.items():
        warnings.warn(f"{n} values of {c!r} are not numbers and became NULL")
    return casted, lost


# Timestamp and target column names of the source table the reference expects.
SOURCE_TS, SOURCE_TARGET = "Date", "PriceHU"


def as_model_frame(df: DataFrame, ts: str = SOURCE_TS, target: str = SOURCE_TARGET, keep_series: bool = True) -> DataFrame:
    """P5: ``ts -> ds``, ``target -> y``, originals dropped, other columns kept in order."""
    rest = [c for c in df.columns if c not in (ts, target, "ds", "y")]
    lead = [F.col(ts).alias("ds"), F.col(target).alias("y")]
    if keep_series and "series_id" in rest:
        rest.remove("series_id")
        lead = [F.col("series_id")] + lead
    return df.select(*lead, *rest)


def drop_cols(df: DataFrame, cols: Iterable[str], strict: bool = False) -> DataFrame:
    """Tolerant (skip absent) or strict (raise on absent) drop."""
    cols = list(cols)
    if strict:
        require_cols(df, cols)
    return df.drop(*cols)


def existing_cols(df: DataFrame, cols: Iterable[str], warn: bool = True) -> list[str]:
    """The listed columns that exist; warn about the rest."""
    present = set(df.columns)
    cols = list(cols)
    missing = [c for c in cols if c not in present]
    if missing and warn:
        warnings.warn(f"columns not in the DataFrame, skipped: {missing}")
    return [c for c in cols if c in present]


def require_cols(df: DataFrame, cols: Iterable[str]) -> None:
    """P8."""
    missing = [c for c in cols if c not in set(df.columns)]
    if missing:
        raise KeyError(f"required columns missing: {missing}")


def select_features(df: DataFrame, features: Iterable[str], keep: Iterable[str] = ("series_id", "ds", "y")) -> DataFrame:
    """Chosen features plus the key columns that exist, keys first, no duplicates."""
    keys = [k for k in keep if k in df.columns]
    feats = [f for f in features if f not in keys]
    require_cols(df, feats)
    seen, out = set(), []
    for c in keys + feats:
        if c not in seen:
            seen.add(c)
            out.append(c)
    return df.select(*[F.col(f"`{c}`") for c in out])


def dedupe_columns(df: DataFrame) -> DataFrame:
    """P10: keep the first of duplicated column names."""
    names = df.columns
    tmp = [f"_c{i}" for i in range(len(names))]
    renamed = df.toDF(*tmp)
    seen, keep = set(), []
    for t, n in zip(tmp, names):
        if n not in seen:
            seen.add(n)
            keep.append(F.col(t).alias(n))
    return renamed.select(*keep)


def numeric_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """P11."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def feature_name_filter(df_or_names, **kw) -> list[str]:
    """Prefix / substring / regex filter on column names."""
    names = df_or_names.columns if isinstance(df_or_names, DataFrame) else list(df_or_names)
    return filter_names(names, **kw)


def bool_to_int(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P13."""
    cols = set(cols)
    return df.select(*[F.col(c).cast("int").alias(c) if c in cols else F.col(c) for c in df.columns])


def split_xy(df: DataFrame, target: str = "y", ts: str = "ds", keys: Iterable[str] = ("series_id",)) -> tuple[list[str], str]:
    """Feature columns = all but target, timestamp and keys."""
    skip = {target, ts, *keys}
    return [c for c in df.columns if c not in skip], target
