"""Missing-data reports and grid regularisation (M7-M10; fills live in ``ordered``)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourwise.functions import time as tf
from hourwise.operators.joins import null_safe_join
from hourwise.operators.ordered import DEFAULT_CHUNK, _cols


def null_counts(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """M8: missing count per numeric column -> long ``(column, n_missing)``; one aggregate pass."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    cols = list(cols)
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).cast("bigint").alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_missing")


def null_counts_by_month(df: DataFrame, cols: Sequence[str], ts: str = "ds", group_cols: Sequence[str] = ()) -> DataFrame:
    """M9/A3: missing counts per month (and optional groups), only months where any count is > 0."""
    cols = list(cols)
    g = [*group_cols, tf.month_start(ts).alias("month")]
    out = df.groupBy(*g).agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in cols])
    return out.filter(F.greatest(*[F.col(c) for c in cols], F.lit(0)) > 0) if cols else out


def missing_dates(df: DataFrame, col: str, ts: str = "ds") -> DataFrame:
    """Distinct timestamps where ``col`` is missing (empty frame when the column has no gap)."""
    if col not in df.columns:
        raise KeyError(f"no column named {col!r}")
    return df.filter(F.col(col).isNull()).select(ts).distinct()


def hour_grid(bounds: DataFrame, partition_cols: Sequence[str] = ("series_id",), lo: str = "lo_h", hi: str = "hi_h",
              step_hours: int = 1, chunk: int = DEFAULT_CHUNK, out: str = "ds", pos_col: str | None = None) -> DataFrame:
    """Every ``step_hours`` between epoch-hour bounds ``lo``..``hi`` (inclusive) per row of ``bounds``.

    Two-level explode (chunk ids, then hours inside a chunk) so no single row holds a whole long grid.
    """
    pc = _cols(partition_cols)
    span = int(chunk) * int(step_hours)
    ids = bounds.select(*pc, lo, hi, F.explode(F.sequence(F.floor((F.col(lo)) / span), F.floor(F.col(hi) / span))).alias("_gc"))
    start = F.greatest(F.col("_gc") * span + F.pmod(F.col(lo) - F.col("_gc") * span, F.lit(step_hours)), F.col(lo))
    end = F.least((F.col("_gc") + 1) * span - 1, F.col(hi))
    hours = ids.select(*pc, lo, F.explode(F.sequence(start, end, F.lit(step_hours).cast("bigint"))).alias("_h"))
    extra = [((F.col("_h") - F.col(lo)) / F.lit(step_hours)).cast("bigint").alias(pos_col)] if pos_col else []
    return hours.select(*pc, tf.from_epoch_hours("_h").alias(out), *extra)


def hour_range(spark, start, end, step_hours: int = 1) -> DataFrame:
    """The hourly timestamps from ``start`` to ``end`` inclusive, as a one-column frame."""
    b = spark.range(1).select(tf.epoch_hours(tf.ts_bound(start)).alias("lo_h"), tf.epoch_hours(tf.ts_bound(end)).alias("hi_h"))
    return hour_grid(b, (), step_hours=step_hours)


def regularize(df: DataFrame, partition_cols: Sequence[str] = ("series_id",), ts: str = "ds", step_hours: int = 1,
               flag: str | None = "is_filled", pos_col: str | None = None, off_grid: str = "raise") -> DataFrame:
    """M7: one row per series and hour between the series' first and last hour; inserted rows carry NULLs
    (and ``flag = 1``).  Timestamps must be on the hour (``round_hour``) and unique within a series:
    a NULL series is a series like others; with ``off_grid="raise"`` the job fails, with their number, if rows are off the hour, without a time or repeated;
    ``off_grid="aggregate"`` rounds to the hour, drops rows without a time and keeps of each (series, hour) the
    averages of numeric columns and the smallest value of others.

    ``pos_col`` also emits the 0-based row position, free on a regular grid ((hour - first hour) / step);
    ordered operators given ``pos_col`` then skip their own position pass."""
    pc = _cols(partition_cols)
    if off_grid == "aggregate":
        numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
        rest = [c for c in df.columns if c not in (*pc, ts)]
        df = df.withColumn(ts, tf.round_hour(ts)).filter(F.col(ts).isNotNull()).groupBy(*pc, ts).agg(
            *[(F.avg(F.col(f"`{c}`")) if c in numeric else F.min(F.col(f"`{c}`"))).alias(c) for c in rest]).select(*df.columns)
    hours = df.groupBy(*pc, ts).agg(F.count(F.lit(1)).alias("_n"))
    off = F.when(F.col(ts).isNull() | (tf.round_hour(ts) != F.col(ts)), F.col("_n")).otherwise(F.col("_n") - 1)
    ends = hours.groupBy(*pc).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.sum(off).alias("_off"))
    message = F.concat(F.col("_off").cast("string"), F.lit(" rows are off the hour, without a time or repeated; round and aggregate them first (off_grid='aggregate')"))
    bounds = ends.select(*pc, F.when(F.col("_off") > 0, F.raise_error(message).cast("bigint")).otherwise(tf.epoch_hours("_lo")).alias("lo_h"),
                         tf.epoch_hours("_hi").alias("hi_h"))
    grid = hour_grid(bounds, pc, step_hours=step_hours, out=ts, pos_col=pos_col)
    data = df.withColumn("_present", F.lit(1)) if flag else df
    joined = null_safe_join(grid, data, [*pc, ts])
    cols = [*pc, ts] + [c for c in df.columns if c not in (*pc, ts)] + ([pos_col] if pos_col else [])
    sel = [F.col(f"`{c}`") for c in cols]
    if flag:
        sel.append(F.when(F.col("_present").isNull(), 1).otherwise(0).alias(flag))
    return joined.select(*sel)
