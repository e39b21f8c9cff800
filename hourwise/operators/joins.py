"""Joins, row appends and scaling (J1-J3, U1, scale_columns)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row frame, as a scalar subquery (no join; NULLs if that frame is empty)."""
    return df.withColumn("_const", one_row.select(F.struct("*")).scalar()).select("*", "_const.*").drop("_const")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``left.join(right, keys, how)`` where a NULL key meets a NULL key; the columns of ``left``, then the others of
    ``right``. An equi-join like any other (hash or sort-merge)."""
    names = {c: f"_key_{i}" for i, c in enumerate(keys)}
    side = right.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in right.columns])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(names[c]))
    return left.join(side, same, how).drop(*names.values())


def _keys(on) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def assert_unique(df: DataFrame, on) -> None:
    """D13 guard: the join key of the feature side must be unique, or a left join fans out."""
    dup = df.groupBy(*_keys(on)).count().filter(F.col("count") > 1)
    if not dup.isEmpty():
        raise ValueError(f"join key {on} is not unique on the feature side")


def attach_features(df: DataFrame, feats: DataFrame, on=("series_id", "ds"), check_unique: bool = True,
                    dedupe: bool = False) -> DataFrame:
    """Left equi-join of only the *new* feature columns.

    Shuffle join on the key (AQE turns it into a broadcast when the measured feature side is small).
    ``dedupe`` keeps one existing row per key (the smallest, columns compared in their order) instead of raising.
    """
    keys = _keys(on)
    new = [c for c in feats.columns if c not in df.columns and c not in keys]
    side = feats.select(*keys, *[F.col(f"`{c}`") for c in new])
    if dedupe:
        row = F.struct(*[F.col(f"`{c}`") for c in new]) if new else F.struct(F.lit(1))
        side = side.groupBy(*keys).agg(F.min(row).alias("_row")).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in new])
    elif check_unique:
        assert_unique(side, keys)
    return df.join(side, keys, "left")


def align_actuals(actual: DataFrame, forecast: DataFrame, on=("series_id", "ds"), y: str = "y") -> DataFrame:
    """Inner join of actuals and forecasts on (series, hour)."""
    keys = [k for k in _keys(on) if k in actual.columns and k in forecast.columns]
    f = forecast.select(*keys, *[c for c in forecast.columns if c not in keys and c != y])
    return actual.select(*keys, y).join(f, keys, "inner")


def same_row_concat(df: DataFrame, *builders: Callable[[DataFrame], Iterable[Column]]) -> DataFrame:
    """Pandas ``concat(axis=1)`` of frames derived from the same rows is one projection here
    (no row index to misalign, D1)."""
    exprs = [e for b in builders for e in b(df)]
    return df.select("*", *exprs)


def append_rows(*frames: DataFrame) -> DataFrame:
    """Row append by column name, missing columns filled with NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def scale_columns(df: DataFrame, cols: Sequence[str], partition_cols: Sequence[str] = ("series_id",),
                  method: str = "standard", suffix: str = "") -> DataFrame:
    """Normalisation: ``(x - mean) / std`` (sample std) or ``(x - min) / (max - min)``, per series or global.

    The statistics table has one row per series; it is joined back on the series key.
    """
    pc = list(partition_cols)
    aggs = []
    for i, c in enumerate(cols):
        if method == "standard":
            aggs += [F.avg(c).alias(f"_a{i}"), F.stddev_samp(c).alias(f"_b{i}")]
        else:
            aggs += [F.min(c).alias(f"_a{i}"), (F.max(c) - F.min(c)).alias(f"_b{i}")]
    if pc:
        j = null_safe_join(df, df.groupBy(*pc).agg(*aggs), pc)
    else:  # one row of constants: a scalar subquery, no join
        j = with_constants(df, df.agg(*aggs))
    out = []
    for c in df.columns:
        if c in cols:
            i = list(cols).index(c)
            out.append(((F.col(c) - F.col(f"_a{i}")) / F.col(f"_b{i}")).alias(c + suffix))
            if suffix:
                out.insert(len(out) - 1, F.col(c))
        else:
            out.append(F.col(f"`{c}`"))
    return j.select(*out)
