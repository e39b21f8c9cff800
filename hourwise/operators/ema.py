"""Exponential moving average (W6/W7) with pandas ``ewm(span).mean()`` semantics.

pandas (adjust=True, ignore_na=False): alpha = 2/(span+1), d = 1-alpha; at an observed row p

    ema(p) = sum_{i<=p observed} d^(p-i) x_i / sum_{i<=p observed} d^(p-i)

(gaps keep their position); a missing row repeats the value of the last observed row, and rows before the first
observation are missing.

Plan: a series is cut into chunks of ``B`` positions. One aggregate gives each chunk's two sums as seen from its last
position; a scan over the small chunk table (blocks of chunks, then chunks) gives the average and its weight before
each chunk; one window over (series, chunk) continues from there. Every observation counts, whatever its age;
no row is copied, and all columns and spans share the passes. ``B`` keeps ``d^-B`` below 1e200 for the smallest span.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourwise.functions.names import ema_name
from hourwise.operators.joins import null_safe_join
from hourwise.operators.ordered import CHUNK, DEFAULT_CHUNK, SCAN_ROWS, _cols, ensure_pos


def decay(span: float) -> float:
    return 1.0 - 2.0 / (float(span) + 1.0)


def chunk_rows(spans: Sequence[float], chunk: int = DEFAULT_CHUNK) -> int:
    """Positions of a chunk: at most ``chunk``, and ``d^-B`` stays below 1e200."""
    d = [decay(s) for s in spans if decay(s) > 0.0]
    return max(1, min([int(chunk), *(int(200.0 / -math.log10(x)) for x in d)]))


def add_ema(df: DataFrame, cols, spans: Sequence[int], partition_cols=("series_id",), order_col: str = "ds",
            chunk: int = DEFAULT_CHUNK, pos_col: str | None = None, prefix_names: bool | None = None,
            exclude_current: bool = False) -> DataFrame:
    """``ema_{span}h`` (one column) or ``{col}_ema_{span}h`` (several). NaN counts as missing.

    ``exclude_current`` gives the EMA as of the previous row (no target leakage, D11).
    """
    cols, pc, spans = _cols(cols), _cols(partition_cols), list(spans)
    if not cols or not spans:
        return df
    single = (len(cols) == 1) if prefix_names is None else not prefix_names
    base_cols = df.columns
    df, pos, created = ensure_pos(df, pc, order_col, pos_col)
    b = chunk_rows(spans, chunk)
    pairs = [(c, s) for c in cols for s in spans]
    at = df.withColumn(CHUNK, F.floor(F.col(pos) / F.lit(b)).cast("bigint"))
    inside = (F.col(pos) - F.col(CHUNK) * F.lit(b)).cast("double")
    x = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in cols}
    # a chunk's sums as seen from its last position
    age = F.lit(float(b - 1)) - inside
    ends = []
    for i, (c, s) in enumerate(pairs):
        w = F.when(x[c].isNotNull(), F.pow(F.lit(decay(s)), age) if decay(s) > 0 else (age == 0).cast("double"))
        ends += [F.coalesce(F.sum(x[c] * w), F.lit(0.0)).alias(f"_s{i}"), F.coalesce(F.sum(w), F.lit(0.0)).alias(f"_w{i}")]
    newest = [F.max_by(x[c], F.when(x[c].isNotNull(), F.col(pos))).alias(f"_x{j}") for j, c in enumerate(cols)]
    ends = at.groupBy(*pc, CHUNK).agg(*ends, *newest)
    carry = _carry(ends, pc, [s for _, s in pairs], [cols.index(c) for c, _ in pairs], b)
    joined = null_safe_join(at, carry, [*pc, CHUNK])
    run = Window.partitionBy(*pc, CHUNK).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1 if exclude_current else 0)
    out = []
    for i, (c, s) in enumerate(pairs):
        d, name = decay(s), ema_name(None if single else c, s)
        before, weight = F.col(f"_m{i}"), F.col(f"_w{i}")
        if d > 0:
            # weights as seen from the chunk's first position, growing; the ratio is the same
            w = F.when(x[c].isNotNull(), F.pow(F.lit(1.0 / d), inside))
            top, all_ = F.sum(x[c] * w).over(run), F.sum(w).over(run)
            value = F.when(all_.isNull(), before).when(before.isNull(), top / all_).otherwise(
                (top + before * weight * F.lit(d)) / (all_ + weight * F.lit(d)))
        else:  # span 1: the last observation itself
            value = F.coalesce(F.last(x[c], ignorenulls=True).over(run), before)
        out.append(value.alias(name))
    new = {ema_name(None if single else c, s) for c, s in pairs}
    keep = [F.col(f"`{c}`") for c in base_cols if c not in new]
    return joined.select(*keep, *out)


def _scan(pdf: pd.DataFrame, at: np.ndarray, rows: float, d: np.ndarray, col_of: list[int], mean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """State (average, weight) before each of consecutive pieces ``at`` of ``rows`` positions, from the state before the
    first; the weight is as seen from the position before the piece."""
    n = len(d)
    top, all_ = pdf[[f"_s{i}" for i in range(n)]].to_numpy(float), pdf[[f"_w{i}" for i in range(n)]].to_numpy(float)
    newest = pdf[[f"_x{j}" for j in col_of]].to_numpy(float)
    out = np.empty((len(pdf), 2 * n))
    for k in range(len(pdf)):
        if k:  # pieces without a row lie between
            weight = weight * np.power(d, rows * (at[k] - at[k - 1] - 1))
        out[k] = np.concatenate([mean, weight])
        old = weight * np.power(d, rows)
        both = old + all_[k]
        with np.errstate(invalid="ignore", divide="ignore"):
            new = np.where(old > 0, (np.nan_to_num(mean) * old + top[k]) / both, top[k] / both)
        seen = ~np.isnan(newest[k])
        # an observation so old that its weight is 0 in doubles still is the last one
        mean = np.where(seen, np.where(both > 0, new, newest[k]), mean)
        weight = both
    return out


def _carry(ends: DataFrame, pc: list[str], spans: list[float], col_of: list[int], b: int) -> DataFrame:
    """For each chunk the average (``_m``, NULL before the first observation) and weight (``_w``) after the last
    position before it. A scan of two levels: blocks of ``SCAN_ROWS`` chunks are summed up as one piece each, the state is
    passed over the blocks of a series, and from there over the chunks inside each block."""
    d = np.array([decay(s) for s in spans])
    n, size = len(spans), SCAN_ROWS
    names = [f"_m{i}" for i in range(n)] + [f"_w{i}" for i in range(n)]
    kinds = {f.name: f.dataType.simpleString() for f in ends.schema.fields}
    keys = "".join(f"`{c}` {kinds[c]}, " for c in pc)
    states = ", ".join(f"{c} double" for c in names)

    def table(pdf: pd.DataFrame, at: str, out: np.ndarray) -> pd.DataFrame:
        values = pd.DataFrame(out, columns=names)
        values = values.astype(object).where(values.notna(), None) if values.isna().any().any() else values
        return pd.concat([pdf[[*pc, at]].reset_index(drop=True), values], axis=1)

    def over_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        return table(pdf, "_block", _scan(pdf, pdf["_block"].to_numpy(), float(b) * size, d, col_of, np.full(n, np.nan), np.zeros(n)))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CHUNK)
        at = pdf[CHUNK].to_numpy()
        mean, weight = pdf[[f"_m{i}" for i in range(n)]].iloc[0].to_numpy(float), pdf[[f"_v{i}" for i in range(n)]].iloc[0].to_numpy(float)
        weight = weight * np.power(d, float(b) * (at[0] % size))
        return table(pdf, CHUNK, _scan(pdf, at, float(b), d, col_of, mean, weight))

    at = ends.withColumn("_block", F.floor(F.col(CHUNK) / F.lit(size)))
    ages = ((F.col("_block") + 1) * size - 1 - F.col(CHUNK)).cast("double") * F.lit(float(b))
    seen = lambda i: F.pow(F.lit(float(d[i])), ages) if d[i] > 0 else (ages == 0).cast("double")
    sums = [F.sum(F.col(f"_{c}{i}") * seen(i)).alias(f"_{c}{i}") for i in range(n) for c in "sw"]
    newest = [F.max_by(f"_x{j}", F.when(F.col(f"_x{j}").isNotNull(), F.col(CHUNK))).alias(f"_x{j}") for j in sorted(set(col_of))]
    before = at.groupBy(*pc, "_block").agg(*sums, *newest).groupBy(*pc).applyInPandas(over_blocks, f"{keys}_block long, {states}")
    before = before.withColumnsRenamed({f"_w{i}": f"_v{i}" for i in range(n)})
    return null_safe_join(at, before, [*pc, "_block"]).groupBy(*pc, "_block").applyInPandas(inside, f"{keys}{CHUNK} {kinds[CHUNK]}, {states}")


def ema_state(df: DataFrame, col: str, spans: Sequence[int], partition_cols=("series_id",), order_col: str = "ds",
              pos_col: str | None = None) -> DataFrame:
    """(partition_cols, ``_es{span}``, ``_ew{span}``): both sums of each span as seen from a series' last row; one
    aggregate with map-side sums, every row counts."""
    pc = _cols(partition_cols)
    df, pos, _ = ensure_pos(df, pc, order_col, pos_col)
    ends = df.groupBy(*pc).agg(F.max(pos).alias("_end"))
    x = F.when(~F.isnan(F.col(col).cast("double")), F.col(col).cast("double"))
    aggs = []
    for s in spans:
        age = (F.col("_end") - F.col(pos)).cast("double")
        w = F.when(x.isNotNull(), F.pow(F.lit(decay(s)), age))
        aggs += [F.coalesce(F.sum(x * w), F.lit(0.0)).alias(f"_es{s}"), F.coalesce(F.sum(w), F.lit(0.0)).alias(f"_ew{s}")]
    return null_safe_join(df, ends, pc).groupBy(*pc).agg(*aggs)
