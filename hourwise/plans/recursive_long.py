"""Recursive forecast over horizons of any length (G10), without a series being one task.

One hour's prediction is an affine function of the state, the last hours' targets and the sums of each EMA: lags and means
are linear in it, an EMA is its sum over a weight that time alone decides, and the known part (trend, seasons, exogenous
regressors) is a constant of the hour. So the hours of a block are one affine map of the state before it, whatever that is.

The first block is forecast hour by hour from the history (missing values and short histories matter there only). For all
later blocks their maps are built side by side; one pass over a series' maps, one row a block, gives the state before each
block; then all blocks are forecast side by side from their states.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourwise.functions import time as tf
from hourwise.operators.ema import decay, ema_state
from hourwise.operators.joins import null_safe_join, with_constants
from hourwise.operators.ordered import DEFAULT_CHUNK, ffill_bfill, seq_index
from hourwise.plans.model import NULL_ID
from hourwise.plans.recursive import _ema_push, _recursive_fn, _spans, _target_feature, design_blocks, tail_rows
from hourwise.plans.spec import ForecastSpec
from hourwise.session import cut_lineage


class _Hours:
    """What the hours of a block add, whatever the state: prediction = base + sum of (factor * weight * feature)."""

    def __init__(self, rows: pd.DataFrame, m: dict, spec: ForecastSpec):
        regs = list(spec.regressors)
        n_trend, n_seas, _ = spec.blocks()
        beta = np.asarray(m["beta"], dtype=float)
        mean, std = np.asarray(m["reg_mean"], dtype=float), np.asarray(m["reg_std"], dtype=float)
        weight = beta[n_trend + n_seas:] / std if regs else np.zeros(0)
        trend, seas = design_blocks(m, spec, rows["_h"].to_numpy(dtype=float))
        trend, seas = trend @ beta[:n_trend], seas @ beta[n_trend:n_trend + n_seas]
        known = -float(weight @ mean) if regs else 0.0
        for i, r in enumerate(regs):
            if _target_feature(r) is None:
                known = known + weight[i] * rows[r].to_numpy(dtype=float)
        scale = float(m["y_scale"])
        self.base = scale * (trend * (1.0 + seas + known) if spec.mode == "multiplicative" else trend + seas + known)
        self.factor = scale * (trend if spec.mode == "multiplicative" else np.ones(len(trend)))
        self.features = [(*_target_feature(r), weight[i]) for i, r in enumerate(regs) if _target_feature(r) is not None]
        self.noise = spec.z() * float(m["sigma"]) * scale


def _go(hours: _Hours, last: np.ndarray, sums: np.ndarray, weights: np.ndarray, spans: list[int], fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(targets of the hours after those of ``last``, sums after them) for several states at once, one a column; ``fixed``
    says which columns take the known part."""
    n, size = len(hours.base), len(last)
    y = np.concatenate([last, np.empty((n, last.shape[1]))])
    sums, weights = sums.copy(), weights.copy()
    decays = np.array([decay(s) for s in spans])
    place = {s: i for i, s in enumerate(spans)}
    for t in range(n):
        at, total = size + t, np.zeros(last.shape[1])
        for kind, k, w in hours.features:
            if kind == "lag":
                total += w * y[at - k]
            elif kind == "mean":
                total += w * y[at - k: at].mean(axis=0)
            else:
                total += w * sums[place[k]] / weights[place[k]]
        y[at] = hours.factor[t] * total + hours.base[t] * fixed
        if spans:
            sums = decays[:, None] * sums + y[at]
            weights = decays * weights + 1.0
    return y[size:], sums


def _weights(first: np.ndarray, spans: list[int], hours: float) -> np.ndarray:
    """EMA weights ``hours`` after those of ``first``."""
    d = np.array([decay(s) for s in spans])
    gone = np.power(d, hours)
    return first * gone + (1.0 - gone) / (1.0 - d) if len(spans) else first


def forecast_recursive_long(model: DataFrame, history: DataFrame, future: DataFrame, spec: ForecastSpec,
                            series_col: str = "series_id", block: int = DEFAULT_CHUNK) -> DataFrame:
    """``forecast_recursive`` (the same rows and values) with the horizon cut into blocks of ``block`` hours that are
    forecast side by side. Rolling standard deviations aren't affine and are refused; a series without a model row keeps its
    rows with NULL predictions; a NULL series is a series."""
    if any(f and f[0] == "std" for f in map(_target_feature, spec.regressors)):
        raise ValueError("a rolling standard deviation of the target isn't affine: use forecast_recursive")
    size, spans = tail_rows(spec), _spans(spec)
    block = max(int(block), size)
    exo = [r for r in spec.regressors if _target_feature(r) is None]
    sid = F.coalesce(F.col(series_col).cast("string"), F.lit(NULL_ID)).alias("_sid")
    hist = history.select(series_col, "ds", F.col("y").cast("double").alias("y"), F.lit(0).alias("_future"))
    newest = Window.partitionBy(series_col).orderBy(F.col("ds").desc())
    tail = hist.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= size).drop("_n")
    if spans:
        tail = null_safe_join(tail, ema_state(hist, "y", spans, [series_col]), [series_col])
    fut = future.select(series_col, "ds", *[F.col(f"`{c}`").cast("double").alias(c) for c in exo])
    fut = seq_index(fut, [series_col], "ds", out="_i")
    if exo:
        fut = _filled(fut, exo, series_col)
    fut = fut.withColumns({"_h": tf.epoch_hours("ds").cast("double"), "_block": F.floor(F.col("_i") / F.lit(block)), "_future": F.lit(1), "y": F.lit(None).cast("double")})
    fut = cut_lineage(fut, "horizon")
    mdl = with_constants(fut.select(sid).distinct(), model.drop("_sid")) if spec.scope == "global" else model
    mdl = cut_lineage(mdl.select("_sid", "beta", "sigma", "t0", "t1", "y_scale", "reg_mean", "reg_std", "changepoints"), "horizon-models")
    out_schema = f"{series_col} string, ds timestamp_ntz, yhat double, yhat_lower double, yhat_upper double"
    step_by_step = _recursive_fn(spec, series_col)

    def first_block(key, rows: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        out = step_by_step(key, rows, m)
        out["_state"] = None
        if len(out) == block and out["yhat"].notna().all():
            old = rows[rows["_future"] == 0].sort_values("ds")
            sums = {s: (float(old[f"_es{s}"].iloc[0]), float(old[f"_ew{s}"].iloc[0])) if len(old) else (0.0, 0.0) for s in spans}
            for v in out["yhat"]:
                _ema_push(sums, float(v))
            state = [*out["yhat"].to_numpy(float)[-size:], *(sums[s][0] for s in spans), *(sums[s][1] for s in spans)]
            out["_state"] = [None] * (block - 1) + [state]
        return out

    rows = tail.unionByName(fut.filter(F.col("_block") == 0).drop("_block", "_i"), allowMissingColumns=True).withColumn("_h", F.coalesce("_h", F.lit(0.0))).withColumn("_sid", sid)
    began = cut_lineage(rows.groupBy("_sid").cogroup(mdl.groupBy("_sid")).applyInPandas(first_block, out_schema + ", _state array<double>"), "horizon-first")
    states = began.filter(F.col("_state").isNotNull()).select(sid, F.col("_state").alias("_first"))
    later = fut.filter(F.col("_block") > 0).withColumn("_sid", sid)
    models = mdl.join(states, "_sid", "left")
    dims = size + len(spans)

    def block_map(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, m = pdf.sort_values("_i"), pdf.iloc[0].to_dict()
        first = np.asarray(m["_first"], dtype=float)
        weights = _weights(first[dims:], spans, float(block) * (m["_block"] - 1))
        start = np.eye(dims, dims + 1)
        y, sums = _go(_Hours(pdf, m, spec), start[:size], start[size:], weights, spans, np.eye(1, dims + 1, dims)[0])
        both = np.concatenate([np.concatenate([start[:size], y])[-size:], sums])
        return pd.DataFrame({"_sid": [m["_sid"]], "_block": [m["_block"]], "_map": [both.ravel()], "_first": [first]})

    def over_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("_block"), []
        state = np.asarray(pdf["_first"].iloc[0], dtype=float)[:dims]
        for m in pdf["_map"]:
            out.append(state)
            a = np.asarray(m, dtype=float).reshape(dims, dims + 1)
            state = a[:, :-1] @ state + a[:, -1]
        return pd.DataFrame({"_sid": pdf["_sid"], "_block": pdf["_block"], "_before": out})

    def forecast(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, m = pdf.sort_values("_i"), pdf.iloc[0].to_dict()
        if m["_before"] is None or m["beta"] is None:
            return pd.DataFrame({series_col: pdf[series_col], "ds": pdf["ds"], "yhat": None, "yhat_lower": None, "yhat_upper": None})
        state, hours = np.asarray(m["_before"], dtype=float)[:, None], _Hours(pdf, m, spec)
        weights = _weights(np.asarray(m["_first"], dtype=float)[dims:], spans, float(block) * (m["_block"] - 1))
        y, _ = _go(hours, state[:size], state[size:], weights, spans, np.ones(1))
        return pd.DataFrame({series_col: pdf[series_col].to_numpy(), "ds": pdf["ds"].to_numpy(), "yhat": y[:, 0], "yhat_lower": y[:, 0] - hours.noise, "yhat_upper": y[:, 0] + hours.noise})

    known = later.join(models, "_sid", "left")
    maps = known.filter(F.col("_first").isNotNull()).groupBy("_sid", "_block").applyInPandas(block_map, "_sid string, _block long, _map array<double>, _first array<double>")
    before = cut_lineage(cut_lineage(maps, "horizon-maps").groupBy("_sid").applyInPandas(over_blocks, "_sid string, _block long, _before array<double>"), "horizon-states")
    rest = known.join(before, ["_sid", "_block"], "left").groupBy("_sid", "_block").applyInPandas(forecast, out_schema)
    return began.drop("_state").unionByName(rest)


def _filled(fut: DataFrame, exo: list[str], series_col: str) -> DataFrame:
    """A missing regressor takes its last value in the series, else its next, else 0."""
    clean = fut.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in exo})
    return ffill_bfill(clean, exo, partition_cols=[series_col], pos_col="_i").fillna(0.0, subset=exo)
