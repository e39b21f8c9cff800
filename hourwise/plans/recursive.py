"""Hour-by-hour recursive forecast (G10, intended semantics of D9).

After each step the prediction becomes the target of that hour, and the target features of the next hour
(``lag_k``, ``rolling_mean_nh``, ``rolling_std_nh``, ``ema_sh``) are recomputed from history + predictions.
Target features must have been built with ``exclude_current=True`` (lags always are), so a feature of hour t
never uses y(t).  Other regressors come from the future rows.

Plan: recursion is sequential in time, so the parallelism is across series.  A series needs its last rows (as many as
the largest lag or window; counted in rows, like the batch operators) and both sums of each EMA over all of its
history (``ema_state``); ``cogroup`` brings these, the future rows and the series' model row together.  Trend, seasons
and exogenous regressors of all future rows are computed at once; only the target features go step by step.

A missing regressor takes its last value in the series, else 0.  Series without a model row keep their rows, with NULL
predictions.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourwise.functions import time as tf
from hourwise.operators.ema import decay, ema_state
from hourwise.operators.joins import null_safe_join, with_constants
from hourwise.plans.model import NULL_ID, TWO_PI
from hourwise.plans.spec import ForecastSpec

_LAG = re.compile(r"^lag_(\d+)$")
_RM = re.compile(r"^rolling_mean_(\d+)h$")
_RS = re.compile(r"^rolling_std_(\d+)h$")
_EMA = re.compile(r"^ema_(\d+)h$")


def _target_feature(name: str):
    for kind, rx in (("lag", _LAG), ("mean", _RM), ("std", _RS), ("ema", _EMA)):
        m = rx.match(name)
        if m:
            return kind, int(m.group(1))
    return None


def _spans(spec: ForecastSpec) -> list[int]:
    return sorted({f[1] for f in map(_target_feature, spec.regressors) if f and f[0] == "ema"})


def tail_rows(spec: ForecastSpec) -> int:
    """Rows of history that lags and rolling windows of the next hour can reach."""
    return max([1, *(f[1] for f in map(_target_feature, spec.regressors) if f and f[0] != "ema")])


def design_blocks(model: dict, spec: ForecastSpec, hours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """numpy twin of ``model.design_columns``: trend and seasonal rows of all ``hours`` (epoch hours)."""
    t = (hours - model["t0"]) / (model["t1"] - model["t0"])
    hinges = np.maximum(0.0, t[:, None] - np.asarray(model["changepoints"], dtype=float)[None, :])
    trend = np.column_stack([np.ones(len(t)), t, hinges])
    seas = [f(TWO_PI * i / period * hours) for _, period, order in spec.seasonal_terms() for i in range(1, order + 1) for f in (np.sin, np.cos)]
    return trend, np.column_stack(seas) if seas else np.zeros((len(t), 0))


def _step_features(buf: list[float], ema_state: dict, names: list[str]) -> dict[str, float]:
    out = {}
    for n in names:
        kind, k = _target_feature(n)
        if kind == "lag":
            out[n] = buf[-k] if len(buf) >= k else np.nan
        elif kind in ("mean", "std"):
            w = np.asarray(buf[-k:], dtype=float)
            if len(w) < k or np.isnan(w).any():
                out[n] = np.nan
            else:
                out[n] = float(w.mean()) if kind == "mean" else (float(w.std(ddof=1)) if k > 1 else np.nan)
        else:
            s, wt = ema_state[k]
            out[n] = s / wt if wt > 0 else np.nan
    return out


def _ema_push(ema_state: dict, x: float) -> None:
    for span, (s, w) in list(ema_state.items()):
        d = decay(span)
        if np.isnan(x):
            ema_state[span] = (d * s, d * w)
        else:
            ema_state[span] = (d * s + x, d * w + 1.0)


OUT = ["ds", "yhat", "yhat_lower", "yhat_upper"]


def _recursive_fn(spec: ForecastSpec, series_col: str):
    regs = list(spec.regressors)
    target = [r for r in regs if _target_feature(r) is not None]
    spans = _spans(spec)
    n_trend, n_seas, _ = spec.blocks()
    z = spec.z()

    def fn(key, rows: pd.DataFrame, mdl: pd.DataFrame) -> pd.DataFrame:
        fut = rows[rows["_future"] == 1].sort_values("ds")
        if fut.empty:
            return pd.DataFrame(columns=[series_col, *OUT])
        if mdl.empty or mdl["beta"].iloc[0] is None:
            return pd.DataFrame({series_col: fut[series_col], "ds": fut["ds"], "yhat": None, "yhat_lower": None, "yhat_upper": None})
        m = mdl.iloc[0].to_dict()
        beta = np.asarray(m["beta"], dtype=float)
        mean, std = np.asarray(m["reg_mean"], dtype=float), np.asarray(m["reg_std"], dtype=float)
        hist = rows[rows["_future"] == 0].sort_values("ds")
        buf = hist["y"].to_numpy(dtype=float).tolist()
        state = {s: (float(hist[f"_es{s}"].iloc[0]), float(hist[f"_ew{s}"].iloc[0])) if len(hist) else (0.0, 0.0) for s in spans}
        trend, seas = design_blocks(m, spec, fut["_h"].to_numpy(dtype=float))
        trend, seas = trend @ beta[:n_trend], seas @ beta[n_trend:n_trend + n_seas]
        exo = {r: fut[r].astype(float).ffill().bfill().fillna(0.0).to_numpy() for r in regs if r not in target}
        weight = dict(zip(regs, beta[n_trend + n_seas:]))
        at = {r: i for i, r in enumerate(regs)}
        known = sum((weight[r] * (exo[r] - mean[at[r]]) / std[at[r]] for r in exo), np.zeros(len(fut)))
        last = dict.fromkeys(target, 0.0)
        out = np.empty(len(fut))
        for k in range(len(fut)):
            now = _step_features(buf, state, target)
            last.update((r, v) for r, v in now.items() if not np.isnan(v))
            reg = known[k] + sum(weight[r] * (last[r] - mean[at[r]]) / std[at[r]] for r in target)
            out[k] = trend[k] * (1.0 + seas[k] + reg) if spec.mode == "multiplicative" else trend[k] + seas[k] + reg
            out[k] *= float(m["y_scale"])
            buf.append(out[k])
            _ema_push(state, out[k])
        sig = z * float(m["sigma"]) * float(m["y_scale"])
        return pd.DataFrame({series_col: fut[series_col].to_numpy(), "ds": fut["ds"].to_numpy(), "yhat": out, "yhat_lower": out - sig, "yhat_upper": out + sig})

    return fn


def forecast_recursive(model: DataFrame, history: DataFrame, future: DataFrame, spec: ForecastSpec,
                       series_col: str = "series_id") -> DataFrame:
    """``history`` (series, ds, y) and ``future`` (series, ds, exogenous regressors) -> hourly predictions."""
    newest = Window.partitionBy(series_col).orderBy(F.col("ds").desc())
    hist = history.select(series_col, "ds", F.col("y").cast("double").alias("y"), F.lit(0).alias("_future"))
    tail = hist.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= tail_rows(spec)).drop("_n")
    spans = _spans(spec)
    if spans:
        tail = null_safe_join(tail, ema_state(hist, "y", spans, [series_col]), [series_col])
    exo = [r for r in spec.regressors if _target_feature(r) is None]
    fut = future.select(series_col, "ds", *[F.col(f"`{c}`").cast("double").alias(c) for c in exo],
                        F.lit(None).cast("double").alias("y"), F.lit(1).alias("_future"))
    rows = tail.unionByName(fut, allowMissingColumns=True).withColumn("_h", tf.epoch_hours("ds").cast("double"))
    rows = rows.withColumn("_sid", F.coalesce(F.col(series_col).cast("string"), F.lit(NULL_ID)))
    if spec.scope == "global":  # a pooled model still recurses per series: its one row goes to every series
        mdl = with_constants(rows.select("_sid").distinct(), model.drop("_sid"))
    else:
        mdl = model
    schema = f"{series_col} string, ds timestamp_ntz, yhat double, yhat_lower double, yhat_upper double"
    return rows.groupBy("_sid").cogroup(mdl.groupBy("_sid")).applyInPandas(_recursive_fn(spec, series_col), schema)
