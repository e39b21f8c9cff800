"""Recovery tests for the Gram fit, prediction, multiplicative mode and the recursive forecast."""

import datetime as dt
import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hourwise.plans import model as mdl
from hourwise.plans.recursive import forecast_recursive
from hourwise.plans.spec import ForecastSpec

FREE = dict(trend_prior_scale=None, changepoint_prior_scale=None, seasonality_prior_scale=None,
            regressor_prior_scale=None)


def _synthetic(spark, n=2000, series=("a", "b"), mult=False, noise=0.01, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k, s in enumerate(series):
        x = rng.normal(0, 1, n)
        for i in range(n):
            h = i
            t = i / (n - 1)
            trend = 10 + 2 * k + 3 * t
            season = 0.5 * math.sin(2 * math.pi * h / 24.0)
            reg = 0.8 * x[i]
            if mult:
                y = trend * (1 + 0.05 * math.sin(2 * math.pi * h / 24.0) + 0.02 * x[i])
            else:
                y = trend + season + reg
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(y + rng.normal(0, noise)), float(x[i])))
    return spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, y double, x1 double")


def test_additive_recovery_and_predict(spark):
    df = _synthetic(spark).repartition(12)
    spec = ForecastSpec(n_changepoints=0, weekly=0, daily=1, yearly=0, regressors=("x1",), **FREE)
    model = mdl.fit(df, spec)
    pred = mdl.predict(model, df, spec).join(df, ["series_id", "ds"])
    rmse = pred.select(F.sqrt(F.avg((F.col("y") - F.col("yhat")) ** 2))).first()[0]
    assert rmse < 0.02
    coefs = {(r["series_id"], r["term"]): r["coef"] for r in mdl.coefficients(model).collect()}
    scale = {r["_sid"]: r["y_scale"] for r in model.collect()}
    # slope 3 per unit of scaled time, daily sine amplitude 0.5
    for s in ("a", "b"):
        assert abs(coefs[(s, "trend_k")] * scale[s] - 3.0) < 0.05
        assert abs(coefs[(s, "daily_sin_1")] * scale[s] - 0.5) < 0.02


def test_gram_tree_levels_equal_single_level(spark, monkeypatch):
    df = _synthetic(spark, n=300, series=("a",))
    spec = ForecastSpec(n_changepoints=2, weekly=0, daily=1, yearly=0, **FREE)
    stats = mdl.history_stats(df, spec)
    design = mdl.design_frame(df, stats, spec)
    p = len(spec.term_names())
    one = mdl.gram(design.coalesce(1), p).first()
    monkeypatch.setattr(mdl, "FANIN", 2)
    many = mdl.gram(design.repartition(16), p).first()
    assert np.allclose(one["xtx"], many["xtx"]) and np.allclose(one["xty"], many["xty"]) and one["n"] == many["n"]


def test_multiplicative_recovery(spark):
    df = _synthetic(spark, n=1500, series=("a",), mult=True, noise=0.005)
    spec = ForecastSpec(mode="multiplicative", n_changepoints=0, weekly=0, daily=1, yearly=0, regressors=("x1",), **FREE)
    model = mdl.fit(df, spec)
    pred = mdl.predict(model, df, spec).join(df, ["series_id", "ds"])
    rmse = pred.select(F.sqrt(F.avg((F.col("y") - F.col("yhat")) ** 2))).first()[0]
    assert rmse < 0.02


def test_recursive_matches_hand_recurrence(spark):
    """Model with only lag_1: y(t) = m + k t + b * lag_1 -> the recursion can be replayed by hand."""
    rng = np.random.default_rng(3)
    n = 400
    y = [5.0]
    for _ in range(n - 1):
        y.append(float(2.0 + 0.6 * y[-1] + rng.normal(0, 0.01)))
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), y[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, y double")
    from hourwise.operators.ordered import add_lags

    feats = add_lags(df, "y", [1]).na.drop()
    spec = ForecastSpec(n_changepoints=0, weekly=0, daily=0, yearly=0, regressors=("lag_1",), **FREE)
    hist = feats.filter(F.col("ds") < dt.datetime(2024, 1, 1) + dt.timedelta(hours=350))
    model = mdl.fit(hist, spec)
    m = model.first()
    fut = df.filter(F.col("ds") >= dt.datetime(2024, 1, 1) + dt.timedelta(hours=350)).select("series_id", "ds")
    got = forecast_recursive(model, df.filter(F.col("ds") < dt.datetime(2024, 1, 1) + dt.timedelta(hours=350)), fut, spec)
    got = got.orderBy("ds").toPandas()
    beta = np.asarray(m["beta"])
    last = y[349]
    exp = []
    for i in range(350, n):
        t = (i - m["t0"] + (dt.datetime(2024, 1, 1) - dt.datetime(1970, 1, 1)).total_seconds() / 3600 * 0)
        hour = (dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) - dt.datetime(1970, 1, 1)).total_seconds() / 3600
        tt = (hour - m["t0"]) / (m["t1"] - m["t0"])
        z = (last - m["reg_mean"][0]) / m["reg_std"][0]
        yh = (beta[0] + beta[1] * tt + beta[2] * z) * m["y_scale"]
        exp.append(yh)
        last = yh
    assert np.allclose(got["yhat"].to_numpy(), np.asarray(exp), atol=1e-9)
    # the recursion converges to the fixed point of y = 2 + 0.6 y
    assert abs(got["yhat"].iloc[-1] - 5.0) < 0.05


def test_future_frame_guards_and_auto_training(spark):
    import pytest

    from hourwise.plans import workflows as wf

    df = _synthetic(spark, n=300, series=("a",))
    spec = ForecastSpec(n_changepoints=0, weekly=0, daily=1, yearly=0, regressors=("x1", "missing_col"), **FREE)
    with pytest.raises(KeyError):
        wf.check_regressors(spec, df)  # G9: every regressor must be present
    with pytest.raises(ValueError):
        wf.prepare_future(df, "2030-01-01 00:00:00", "2030-01-02 00:00:00", ["x1"], check_non_empty=True)
    model, chosen_spec, scores = wf.train(df, ForecastSpec(n_changepoints=0, weekly=0, daily=1, yearly=0, **FREE),
                                          threshold=0.0, top=2)
    assert "x1" in chosen_spec.regressors and model.count() == 1 and scores.count() >= 1
