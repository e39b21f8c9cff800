"""One test for each silent fault that a review found."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourwise.operators.ema import add_ema
from hourwise.operators.joins import attach_features
from hourwise.operators.missing import regularize
from hourwise.operators.ordered import add_lags
from hourwise.plans import model as mdl
from hourwise.plans.recursive import forecast_recursive
from hourwise.plans.spec import CONFIG_A, CONFIG_B, ForecastSpec

H = dt.timedelta(hours=1)
T0 = dt.datetime(2024, 1, 1)
FREE = ForecastSpec(n_changepoints=0, yearly=0, weekly=0, daily=0, trend_prior_scale=None, changepoint_prior_scale=None,
                    seasonality_prior_scale=None, regressor_prior_scale=None)


def _series(spark, rows, schema="series_id string, ds timestamp_ntz, y double"):
    return spark.createDataFrame(rows, schema)


def test_dedupe_keeps_an_existing_row(spark):
    base = _series(spark, [("s", T0, 1.0)])
    feats = spark.createDataFrame([("s", T0, 1.0, 20.0), ("s", T0, 2.0, 10.0)], "series_id string, ds timestamp_ntz, a double, b double")
    r = attach_features(base, feats, dedupe=True).first()
    assert (r["a"], r["b"]) == (1.0, 20.0)


def test_regularize_loses_no_row(spark):
    rows = [("s", T0, 1.0), ("s", T0 + 1.5 * H, 2.0), ("s", T0 + 3 * H, 4.0), ("s", T0 + 3 * H, 6.0), ("s", None, 9.0)]
    with pytest.raises(Exception, match="3 rows are off the hour"):
        regularize(_series(spark, rows)).collect()
    got = {r["ds"]: r["y"] for r in regularize(_series(spark, rows), off_grid="aggregate").collect()}
    assert got == {T0: 1.0, T0 + H: None, T0 + 2 * H: 2.0, T0 + 3 * H: 5.0}


@pytest.mark.parametrize("exclude", [False, True])
def test_ema_never_forgets(spark, exclude):
    rng = np.random.default_rng(0)
    y = np.ones(5000)
    y[0] = 1e25
    z = rng.normal(size=5000)
    z[rng.random(5000) < 0.2] = np.nan
    z[1000:3500] = np.nan
    z[:5] = np.nan
    rows = [("a", T0 + i * H, float(v)) for i, v in enumerate(y)] + [("b", T0 + i * H, None if np.isnan(v) else float(v)) for i, v in enumerate(z)]
    got = add_ema(_series(spark, rows), "y", [1, 3, 168], chunk=64, exclude_current=exclude).toPandas().sort_values(["series_id", "ds"])
    for s, v in (("a", y), ("b", z)):
        own = got[got["series_id"] == s]
        for span in (1, 3, 168):
            want = pd.Series(v).ewm(span=span).mean()
            want = want.shift(1) if exclude else want
            have = own[f"ema_{span}h"].astype(float).to_numpy()
            assert np.allclose(have, want, rtol=1e-9, equal_nan=True), (s, span)


def test_one_partial_per_series_and_task(spark):
    n = 1500
    df = spark.range(6000).select((F.col("id") % n).cast("string").alias("_sid"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("x"),
                                  F.rand(1).alias("y_s")).repartition(3)
    parts = df.sortWithinPartitions("_sid").mapInPandas(mdl._partial_gram_fn(2), mdl.GRAM_SCHEMA).withColumn("p", F.spark_partition_id())
    assert parts.groupBy("_sid", "p").count().filter("count > 1").count() == 0
    assert mdl.gram(df, 2).count() == n


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_pooled_models_join_nothing(spark, threshold):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = _series(spark, [(s, T0 + i * H, float(i % 5)) for s in "ab" for i in range(60)])
        from dataclasses import replace

        spec = replace(FREE, scope="global", regressors=("lag_1",))
        hist = add_lags(df, "y", [1]).na.drop()
        model = mdl.fit(hist, spec)
        fc = mdl.predict(model, hist.drop("y"), spec)
        rec = forecast_recursive(model, df, df.select("series_id", F.timestamp_add("HOUR", F.lit(60), "ds").alias("ds")), spec)
        for x in (model, fc, rec):
            assert not any(k in _plan(x) for k in ("CartesianProduct", "BroadcastNestedLoopJoin"))
        assert fc.count() == hist.count() and rec.count() == 120
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_building_a_fit_runs_no_job(spark):
    df = _series(spark, [("s", T0 + i * H, float(i)) for i in range(50)])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    mdl.fit(df, FREE)
    assert not tracker.getJobIdsForGroup("build")


def test_series_without_a_model_stay(spark):
    df = _series(spark, [("a", T0 + i * H, float(i)) for i in range(30)])
    both = df.drop("y").unionByName(df.drop("y").withColumn("series_id", F.lit("new")))
    model = mdl.fit(df, FREE)
    got = mdl.predict(model, both, FREE)
    assert got.count() == 60 and got.filter("yhat IS NULL").count() == 30
    assert [r[0] for r in mdl.without_model(model, both).collect()] == ["new"]
    rec = forecast_recursive(model, df, both, FREE)
    assert rec.count() == 60 and rec.filter("series_id = 'new' AND yhat IS NULL").count() == 30


@pytest.mark.parametrize("features", [("lag_24",), ("lag_1", "rolling_mean_3h", "ema_12h")])
def test_recursion_with_missing_hours_equals_a_replay(spark, features):
    hours = [i for i in range(200) if i % 6]
    y = {i: float((i * 7) % 11) for i in hours}
    df = _series(spark, [("s", T0 + i * H, y[i]) for i in hours])
    from dataclasses import replace

    from hourwise.plans.workflows import target_features

    spec = replace(FREE, regressors=features)
    hist = target_features(df, "y", (1, 24), (3,), (12,)).na.drop()
    model = mdl.fit(hist, spec)
    fut = _series(spark, [("s", T0 + (200 + i) * H, None) for i in range(6)])
    got = [r["yhat"] for r in forecast_recursive(model, df, fut.drop("y"), spec).orderBy("ds").collect()]
    rows = [("s", T0 + i * H, y[i]) for i in hours]
    for k in range(6):  # a row by row replay with the batch operators
        now = rows + [("s", T0 + (200 + k) * H, None)]
        x = target_features(_series(spark, now), "y", (1, 24), (3,), (12,)).filter(F.col("y").isNull())
        yhat = mdl.predict(model, x, spec).first()["yhat"]
        assert abs(yhat - got[k]) < 1e-9
        rows.append(("s", T0 + (200 + k) * H, yhat))


def test_filled_hours_are_no_actuals(spark):
    from hourwise.plans.workflows import train_then_forecast

    df = regularize(_series(spark, [("s", T0 + i * H, float(i % 3)) for i in range(100) if i % 7]))
    df = df.fillna(5.0, ["y"])
    _, m = train_then_forecast(df, FREE, T0 + 60 * H, T0 + 99 * H, ())
    assert m.first()["n"] == sum(1 for i in range(61, 100) if i % 7)


def test_binary_regressors_are_zero_or_one(spark):
    df = spark.createDataFrame([("s", T0 + i * H, float(i), float(i % 2), 0.2 + 0.5 * (i % 2)) for i in range(20)],
                               "series_id string, ds timestamp_ntz, y double, flag double, level double")
    r = mdl.history_stats(df, FREE.with_regressors(["flag", "level"])).first()
    assert list(r["reg_mean"])[0] == 0.0 and abs(list(r["reg_mean"])[1] - 0.45) < 1e-9


def test_configurations_run_as_they_are(spark):
    rng = np.random.default_rng(2)
    days = [T0 + 24 * i * H for i in range(900)]
    y = [10 + 0.01 * i + np.sin(2 * np.pi * i / 365.25) + rng.normal(0, 0.05) for i in range(900)]
    df = _series(spark, [("s", d, float(v)) for d, v in zip(days, y)])
    for spec in (CONFIG_A, CONFIG_B):
        model = mdl.fit(df, spec)
        r = model.first()
        assert r["converged"] is not None and len(r["beta"]) == len(spec.term_names())
        fc = mdl.predict(model, df.drop("y"), spec).toPandas().sort_values("ds")
        assert np.sqrt(np.mean((fc["yhat"].to_numpy(float) - y) ** 2)) < 0.3


def test_multiplicative_fit_meets_its_normal_equations(spark):
    """At the fitted parameters the gradient of squared error plus ridge is near 0."""
    from dataclasses import replace

    rng = np.random.default_rng(5)
    n = 600
    hours = np.arange(n)
    y = (5 + 0.01 * hours) * (1 + 0.3 * np.sin(2 * np.pi * hours / 24)) + rng.normal(0, 0.05, n)
    df = _series(spark, [("s", T0 + int(i) * H, float(v)) for i, v in zip(hours, y)])
    spec = replace(FREE, mode="multiplicative", daily=2, tol=1e-12)
    model = mdl.fit(df, spec)
    r = model.first()
    x = mdl.design_frame(df, mdl.history_stats(df, spec), spec).toPandas().sort_values("ds")
    a, f = np.stack(x["trend_x"]), np.stack(x["seas_x"])
    beta = np.array(r["beta"])
    g, s = a @ beta[:2], 1 + f @ beta[2:]
    res = x["y_s"].to_numpy() - g * s
    grad = np.concatenate([(a * s[:, None]).T @ res, (f * g[:, None]).T @ res])
    assert np.abs(grad).max() < 1e-5 * n and r["converged"]


def test_lasso_with_one_feature_is_a_soft_threshold(spark):
    from hourwise.operators.mlselect import lasso_cv

    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    y = 0.3 * x + rng.normal(size=200)
    df = spark.createDataFrame([(T0 + i * H, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "ds timestamp_ntz, x double, y double")
    r = lasso_cv(df, ["x"], folds=10).first()
    c, v = ((x - x.mean()) * (y - y.mean())).mean(), ((x - x.mean()) ** 2).mean()
    alphas = np.logspace(np.log10(abs(c)), np.log10(abs(c) * 1e-3), 100)
    mse = np.zeros(100)
    for k in range(10):
        out = np.zeros(200, bool)
        out[20 * k: 20 * (k + 1)] = True
        xt, yt = x[~out], y[~out]
        ct, vt = ((xt - xt.mean()) * (yt - yt.mean())).mean(), ((xt - xt.mean()) ** 2).mean()
        b = np.sign(ct) * np.maximum(abs(ct) - alphas, 0) / vt
        pred = yt.mean() + (x[out][:, None] - xt.mean()) * b
        mse += ((y[out][:, None] - pred) ** 2).mean(0)
    best = alphas[mse.argmin()]
    assert abs(r["alpha"] - best) < 1e-9 and abs(r["coef"] - np.sign(c) * max(abs(c) - best, 0) / v) < 1e-6


def test_forest_ranks(spark):
    from hourwise.operators.mlselect import rfe_forest

    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(c), float(3 * a + 0.5 * b)) for a, b, c in rng.normal(size=(300, 3))]
    got = {r["feature"]: r["rank"] for r in rfe_forest(spark.createDataFrame(rows, "a double, b double, c double, y double"), ["a", "b", "c"], "y", n_select=1, num_trees=10, max_depth=4).collect()}
    assert got == {"a": 1, "b": 2, "c": 3}


def test_existing_session_settings_stay(spark):
    from hourwise.session import get_session, shared_dir

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        assert get_session("local[2]") is not None and spark.conf.get("spark.sql.shuffle.partitions") == "5"
        assert shared_dir(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
