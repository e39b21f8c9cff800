"""Literal frames with the pandas semantics of the reference (FIXTURES.md section 3)."""

import datetime as dt
import math

import pandas as pd
from pyspark.sql import functions as F

from hourwise.functions import time as tf
from hourwise.operators import calendar as cal
from hourwise.operators import ordered as ordd
from hourwise.operators.ema import add_ema

NAN = None


def _series(spark, values):
    rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, y double")


def _col(df, name):
    return [r[name] for r in df.orderBy("ds").collect()]


def _close(a, b, tol=1e-6):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        if y is None:
            assert x is None, (a, b)
        else:
            assert x is not None and abs(x - y) < tol, (a, b)


def test_round_hour_ties_to_even(spark):
    vals = ["2024-01-01 00:30:00", "2024-01-01 01:30:00", "2024-01-01 01:29:59.999999", "2024-01-01 23:30:00"]
    df = spark.createDataFrame([(v,) for v in vals], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = [r[0] for r in df.select(tf.round_hour("t")).collect()]
    assert got == [dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 1, 2), dt.datetime(2024, 1, 1, 1),
                   dt.datetime(2024, 1, 2, 0)]


def test_ema_span3_with_gaps(spark):
    df = add_ema(_series(spark, [NAN, 1, 2, NAN, 4, 5]), "y", [3])
    _close(_col(df, "ema_3h"), [None, 1.0, 1.666667, 1.666667, 3.363636, 4.333333])


def test_rolling_mean_2_and_std_1(spark):
    df = ordd.add_rolling(_series(spark, [NAN, 1, 2, NAN, 4, 5]), "y", [1, 2])
    _close(_col(df, "rolling_mean_2h"), [None, None, 1.5, None, None, 4.5])
    assert all(v is None for v in _col(df, "rolling_std_1h"))


def test_linear_interpolation_ends(spark):
    df = ordd.interpolate_linear(_series(spark, [NAN, 1, NAN, 3, NAN]), ["y"])
    _close(_col(df, "y"), [None, 1.0, 2.0, 3.0, 3.0])


def test_calendar_parts(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 12, 30),)], "ds timestamp_ntz")
    rows = cal.calendar_features(df).orderBy("ds").collect()
    assert rows[0]["day_of_week"] == 0 and rows[0]["is_weekend"] == 0
    assert rows[1]["week_of_year"] == 1 and rows[1]["quarter"] == 4


def test_ema_matches_pandas_random(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vals = rng.normal(50, 10, 300)
    vals[rng.random(300) < 0.1] = np.nan
    vals[:3] = np.nan
    df = add_ema(_series(spark, [None if math.isnan(v) else float(v) for v in vals]), "y", [2, 12, 24])
    pdf = df.orderBy("ds").toPandas()
    for s in (2, 12, 24):
        exp = pd.Series(vals).ewm(span=s).mean()
        got = pdf[f"ema_{s}h"].astype(float)
        assert ((got - exp).abs().fillna(0) < 1e-9).all()
        assert (got.isna() == exp.isna()).all()
