"""Chunked (halo / carry) execution equals plain windows and pandas on gappy data, several chunk sizes."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from hourwise.operators import ordered as ordd
from hourwise.operators.ema import add_ema


def _panel(spark, seed, n=400, series=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(series):
        hours = np.sort(rng.choice(np.arange(n * 2), size=n, replace=False))
        for h in hours:
            v = float(rng.normal(10 * (s + 1), 3))
            rows.append((f"s{s}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(h)), None if rng.random() < 0.08 else v))
    return spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, y double")


def _pdf(df, cols):
    return df.select("series_id", "ds", *cols).toPandas().sort_values(["series_id", "ds"]).reset_index(drop=True)


def _same(a, b, cols, tol=1e-9):
    for c in cols:
        x, y = a[c].astype(float), b[c].astype(float)
        assert (x.isna() == y.isna()).all(), c
        assert ((x - y).abs().fillna(0) < tol).all(), c


@pytest.mark.parametrize("seed,chunk", [(1, 7), (2, 16), (3, 64)])
def test_lags_rolling_equivalence(spark, seed, chunk):
    df = _panel(spark, seed)
    cols = ["lag_1", "lag_5", "rolling_mean_3h", "rolling_std_3h", "rolling_mean_10h", "rolling_std_10h"]
    plain = ordd.add_history_features(df, "y", [1, 5], [3, 10], mode="plain")
    chunked = ordd.add_history_features(df, "y", [1, 5], [3, 10], chunk=chunk)
    _same(_pdf(plain, cols), _pdf(chunked, cols), cols)


@pytest.mark.parametrize("seed,chunk", [(4, 5), (5, 32)])
def test_fills_and_interpolation_equivalence(spark, seed, chunk):
    df = _panel(spark, seed)
    for fn in (ordd.ffill, ordd.bfill, ordd.ffill_bfill, ordd.interpolate_linear):
        a = _pdf(fn(df, ["y"], mode="plain"), ["y"])
        b = _pdf(fn(df, ["y"], chunk=chunk), ["y"])
        _same(a, b, ["y"])


def test_fill_matches_pandas(spark):
    df = _panel(spark, 6)
    got = _pdf(ordd.interpolate_linear(df, ["y"], chunk=9), ["y"])
    src = _pdf(df, ["y"])
    exp = src.groupby("series_id")["y"].transform(lambda s: s.interpolate(method="linear"))
    assert ((got["y"] - exp).abs().fillna(0) < 1e-9).all() and (got["y"].isna() == exp.isna()).all()


def test_ema_multi_chunk_matches_pandas(spark):
    df = _panel(spark, 7, n=600, series=2)
    got = _pdf(add_ema(df, "y", [3], chunk=8), ["ema_3h"])  # B = 64 rows: ~10 chunks per series
    src = _pdf(df, ["y"])
    exp = src.groupby("series_id")["y"].transform(lambda s: s.ewm(span=3).mean())
    assert ((got["ema_3h"] - exp).abs().fillna(0) < 1e-9).all() and (got["ema_3h"].isna() == exp.isna()).all()


def test_seq_index_small_buckets(spark):
    df = _panel(spark, 8)
    a = _pdf(ordd.seq_index(df, bucket_rows=5), ["seq"])
    c = _pdf(ordd.seq_index(df, bucket_width=3.0), ["seq"])
    assert (c["seq"] == a["seq"]).all()
    b = _pdf(ordd.seq_index(df, mode="plain"), ["seq"])
    assert (a["seq"] == b["seq"]).all()


def test_no_future_leak(spark):
    """A feature at hour t does not change when later rows change."""
    df = _panel(spark, 9, n=200, series=1)
    cut = df.agg({"ds": "max"}).first()[0] - dt.timedelta(hours=30)
    from pyspark.sql import functions as F

    changed = df.withColumn("y", F.when(F.col("ds") > F.lit(cut), F.col("y") * 100).otherwise(F.col("y")))
    f1 = _pdf(add_ema(ordd.add_history_features(df, "y", [1], [5]), "y", [12]).filter(F.col("ds") <= F.lit(cut)),
              ["lag_1", "rolling_mean_5h", "ema_12h"])
    f2 = _pdf(add_ema(ordd.add_history_features(changed, "y", [1], [5]), "y", [12]).filter(F.col("ds") <= F.lit(cut)),
              ["lag_1", "rolling_mean_5h", "ema_12h"])
    _same(f1, f2, ["lag_1", "rolling_mean_5h", "ema_12h"])


def test_features_between_equals_full_computation(spark):
    """Range-restricted features with a look-back margin equal the full computation on a regular grid."""
    import datetime as dt

    from pyspark.sql import functions as F

    from hourwise.operators.missing import regularize

    df = regularize(_panel(spark, 10, n=300), flag=None)
    lo, hi = "2024-01-10 00:00:00", "2024-01-15 00:00:00"

    def build(d):
        return add_ema(ordd.add_history_features(d, "y", [1, 24], [6]), "y", [3])

    look = 24 + 60  # the EMA of span 3 halves a weight each row: 60 rows leave less than 1e-18
    got = _pdf(ordd.features_between(df, lo, hi, build, look), ["lag_24", "rolling_mean_6h", "ema_3h"])
    full = build(df).filter((F.col("ds") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ds") <= F.lit(hi).cast("timestamp_ntz")))
    exp = _pdf(full, ["lag_24", "rolling_mean_6h", "ema_3h"])
    assert len(got) == len(exp) > 0
    _same(got, exp, ["lag_24", "rolling_mean_6h"])
    _same(got, exp, ["ema_3h"], tol=1e-12)


def test_long_gap_across_many_chunks(spark):
    """A missing run spanning several chunks: fills, interpolation and EMA carry across empty chunks."""
    import datetime as dt
    import math

    vals = [float(i % 7) for i in range(40)] + [None] * 200 + [float(i % 5) for i in range(40)]  # > 3 EMA chunks
    rows = [("s", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, y double")
    src = pd.Series([np.nan if v is None else v for v in vals])
    for fn, exp in ((ordd.ffill, src.ffill()), (ordd.bfill, src.bfill()),
                    (ordd.interpolate_linear, src.interpolate(method="linear"))):
        got = _pdf(fn(df, ["y"], chunk=8), ["y"])["y"].astype(float)
        assert ((got - exp).abs().fillna(0) < 1e-9).all() and (got.isna() == exp.isna()).all(), fn.__name__
    got = _pdf(add_ema(df, "y", [3], chunk=4), ["ema_3h"])["ema_3h"].astype(float)
    exp = src.ewm(span=3).mean()
    assert ((got - exp).abs().fillna(0) < 1e-9).all() and (got.isna() == exp.isna()).all()


@pytest.mark.parametrize("chunk", [6, 50])
def test_quadratic_interpolation_equivalence(spark, chunk):
    df = _panel(spark, 11, n=250)
    a = _pdf(ordd.interpolate_quadratic(df, ["y"], mode="plain"), ["y"])
    b = _pdf(ordd.interpolate_quadratic(df, ["y"], chunk=chunk), ["y"])
    _same(a, b, ["y"])
