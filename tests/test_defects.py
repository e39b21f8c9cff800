"""Regression tests for the reference defects we do not reproduce."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hourwise.operators import expand as ex
from hourwise.operators import joins as jn
from hourwise.operators.mlselect import pca


def _df(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i), float(i % 5), float((i * 7) % 11))
            for i in range(60)]
    return spark.createDataFrame(rows, "ds timestamp_ntz, a double, b double, c double")


def test_d1_polynomial_and_pca_stay_on_their_rows(spark):
    df = _df(spark).filter(F.col("a") % 3 != 0)  # a filtered frame: the reference misaligned here
    out = ex.polynomial(df, ["a", "b"]).collect()
    assert all(r["a__p2"] == r["a"] ** 2 and r["a__b"] == r["a"] * r["b"] for r in out)
    p = pca(df, ["a", "b", "c"], 2)
    assert p.count() == df.count() and p.filter(F.col("PCA_1").isNull()).count() == 0


def test_d2_no_duplicate_linear_terms(spark):
    out = ex.polynomial(_df(spark), ["a", "b"])
    assert len(out.columns) == len(set(out.columns))
    assert [c for c in out.columns if c not in ("ds", "a", "b", "c")] == ["a__p2", "a__b", "b__p2"]


def test_d13_attach_features_rejects_fan_out(spark):
    base = _df(spark).withColumn("series_id", F.lit("s"))
    dup = base.unionByName(base).select("series_id", "ds", (F.col("a") * 2).alias("f"))
    with pytest.raises(ValueError):
        jn.attach_features(base, dup)
    ok = jn.attach_features(base, dup, dedupe=True)
    assert ok.count() == base.count()
