"""Selection operators against direct numpy computations."""

import datetime as dt

import numpy as np
import pandas as pd

from hourwise.operators import selection as sel
from hourwise.operators.mlselect import lasso_cv


def _frame(spark, n=500, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 1, n)
    b = a * 0.95 + rng.normal(0, 0.1, n)   # strongly correlated with a
    c = rng.normal(0, 1, n)
    d = rng.integers(0, 3, n).astype(float)
    y = 2 * a - 1.5 * c + rng.normal(0, 0.5, n)
    pdf = pd.DataFrame({"ds": [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(n)],
                        "a": a, "b": b, "c": c, "d": d, "y": y})
    return spark.createDataFrame(pdf), pdf


def _mi_numpy(x, y, bins=16):
    def b(v):
        mn, mx = v.min(), v.max()
        if mx == mn:
            return np.zeros(len(v), dtype=int)
        return np.minimum(np.floor((v - mn) / (mx - mn) * bins), bins - 1).astype(int)
    bx, by = b(x), b(y)
    n = len(x)
    cells = pd.Series(1, index=pd.MultiIndex.from_arrays([bx, by])).groupby(level=[0, 1]).sum()
    px = pd.Series(bx).value_counts()
    py = pd.Series(by).value_counts()
    mi = sum(c / n * np.log(c * n / (px[i] * py[j])) for (i, j), c in cells.items())
    mi -= (len(cells) - len(px) - len(py) + 1) / (2 * n)
    return max(mi, 0.0)


def test_binned_mi_matches_numpy(spark):
    df, pdf = _frame(spark)
    got = {r["feature"]: r["score"] for r in sel.mutual_info(df, ["a", "b", "c", "d"], "y").collect()}
    for f in "abcd":
        assert abs(got[f] - _mi_numpy(pdf[f].to_numpy(), pdf["y"].to_numpy())) < 1e-9


def test_corr_and_prune(spark):
    df, pdf = _frame(spark)
    got = {r["feature"]: r["score"] for r in sel.corr_with_target(df, ["a", "b", "c"], "y").collect()}
    for f in "abc":
        assert abs(got[f] - np.corrcoef(pdf[f], pdf["y"])[0, 1]) < 1e-9
    kept = [r["feature"] for r in sel.prune_correlated(df, ["a", "b", "c", "d"], 0.9).orderBy("pos").collect()]
    assert kept == ["a", "c", "d"]  # b follows a with |corr| > 0.9


def test_select_by_mi_adds_interactions(spark):
    df, _ = _frame(spark)
    wide, chosen = sel.select_by_mi(df, ["a", "b", "c", "d"], "y", top=3, threshold=0.0)
    assert any("_x_" in c for c in wide.columns)
    assert chosen.count() >= 1


def test_lasso_cv_keeps_signal(spark):
    df, pdf = _frame(spark, n=800)
    res = {r["feature"]: r for r in lasso_cv(df, ["a", "c", "d"], "y", folds=5).collect()}
    assert res["a"]["selected"] and res["c"]["selected"]
    assert abs(res["a"]["coef"] - 2.0) < 0.2 and abs(res["c"]["coef"] + 1.5) < 0.2


def test_corr_matrix_equals_pandas(spark):
    rng = np.random.default_rng(4)
    n, p = 400, 6
    base = rng.normal(100, 5, (n, 1))
    x = base + rng.normal(0, 1, (n, p)) * np.arange(1, p + 1)
    x[rng.random((n, p)) < 0.1] = np.nan  # pairwise-complete semantics
    pdf = pd.DataFrame(x, columns=[f"f{i}" for i in range(p)])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None)).repartition(7)
    cols = list(pdf.columns)
    exp = pdf.corr()
    for r in sel.corr_matrix(df, cols).collect():
        assert abs(r["corr"] - exp.loc[r["feature_a"], r["feature_b"]]) < 1e-10
    nan = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, float("nan"), 5.0), (3.0, 5.0, 5.0), (4.0, 7.5, 5.0)], "a double, b double, c double")
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in sel.corr_matrix(nan, ["a", "b", "c"]).collect()}
    want = nan.toPandas()[["a", "b"]].corr().iloc[0, 1]
    assert abs(got["a", "b"] - want) < 1e-12 and got["a", "c"] is None


def test_corr_of_columns_far_apart_in_scale(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(0, 1, 500)
    pdf = pd.DataFrame({"tiny": 1e-8 * base, "huge": 1e8 * (base + rng.normal(0, 1, 500)), "rate": 0.4 + 1e-9 * rng.normal(0, 1, 500), "twin": 1e100 * base, "flat": 0.1})
    df = spark.createDataFrame(pdf).repartition(5)
    cols, exp = list(pdf.columns), pdf.corr()
    for r in sel.corr_matrix(df, cols).collect():
        if "flat" in (r["feature_a"], r["feature_b"]):
            assert r["corr"] is None
        else:
            assert abs(r["corr"] - exp.loc[r["feature_a"], r["feature_b"]]) < 1e-6
    assert {r["feature"] for r in sel.prune_correlated(df, cols, 0.9).collect()} == {"tiny", "huge", "rate", "flat"}
    assert {(r["feature_a"], r["feature_b"]) for r in sel.moderate_pairs(sel.corr_matrix(df, cols)).collect()} == {("tiny", "huge"), ("huge", "twin")}
