"""Whole spectra, splines and nearest-neighbour scores that never hold a series in one task."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourwise.operators import fft, spline
from hourwise.operators.fft import fft_long
from hourwise.operators.knn import _tiled, digamma, knn_mutual_info
from hourwise.operators.spline import interpolate_spline

T0 = dt.datetime(2024, 1, 1)


def _series(spark, values: dict):
    rows = [(k, T0 + dt.timedelta(hours=i), None if v is None else float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, y double").repartition(3)


# ------------------------------------------------------------ spectra


@pytest.mark.parametrize("n", [1, 2, 3, 61, 64, 97, 720])
def test_shape_is_about_the_root(n):
    a, b, chirp = fft._shape(n)
    assert a * b == n if not chirp else a * b >= 2 * n - 1
    assert max(a, b) <= max(4, 4 * n**0.5)


def test_fft_equals_numpy(spark):
    rng = np.random.default_rng(1)
    values = {"smooth": rng.normal(size=240), "prime": rng.normal(size=211), None: rng.normal(size=61), "one": [2.5], "gaps": [None, 1.0, float("nan"), 4.0, 2.0, 7.0]}
    got = fft_long(_series(spark, values)).collect()
    for k, v in values.items():
        want = np.fft.fft(np.nan_to_num(np.array([0.0 if x is None else x for x in v], dtype=float)))
        own = sorted((r["k"], r["re"], r["im"], r["magnitude"]) for r in got if r["series_id"] == k)
        assert [r[0] for r in own] == list(range(len(v)))
        assert np.allclose([complex(r[1], r[2]) for r in own], want, atol=1e-9) and np.allclose([r[3] for r in own], np.abs(want), atol=1e-9)
    assert fft_long(_series(spark, {})).count() == 0
    whole = fft_long(_series(spark, {"smooth": values["smooth"]}).drop("series_id"), partition_cols=())
    assert np.allclose([r["re"] for r in whole.orderBy("k").collect()], np.fft.fft(values["smooth"]).real, atol=1e-9)


def test_fft_groups_are_small():
    for n in (4096, 4099, 10**6, 999_983, 66_936):  # balanced and prime lengths
        assert max(fft._shape(n)[:2]) <= 4 * n**0.5


# ------------------------------------------------------------ splines


def _dense(pos, known):
    """The spline by one dense solve (collocation with the whole knot vector)."""
    at = [i for i, v in enumerate(known) if v is not None]
    x, y, n = np.array(at, float), np.array([known[i] for i in at], float), len(at)
    mids = (x[1:] + x[:-1]) / 2
    t = np.concatenate([[x[0]] * 3, mids[1:-1], [x[-1]] * 3])

    def basis(v):
        span = min(max(int(np.searchsorted(t, v, "right")) - 1, 2), n - 1)
        row = np.zeros(n)
        b = [1.0]
        for d in (1, 2):
            out = [0.0] * (d + 1)
            for j in range(d):
                lo, hi = t[span - d + 1 + j], t[span + 1 + j]
                w = b[j] / (hi - lo)
                out[j] += (hi - v) * w
                out[j + 1] += (v - lo) * w
            b = out
        row[span - 2: span + 1] = b
        return row

    u = np.linalg.solve(np.array([basis(v) for v in x]), y)
    return [known[p] if known[p] is not None else None if p < x[0] else y[-1] if p > x[-1] else float(basis(float(p)) @ u) for p in pos]


@pytest.mark.parametrize("chunk", [4, 7, 4096])
def test_spline_equals_a_dense_solve(spark, chunk):
    rng = np.random.default_rng(2)
    hole = lambda n, p: [None if rng.random() < p else float(v) for v in rng.normal(size=n)]
    values = {"long": hole(160, 0.4), None: [None, None] + hole(50, 0.6) + [None], "three": [1.0, None, 4.0, None, None, 2.0], "two": [1.0, None, None, 4.0], "one": [None, 3.0, None], "none": [None, None], "full": hole(9, 0.0)}
    got = interpolate_spline(_series(spark, values), "y", chunk=chunk).collect()
    for k, v in values.items():
        own = [r["y"] for r in sorted((r for r in got if r["series_id"] == k), key=lambda r: r["ds"])]
        if k in ("two", "one", "none"):
            want = {"two": [1.0, 2.0, 3.0, 4.0], "one": [None, 3.0, 3.0], "none": [None, None]}[k]
        else:
            want = _dense(range(len(v)), v)
        assert len(own) == len(v) and [x is None for x in own] == [x is None for x in want]
        assert np.allclose([x for x in own if x is not None], [x for x in want if x is not None], atol=1e-9), k


def test_spline_meets_parabolas_and_keeps_columns(spark):
    rows = [("s", T0 + dt.timedelta(hours=i), None if i % 4 == 2 else float(3 * i * i - 5 * i + 1), i, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, y double, _n int, other string")
    got = interpolate_spline(df, "y", chunk=6)
    assert got.columns == df.columns and got.count() == 40
    assert all(abs(r["y"] - (3 * r["_n"] ** 2 - 5 * r["_n"] + 1)) < 1e-8 for r in got.collect() if r["_n"] <= 37)


def test_coupled_chunks():
    """Chunks of random tridiagonal systems, put together, equal one solve."""
    rng = np.random.default_rng(5)
    n, size = 23, 5
    low, up = rng.uniform(0.1, 1, n), rng.uniform(0.1, 1, n)
    low[0] = up[-1] = 0
    diag, right = rng.uniform(2.5, 4, n), rng.normal(size=n)
    want = np.linalg.solve(np.diag(diag) + np.diag(low[1:], -1) + np.diag(up[:-1], 1), right)
    rows, cuts = [], [0, 5, 10, 15, n]
    for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
        r = np.zeros((b - a, 3))
        r[:, 0], r[0, 1], r[-1, 2] = right[a:b], low[a], up[b - 1]
        g = spline._thomas(low[a:b], diag[a:b], up[a:b], r)
        rows.append((j, *g[0], *g[-1]))
    out = spline._coupled(pd.DataFrame(rows, columns=["_part", "_g0", "_v0", "_w0", "_g1", "_v1", "_w1"]), [])
    for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
        assert np.isclose(out["_left"][j], want[a - 1] if a else 0) and np.isclose(out["_right"][j], want[b] if b < n else 0)
    assert size == 5


# ------------------------------------------------------------ nearest neighbours


def _harmonic(m):
    return -0.5772156649015329 + sum(1 / j for j in range(1, m))


def _brute(x, y, k):
    ok = [i for i in range(len(x)) if None not in (x[i], y[i]) and x[i] == x[i]]
    scale = lambda v: (lambda s: s if s > 0 else 1.0)(np.std([a for a in v if a is not None and a == a]))
    a, b = (np.round(np.array([v[i] for i in ok]) / scale(v) * 2**30).astype(np.int64) for v in (x, y))
    if len(ok) <= k:
        return 0.0
    dx, dy = np.abs(a[:, None] - a), np.abs(b[:, None] - b)
    e = np.sort(np.maximum(dx, dy), axis=1)[:, k][:, None]
    count = lambda d: [_harmonic(int(m)) for m in np.where(e > 0, d < e, d == 0).sum(1)]
    return max(0.0, _harmonic(len(ok)) + _harmonic(k) - np.mean(count(dx)) - np.mean(count(dy)))


@pytest.mark.parametrize("tile_rows,k", [(8, 3), (64, 1)])
def test_knn_equals_all_pairs(spark, tile_rows, k):
    rng = np.random.default_rng(9)
    n = 300
    a = rng.normal(size=n)
    y = a + 0.4 * rng.normal(size=n)
    y[:30] = y[0]  # ties
    cols = {"a": list(a), "steps": list(np.floor(a * 2)), "noise": list(rng.exponential(size=n) ** 4), "same": [1.0] * n,
            "holes": [None if i % 5 == 0 else float("nan") if i % 5 == 1 else v for i, v in enumerate(a)], "empty": [None] * n, "two": [1.0, 2.0] + [None] * (n - 2)}
    ys = [None if i % 50 == 49 else float(v) for i, v in enumerate(y)]
    rows = [tuple(None if cols[c][i] is None else float(cols[c][i]) for c in cols) + (ys[i],) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", y double")
    got = {r["feature"]: r["score"] for r in knn_mutual_info(df, list(cols), k=k, tile_rows=tile_rows).collect()}
    assert set(got) == set(cols)
    for c in cols:
        assert abs(got[c] - _brute(cols[c], ys, k)) < 1e-9, c
    assert got["a"] > 0.5 and got["empty"] == 0


def test_tiles_are_bounded(spark):
    df = spark.range(5000).select(F.lit("f").alias("feature"), F.pow(F.lit(1.003), F.col("id")).cast("long").alias("x"), (F.col("id") % 3).alias("y"))
    sizes = [r["count"] for r in _tiled(df, 32).groupBy("slab", "tile").count().collect()]
    assert max(sizes) <= 64 and min(sizes) >= 16 and sum(sizes) == 5000


def test_digamma(spark):
    got = [r[0] for r in spark.range(1, 60).select(digamma(F.col("id"))).collect()]
    assert np.allclose(got, [_harmonic(m) for m in range(1, 60)], atol=1e-13)


# ------------------------------------------------------------ scans over many chunks


def test_carries_over_many_blocks(spark, monkeypatch):
    """Hundreds of blocks of chunks in one series, long gaps in between: as pandas does on the whole series."""
    from hourwise.operators import ema, ordered

    monkeypatch.setattr(ordered, "SCAN_ROWS", 8)
    monkeypatch.setattr(ema, "SCAN_ROWS", 8)
    rng = np.random.default_rng(3)
    v = [None if rng.random() < 0.3 or 900 < i < 1500 else float(x) for i, x in enumerate(rng.normal(size=3000))]
    df = _series(spark, {"a": v, None: [None] * 40 + v[:200]})
    got = ordered.ffill_bfill(ema.add_ema(df, "y", [1, 3, 50], chunk=2), "y", chunk=2).toPandas()
    for key, values in (("a", v), (None, [None] * 40 + v[:200])):
        own = got[got["series_id"].isna() if key is None else got["series_id"] == key].sort_values("ds")
        want = pd.Series(values, dtype=float)
        assert np.allclose(own["y"].to_numpy(float), want.ffill().bfill().to_numpy())
        for span in (1, 3, 50):
            assert np.allclose(own[f"ema_{span}h"].to_numpy(float), want.ewm(span=span).mean().to_numpy(), equal_nan=True)


# ------------------------------------------------------------ many columns, exact quantiles, widening intervals


def test_corr_of_many_columns(spark):
    from hourwise.operators.selection import corr_matrix

    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 150)) @ rng.normal(size=(150, 150))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7], x[:, 8] = 3.0, x[:, 9] * 1e-8
    df = pd.DataFrame(x, columns=[f"c{i}" for i in range(150)])
    got = corr_matrix(spark.createDataFrame(df).repartition(5), list(df.columns), tile=64).toPandas()
    want = df.corr().to_numpy()
    assert len(got) == 150 * 149 // 2
    own = np.array([np.nan if v is None else v for v in got["corr"]], dtype=float)
    ref = want[got["pos_a"], got["pos_b"]]
    const = (got["pos_a"] == 7) | (got["pos_b"] == 7)
    assert np.isnan(own[const]).all() and np.allclose(own[~const], ref[~const], atol=1e-9)


def test_quantile_edges_are_exact(spark):
    from hourwise.operators.selection import quantile_edges

    rng = np.random.default_rng(2)
    cols = {"a": rng.normal(size=4000) * 1e6, "ties": np.floor(rng.exponential(size=4000)), "tiny": rng.normal(size=4000) * 1e-9}
    cols["a"][::7] = np.nan
    df = spark.createDataFrame(pd.DataFrame(cols)).withColumn("none", F.lit(None).cast("double")).repartition(4)
    probs = [0.0, 0.001, 0.25, 0.5, 0.99, 1.0]
    got = {(r["feature"], r["prob"]): r["value"] for r in quantile_edges(df, [*cols, "none"], probs).collect()}
    for c, v in cols.items():
        v = np.sort(v[~np.isnan(v)])
        for q in probs:
            assert got[c, q] == v[max(1, int(np.ceil(q * len(v)))) - 1]
    assert len(got) == 18


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_predictive_interval_equals_its_formula(spark, mode):
    from hourwise.plans import model
    from hourwise.plans.spec import ForecastSpec

    spec = ForecastSpec(mode=mode, n_changepoints=4, yearly=0, weekly=0, daily=2)
    rng = np.random.default_rng(1)
    hours = np.arange(300)
    y = (50 + 0.1 * hours + 0.3 * np.maximum(0, hours - 100)) * (1 + 0.2 * np.sin(hours * 2 * np.pi / 24)) + rng.normal(size=300)
    df = _series(spark, {"s": y})
    hist = df.filter(F.col("ds") < F.lit(T0 + dt.timedelta(hours=220)).cast("timestamp_ntz"))
    fitted = model.fit(hist, spec)
    out = model.predict(fitted, df, spec, intervals="predictive").orderBy("ds").toPandas()
    m = fitted.first()
    d = model.design_frame(df, fitted.drop("sigma", "beta", "factor"), spec).orderBy("ds").toPandas()
    x, t = np.stack(d["x"]), d["t"].to_numpy()
    beta, p = np.array(m["beta"]), x.shape[1]
    nt = 2 + spec.n_changepoints
    trend, season = x[:, :nt] @ beta[:nt], x[:, nt:] @ beta[nt:]
    jac = x if mode == "additive" else np.column_stack([x[:, :nt] * (1 + season)[:, None], x[:, nt:] * trend[:, None]])
    own = jac[:220]
    ridge, l1 = model._penalties(spec, 220.0, m["sigma"] ** 2)
    cov = np.linalg.pinv(own.T @ own + np.diag(ridge + l1 / (2 * np.maximum(np.abs(beta), 1e-6))), rcond=1e-10, hermitian=True)
    ahead = np.maximum(t - 1, 0)
    size = np.abs(beta[2:nt]).mean()
    var = m["sigma"] ** 2 * (1 + np.einsum("ij,jk,ik->i", jac, cov, jac)) + (1 if mode == "additive" else (1 + season) ** 2) * 2 * 4 / 3 * size**2 * ahead**3
    want = spec.z() * np.sqrt(var) * m["y_scale"]
    got = (out["yhat_upper"] - out["yhat"]).to_numpy()
    assert np.allclose(got, want, rtol=0.02 if mode == "multiplicative" else 1e-6)
    assert (np.diff(got[230:]) > 0).mean() > 0.6 and got[-1] > 1.2 * got[100]


# ------------------------------------------------------------ long recursive horizons


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_long_horizon_equals_the_replay(spark, mode):
    from hourwise.plans import model
    from hourwise.plans.recursive import forecast_recursive
    from hourwise.plans.recursive_long import forecast_recursive_long
    from hourwise.plans.workflows import target_features  # noqa: F401 - the features below are its own names
    from hourwise.operators import ordered
    from hourwise.operators.ema import add_ema
    from hourwise.plans.spec import ForecastSpec

    rng = np.random.default_rng(4)
    hours, cut = 500, 120
    wave = np.sin(np.arange(hours) * 2 * np.pi / 24)
    rows = [(k, T0 + dt.timedelta(hours=h), float(20 + a * wave[h] + 0.01 * h + rng.normal()), None if h % 11 == 5 else float(wave[h])) for k, a in (("a", 2.0), (None, 5.0), ("new", 1.0)) for h in range(hours)]
    df = spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, y double, x double")
    at = F.lit(T0 + dt.timedelta(hours=cut)).cast("timestamp_ntz")
    hist, fut = df.filter((F.col("ds") < at) & ~F.col("series_id").eqNullSafe("new")), df.filter(F.col("ds") >= at).drop("y")
    feats = add_ema(ordered.add_history_features(hist, "y", [1, 24], [6], exclude_current=True), "y", [12], exclude_current=True)
    spec = ForecastSpec(mode=mode, n_changepoints=2, yearly=0, weekly=0, daily=1).with_regressors(("lag_1", "lag_24", "rolling_mean_6h", "ema_12h", "x"))
    fitted = model.fit(feats.dropna(subset=["lag_24", "rolling_mean_6h", "ema_12h", "x"]), spec)
    want = forecast_recursive(fitted, hist, fut, spec).toPandas().set_index(["series_id", "ds"]).sort_index()
    for block in (30, 100):
        got = forecast_recursive_long(fitted, hist, fut, spec, block=block).toPandas().set_index(["series_id", "ds"]).sort_index()
        assert len(got) == len(want) == 3 * (hours - cut) and got.index.equals(want.index)
        for c in ("yhat", "yhat_lower", "yhat_upper"):
            assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-7, equal_nan=True)
    assert want.loc["new"]["yhat"].isna().all() and want.loc["a"]["yhat"].notna().all()
    with pytest.raises(ValueError, match="standard deviation"):
        forecast_recursive_long(fitted, hist, fut, spec.with_regressors(("rolling_std_6h",)))
