"""NULL series, NULL times, equal times and bursts in the ordered operators, the grid and the fits."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourwise.operators import missing, ordered as ordd
from hourwise.operators.ema import add_ema, ema_state
from hourwise.operators.expand import dft, fourier
from hourwise.operators.joins import scale_columns
from hourwise.plans import model
from hourwise.plans.spec import ForecastSpec

T0 = dt.datetime(2024, 1, 1)


def _rows(key, n=60, gaps=True):
    rng = np.random.default_rng(7)
    return [(key, T0 + dt.timedelta(hours=h), None if gaps and h % 7 == 3 else float(rng.normal())) for h in range(n)]


def _frame(spark, rows, kind="string"):
    return spark.createDataFrame(rows, f"series_id {kind}, ds timestamp_ntz, y double")


OPERATORS = {
    "seq_index": lambda d: ordd.seq_index(d, bucket_width=8),
    "add_lags": lambda d: ordd.add_lags(d, "y", [1, 5], chunk=16),
    "add_rolling": lambda d: ordd.add_rolling(d, "y", [2, 5], chunk=16),
    "add_history": lambda d: ordd.add_history_features(d, "y", [1], [3], chunk=16, exclude_current=True),
    "ffill": lambda d: ordd.ffill(d, "y", chunk=8),
    "bfill": lambda d: ordd.bfill(d, "y", chunk=8),
    "ffill_bfill": lambda d: ordd.ffill_bfill(d, "y", chunk=8),
    "bfill_ffill": lambda d: ordd.bfill_ffill(d, "y", chunk=8),
    "interpolate_linear": lambda d: ordd.interpolate_linear(d, "y", chunk=8),
    "interpolate_quadratic": lambda d: ordd.interpolate_quadratic(d, "y", chunk=8),
    "add_ema": lambda d: add_ema(d, "y", [3, 12], chunk=8),
    "ema_state": lambda d: ema_state(d, "y", [3]),
    "fourier": lambda d: fourier(d, 24.0, 2),
    "dft": lambda d: dft(d, "y", [0, 3]),
    "scale": lambda d: scale_columns(d, ["y"]),
    "regularize": lambda d: missing.regularize(d),
}


def _values(df):
    """The rows of each series, without its name, in a fixed order."""
    out = {}
    for r in df.collect():
        row = r.asDict()
        out.setdefault(row.pop("series_id"), []).append(str([round(v, 9) if isinstance(v, float) else v for v in row.values()]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("name,kind", [(n, "string") for n in sorted(OPERATORS)] + [("add_ema", "bigint")])
def test_null_series_is_a_series(spark, name, kind):
    keys = ("a", "b") if kind == "string" else (1, 2)
    run = OPERATORS[name]
    with_null = _values(run(_frame(spark, _rows(keys[0]) + _rows(None), kind)))
    plain = _values(run(_frame(spark, _rows(keys[0]) + _rows(keys[1]), kind)))
    assert with_null[None] == plain[keys[1]] and with_null[keys[0]] == plain[keys[0]] and set(with_null) == {None, keys[0]}


@pytest.mark.parametrize("name", ["seq_index", "add_lags", "add_rolling", "ffill", "ffill_bfill", "interpolate_linear", "add_ema"])
def test_null_times_come_last(spark, name):
    rows = _rows("a", 20, gaps=False)
    odd = [("a", None, 100.0), ("a", None, 101.0), (None, None, 1.0)]
    got = OPERATORS[name](_frame(spark, odd + rows)).cache()
    assert got.count() == 23
    without = OPERATORS[name](_frame(spark, rows))
    assert _values(got.filter("ds is not null"))["a"] == _values(without)["a"]
    if name == "seq_index":
        assert sorted(r["seq"] for r in got.filter("series_id = 'a' and ds is null").collect()) == [20, 21]


def test_regularize_refuses_null_times(spark):
    with pytest.raises(Exception, match="1 rows are off the hour, without a time"):
        missing.regularize(_frame(spark, _rows("a", 5) + [("a", None, 1.0)])).collect()
    assert missing.regularize(_frame(spark, _rows("a", 5) + [("a", None, 1.0)]), off_grid="aggregate").count() == 5


def test_fit_and_predict_of_a_null_series(spark):
    spec = ForecastSpec(yearly=0, weekly=0, daily=0, n_changepoints=0)
    rows = [(k, T0 + dt.timedelta(hours=h), 2.0 + (0.5 if k else -0.25) * h) for k in ("a", None) for h in range(50)]
    fitted = model.fit(_frame(spark, rows), spec)
    assert fitted.count() == 2
    out = model.predict(fitted, _frame(spark, rows), spec).collect()
    want = {(k, t): y for k, t, y in rows}
    assert len(out) == 100 and all(abs(r["yhat"] - want[r["series_id"], r["ds"]]) < 1e-3 for r in out)
    assert model.without_model(fitted, _frame(spark, rows)).count() == 0


def test_positions_under_bursts(spark, monkeypatch):
    """A hundred thousand rows in one hour, a third of them in one instant: small windows, one stated order."""
    n = 100_000
    df = spark.range(n).select(
        F.lit("s").alias("series_id"),
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-01 00:30:00")).otherwise(F.concat(F.lit("2024-01-01 00:"), F.lpad((F.col("id") % 50).cast("string"), 2, "0"), F.lit(":07"))).cast("timestamp_ntz").alias("ds"),
        F.col("id").alias("v"))
    plans = []
    cut = ordd.cut_lineage
    monkeypatch.setattr(ordd, "cut_lineage", lambda d, name: plans.append(cut(d, name)) or plans[-1])
    got = ordd.seq_index(df, bucket_rows=512).select("ds", "v", "seq").toPandas().sort_values("seq")
    assert plans[-1].agg(F.max("_bucket_n")).first()[0] <= 512 and plans[0].agg(F.max("_bucket_n")).first()[0] == n
    assert (got["seq"].to_numpy() == np.arange(n)).all() and got["ds"].is_monotonic_increasing
    plain = ordd.seq_index(df.repartition(7), mode="plain").select("v", "seq").toPandas().sort_values("seq")
    assert (plain["v"].to_numpy() == got["v"].to_numpy()).all()


def test_equal_times_in_a_stated_order(spark):
    rows = [("a", T0, float(k)) for k in range(50)]
    one = ordd.add_lags(_frame(spark, rows), "y", [1]).collect()
    two = ordd.add_lags(_frame(spark, rows[::-1]).repartition(5), "y", [1]).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_forest_ranks_do_not_follow_the_partitioning(spark):
    from hourwise.operators.mlselect import pca, rfe_forest

    rng = np.random.default_rng(4)
    rows = [(float(a), float(b), float(c), float(3 * a + 0.5 * b)) for a, b, c in rng.normal(size=(300, 3))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    ranks = [sorted(map(tuple, rfe_forest(df.repartition(k), ["a", "b", "c"], "y", n_select=1, num_trees=10, max_depth=4).collect())) for k in (1, 4, 8)]
    assert ranks[0] == ranks[1] == ranks[2] == [("a", 1), ("b", 2), ("c", 3)]
    holes = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0), (1.0, float("nan"), 1.0, 1.0)], "a double, b double, c double, y double")
    whole = pd.DataFrame([tuple(r) for r in pca(df, ["a", "b", "c"]).collect()])
    got = pca(holes, ["a", "b", "c"]).collect()
    assert sum(r["PCA_1"] is None and r["PCA_2"] is None for r in got) == 2
    kept = pd.DataFrame([tuple(r) for r in got if r["PCA_1"] is not None])
    assert np.allclose(kept.sort_values([0, 1]).to_numpy(float), whole.sort_values([0, 1]).to_numpy(float))
