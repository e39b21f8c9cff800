"""Registered queries: design matrix, fits, predictions, intervals, future frames, evaluation (G, A4-A6, S7,
L7-L9)."""

from __future__ import annotations

import datetime
import math
from dataclasses import replace

from pyspark.sql import functions as F

from hourwise import fixtures as fx
from hourwise.catalog import DAILY, GAPPY, HBT, HWIDE, NUDGE, r, register, rounded
from hourwise.operators import missing as miss
from hourwise.operators import ordered as ordd
from hourwise.operators.filters import between_ts, data_bounds
from hourwise.operators.mlselect import lasso_cv as _lasso_cv
from hourwise.operators.mlselect import pca as _pca
from hourwise.operators.mlselect import rfe_forest as _rfe
from hourwise.plans import model as mdl
from hourwise.plans.evaluate import compare, evaluate
from hourwise.plans.recursive import forecast_recursive as _forecast_recursive
from hourwise.plans.recursive_long import forecast_recursive_long as _forecast_recursive_long
from hourwise.plans.spec import CONFIG_A, CONFIG_B, CONFIG_B_LOCAL, ForecastSpec
from hourwise.plans.workflows import engineer, prepare_future as _prepare_future
from hourwise.plans.workflows import train, train_then_forecast as _ttf
from hourwise.session import cut_lineage, scratch_path
from hourwise.sources import io

TWO_PI = 2.0 * math.pi
# held-out part of the hourly panel: its last eleven days
CUT = "(SELECT max(ds) - INTERVAL 264 HOUR FROM hbt)"
LO2, HI2 = "2024-01-22 00:00:00", "2024-01-24 23:00:00"


def cut_of(panel):
    return panel.agg(F.max("ds") - F.expr("INTERVAL 264 HOURS")).scalar()


W_SER = "PARTITION BY series_id ORDER BY ds"
EH = "(epoch_us(ds) // 3600000000)::DOUBLE"

DESIGN_SPEC = ForecastSpec(n_changepoints=3, changepoint_range=0.9, yearly=0, weekly=2, daily=1)
OLS_SPEC = ForecastSpec(n_changepoints=0, yearly=0, weekly=0, daily=0, trend_prior_scale=None,
                        changepoint_prior_scale=None, seasonality_prior_scale=None, regressor_prior_scale=None)


def _design_sql() -> str:
    s = DESIGN_SPEC
    cps = [s.changepoint_range * (j + 1) / s.n_changepoints for j in range(s.n_changepoints)]
    cols = ["t"] + [f"greatest(0.0, t - {c!r}) AS cp_{j + 1}" for j, c in enumerate(cps)]
    for name, period, order in s.seasonal_terms():
        for i in range(1, order + 1):
            f = TWO_PI * i / period
            cols += [f"sin({f!r} * tau) AS {name}_sin_{i}", f"cos({f!r} * tau) AS {name}_cos_{i}"]
    rounded_cols = []
    for c in cols:
        if " AS " in c:
            e, n = c.rsplit(" AS ", 1)
            rounded_cols.append(f"{r(e)} AS {n}")
        else:
            rounded_cols.append(f"{r(c)} AS {c}")
    return f"""WITH {HBT},
b AS (SELECT series_id, min({EH}) AS t0, max({EH}) AS t1 FROM hbt GROUP BY series_id),
x AS (SELECT h.series_id, h.ds, ({EH} - b.t0) / (CASE WHEN b.t1 > b.t0 THEN b.t1 ELSE b.t0 + 1 END - b.t0) AS t, {EH} AS tau
      FROM hbt h JOIN b ON h.series_id = b.series_id)
SELECT series_id, ds, {', '.join(rounded_cols)} FROM x"""


@register("design_matrix", _design_sql())
def design_matrix(spark, sf):
    """Trend time, changepoint hinges and Fourier terms of absolute hours, per series."""
    df = fx.hourly_by_type(spark, sf).select("series_id", "ds", "y")
    stats = mdl.history_stats(df, DESIGN_SPEC)
    d = mdl.design_frame(df, stats, DESIGN_SPEC)
    names = DESIGN_SPEC.term_names()
    n_trend, n_seas, _ = DESIGN_SPEC.blocks()
    cols = [F.col("t")] + [F.col("trend_x")[2 + j].alias(names[2 + j]) for j in range(DESIGN_SPEC.n_changepoints)]
    cols += [F.col("seas_x")[i].alias(names[n_trend + i]) for i in range(n_seas)]
    return rounded(d.select("series_id", "ds", *cols))


_OLS_SQL = f"""b AS (SELECT series_id, min({EH}) AS t0, max({EH}) AS t1 FROM hbt WHERE ds < {CUT} GROUP BY series_id),
x AS (SELECT h.series_id, h.ds, h.y, ({EH} - b.t0) / (b.t1 - b.t0) AS t FROM hbt h JOIN b ON h.series_id = b.series_id),
f AS (SELECT series_id, regr_intercept(y, t) AS intercept, regr_slope(y, t) AS slope,
             sqrt((regr_syy(y, t) - regr_sxy(y, t) * regr_sxy(y, t) / regr_sxx(y, t)) / regr_count(y, t)) AS sigma
      FROM x WHERE ds < {CUT} GROUP BY series_id)"""


def _ols(spark, sf):
    df = fx.hourly_by_type(spark, sf).select("series_id", "ds", "y")
    hist = df.filter(F.col("ds") < cut_of(df))
    return df, mdl.fit(hist, OLS_SPEC)


@register("ols_trend", f"""WITH {HBT}, {_OLS_SQL}
SELECT series_id, {r('intercept', 4)} AS intercept, {r('slope', 4)} AS slope FROM f""")
def ols_trend(spark, sf):
    """Unpenalised linear trend per series through the distributed Gram solve (checked against
    ``regr_intercept`` / ``regr_slope``; model outputs compared at 4 decimals)."""
    _, model = _ols(spark, sf)
    out = model.select(F.col("_sid").alias("series_id"), (F.col("beta")[0] * F.col("y_scale")).alias("intercept"),
                       (F.col("beta")[1] * F.col("y_scale")).alias("slope"))
    return rounded(out, 4)


@register("predict_linear", f"""WITH {HBT}, {_OLS_SQL}
SELECT x.series_id, x.ds, {r('f.intercept + f.slope * x.t', 4)} AS yhat FROM x JOIN f ON x.series_id = f.series_id
WHERE x.ds >= {CUT}""")
def predict_linear(spark, sf):
    """Predictions of the fitted model for the rows after the cut (model row joined per series)."""
    df, model = _ols(spark, sf)
    fut = df.filter(F.col("ds") >= cut_of(df))
    return rounded(mdl.predict(model, fut, OLS_SPEC, intervals=False).select("series_id", "ds", "yhat"), 4)


_Z = OLS_SPEC.z()


@register("interval", f"""WITH {HBT}, {_OLS_SQL}
SELECT x.series_id, x.ds, {r('f.intercept + f.slope * x.t', 4)} AS yhat,
       {r(f'(f.intercept + f.slope * x.t) - {_Z!r} * f.sigma', 4)} AS yhat_lower,
       {r(f'(f.intercept + f.slope * x.t) + {_Z!r} * f.sigma', 4)} AS yhat_upper
FROM x JOIN f ON x.series_id = f.series_id WHERE x.ds >= {CUT}""")
def interval(spark, sf):
    """80 % interval ``yhat +/- z * sigma`` (residual noise of the fit)."""
    df, model = _ols(spark, sf)
    fut = df.filter(F.col("ds") >= cut_of(df))
    return rounded(mdl.predict(model, fut, OLS_SPEC).select("series_id", "ds", "yhat", "yhat_lower", "yhat_upper"), 4)


@register("interval_predictive", f"""WITH {HBT}, {_OLS_SQL},
q AS (SELECT h.series_id, count(*) AS n, avg(h.t) AS mt, sum(h.t * h.t) - count(*) * avg(h.t) * avg(h.t) AS sxx FROM x h WHERE h.ds < {CUT} GROUP BY h.series_id)
SELECT x.series_id, x.ds, {r('f.intercept + f.slope * x.t', 4)} AS yhat,
       {r(f'(f.intercept + f.slope * x.t) - {_Z!r} * f.sigma * sqrt(1 + 1.0 / q.n + (x.t - q.mt) * (x.t - q.mt) / q.sxx)', 4)} AS yhat_lower,
       {r(f'(f.intercept + f.slope * x.t) + {_Z!r} * f.sigma * sqrt(1 + 1.0 / q.n + (x.t - q.mt) * (x.t - q.mt) / q.sxx)', 4)} AS yhat_upper
FROM x JOIN f ON x.series_id = f.series_id JOIN q ON q.series_id = f.series_id WHERE x.ds >= {CUT}""")
def interval_predictive(spark, sf):
    """80 % interval with the coefficients' uncertainty, which widens away from the history (a straight line has no
    changepoints, so no coming changes)."""
    df, model = _ols(spark, sf)
    fut = df.filter(F.col("ds") >= cut_of(df))
    return rounded(mdl.predict(model, fut, OLS_SPEC, intervals="predictive").select("series_id", "ds", "yhat", "yhat_lower", "yhat_upper"), 4)


_FF = "last_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BF = "first_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@register("prepare_future", f"""WITH {GAPPY},
txt AS (SELECT series_id, strftime(ds + INTERVAL 20 MINUTE, '%Y-%m-%d %H:%M:%S') AS ds, y FROM gappy),
p AS (SELECT series_id, {'make_timestamp(CAST(round_even(epoch_us(try_strptime(ds, %s)) / 3600000000.0, 0) AS BIGINT) * 3600000000)'.replace('%s', "'%Y-%m-%d %H:%M:%S'")} AS ds, y
      FROM txt),
q AS (SELECT * FROM p WHERE ds IS NOT NULL AND ds >= TIMESTAMP '{LO2}' AND ds <= TIMESTAMP '{HI2}')
SELECT series_id, ds, {r('coalesce(' + _FF.format(c='y') + ', ' + _BF.format(c='y') + ', 0.0)')} AS y FROM q""")
def prepare_future(spark, sf):
    """Text timestamps parsed (coercing), rounded, range-filtered; regressor gaps filled forward, backward,
    then with 0."""
    g = fx.hourly_gappy(spark, sf)
    txt = g.select("series_id", F.date_format(F.timestamp_add("MINUTE", F.lit(20), F.col("ds")), "yyyy-MM-dd HH:mm:ss").alias("ds"), "y")
    return rounded(_prepare_future(txt, LO2, HI2, ["y"], fmt="yyyy-MM-dd HH:mm:ss"))


_NAIVE = f"""fc AS (SELECT series_id, ds, lag(y, 24) OVER ({W_SER}) AS yhat FROM hbt)"""


def _naive(spark, sf):
    actual = fx.hourly_by_type(spark, sf).select("series_id", "ds", "y")
    fc = ordd.add_lags(actual, "y", [24]).select("series_id", "ds", F.col("lag_24").alias("yhat"))
    return actual, fc.filter(F.col("ds") >= cut_of(actual))


_METRICS_SQL = f"""WITH {HBT}, {_NAIVE},
pr AS (SELECT a.series_id, a.y, f.yhat FROM hbt a JOIN fc f ON a.series_id = f.series_id AND a.ds = f.ds
       WHERE f.ds >= {CUT} AND a.y IS NOT NULL AND f.yhat IS NOT NULL)
SELECT series_id, {{m}} FROM pr GROUP BY series_id"""


@register("forecast_metrics", _METRICS_SQL.format(
    m=f"{r('avg(abs(y - yhat))')} AS mae, {r('avg((y - yhat) * (y - yhat))')} AS mse, "
      f"{r('sqrt(avg((y - yhat) * (y - yhat)))')} AS rmse, count(*) AS n"))
def forecast_metrics(spark, sf):
    """G11 + A4-A6: MAE, MSE, RMSE per series of a seasonal-naive (lag 24) forecast after the cut."""
    actual, fc = _naive(spark, sf)
    return rounded(evaluate(actual, fc, by=["series_id"]))


@register("metrics_two_decimals", _METRICS_SQL.format(
    m="(round(avg(abs(y - yhat)), 2) + 0.0) AS mae, (round(avg((y - yhat) * (y - yhat)), 2) + 0.0) AS mse, "
      "(round(sqrt(avg((y - yhat) * (y - yhat))), 2) + 0.0) AS rmse, count(*) AS n"))
def metrics_two_decimals(spark, sf):
    """The metrics formatted to two decimals (as written to the metrics file)."""
    actual, fc = _naive(spark, sf)
    return io.metrics_two_decimals(evaluate(actual, fc, by=["series_id"]))


@register("metrics_by_month", f"""WITH {DAILY},
fc AS (SELECT ds, lag(y, 7) OVER (ORDER BY ds) AS yhat FROM daily),
pr AS (SELECT make_timestamp(year(a.ds), month(a.ds), 1, 0, 0, 0) AS month, a.y, f.yhat FROM daily a JOIN fc f ON a.ds = f.ds
       WHERE a.y IS NOT NULL AND f.yhat IS NOT NULL)
SELECT month, {r('avg(abs(y - yhat))', 4)} AS mae, {r('avg((y - yhat) * (y - yhat))', -2)} AS mse,
       {r('sqrt(avg((y - yhat) * (y - yhat)))', 4)} AS rmse, count(*) AS n FROM pr GROUP BY month""")
def metrics_by_month(spark, sf):
    """G11 by month: weekly-naive forecast of the long daily series, evaluated per month (MSE ~1e11 is
    compared to the hundreds: summation order moves its second decimal)."""
    daily = fx.daily_orders(spark, sf).select("series_id", "ds", "y")
    fc = ordd.add_lags(daily, "y", [7]).select("series_id", "ds", F.col("lag_7").alias("yhat"))
    m = evaluate(daily, fc, by_month=True)
    return m.select("month", *[(F.round(F.col(c) + F.lit(NUDGE), d) + F.lit(0.0)).alias(c)
                               for c, d in (("mae", 4), ("mse", -2), ("rmse", 4))], "n")


@register("compare_actual", f"""WITH {HBT}, {_NAIVE}
SELECT a.series_id, a.ds, {r('a.y')} AS y, {r('f.yhat')} AS yhat, {r('a.y - f.yhat')} AS error, {r('abs(a.y - f.yhat)')} AS abs_error
FROM hbt a JOIN fc f ON a.series_id = f.series_id AND a.ds = f.ds
WHERE a.ds >= TIMESTAMP '{LO2}' AND a.ds <= TIMESTAMP '{HI2}'""")
def compare_actual(spark, sf):
    """Actual vs forecast over a date range with error columns."""
    actual, fc = _naive(spark, sf)
    return rounded(compare(actual, fc, LO2, HI2))


# ------------------------------------------------------------------ models on the regular panel

FLAG_REGS = ("lag_1", "lag_24", "rolling_mean_24h")
FLAG_SPEC = ForecastSpec(n_changepoints=5, yearly=0, weekly=3, daily=4)
HELD_OUT_HOURS = 168


def flagship_panel(spark, sf):
    """(panel, end of training, last hour): events -> hourly panel -> regular grid (positions from the grid, inserted
    hours marked) -> linear interpolation of gaps, training and held-out part each on their own -> target lags /
    rolling statistics (excluding the current hour).  The feature table is written once to the shared folder (the
    reference's features file hand-off) and read by training, forecasting and evaluation; the held-out part is the
    data's last week."""
    panel = fx.hourly_by_type(spark, sf).select("series_id", "ds", "y")
    hi = data_bounds(panel).first()["max_ds"]
    if hi is None:
        raise ValueError("the event panel is empty")
    end = hi - datetime.timedelta(hours=HELD_OUT_HOURS)
    panel = miss.regularize(panel, pos_col="_pos").withColumn("_train", F.col("ds") <= F.lit(str(end)).cast("timestamp_ntz"))
    panel = ordd.interpolate_linear(panel, ["y"], partition_cols=["series_id", "_train"], pos_col="_pos")
    panel = ordd.add_history_features(panel, "y", [1, 24], [24], pos_col="_pos", exclude_current=True)
    return cut_lineage(panel.drop("_pos", "_train"), "panel"), str(end), str(hi)


@register("train_then_forecast")
def train_then_forecast(spark, sf):
    """G13 + G14 (flagship): additive model per series (trend, weekly and daily seasonality, lag / rolling
    regressors) fitted on history, predictions for the held-out last week, MAE / MSE / RMSE per series over its
    observed hours."""
    panel, end, hi = flagship_panel(spark, sf)
    _, metrics = _ttf(panel, FLAG_SPEC, end, hi, FLAG_REGS)
    return metrics


@register("train_then_forecast_ols", f"""WITH {HBT},
lim AS (SELECT max(ds) AS hi, max(ds) - INTERVAL {HELD_OUT_HOURS} HOUR AS cut FROM hbt),
b AS (SELECT series_id, min({EH}) AS t0, max({EH}) AS t1 FROM hbt WHERE ds <= (SELECT cut FROM lim) GROUP BY series_id),
x AS (SELECT h.series_id, h.ds, h.y, ({EH} - b.t0) / (b.t1 - b.t0) AS t FROM hbt h JOIN b ON h.series_id = b.series_id),
f AS (SELECT series_id, regr_intercept(y, t) AS a, regr_slope(y, t) AS s FROM x WHERE ds <= (SELECT cut FROM lim) GROUP BY series_id),
e AS (SELECT x.series_id, x.y, f.a + f.s * x.t AS yhat FROM x JOIN f ON x.series_id = f.series_id WHERE x.ds > (SELECT cut FROM lim))
SELECT series_id, {r('avg(abs(y - yhat))', 4)} AS mae, {r('avg((y - yhat) * (y - yhat))', 4)} AS mse,
       {r('sqrt(avg((y - yhat) * (y - yhat)))', 4)} AS rmse, count(*) AS n FROM e GROUP BY series_id""")
def train_then_forecast_ols(spark, sf):
    """G14 value check: the flagship's flow with an unpenalised straight line on the observed hours."""
    panel = cut_lineage(fx.hourly_by_type(spark, sf).select("series_id", "ds", "y"), "panel")
    hi = data_bounds(panel).first()["max_ds"]
    _, metrics = _ttf(panel, OLS_SPEC, str(hi - datetime.timedelta(hours=HELD_OUT_HOURS)), str(hi), ())
    return rounded(metrics, 4)


@register("fit_additive")
def fit_additive(spark, sf):
    """G3 + G5: additive local model, coefficients in long form."""
    panel, end, _ = flagship_panel(spark, sf)
    model, _, _ = train(panel, FLAG_SPEC, end=end, regressors=FLAG_REGS)
    return mdl.coefficients(model)


@register("fit_regressor", f"""WITH {HBT},
l AS (SELECT series_id, ds, y, {EH} AS h, n_events::DOUBLE AS n FROM hbt),
b AS (SELECT series_id, min(h) AS t0, max(h) AS t1, max(abs(y)) AS ys, avg(n) AS m, stddev_samp(n) AS s FROM l GROUP BY series_id),
z AS (SELECT l.series_id, l.y / b.ys AS y, (h - t0) / (t1 - t0) AS t, (n - m) / s AS x FROM l JOIN b ON l.series_id = b.series_id),
q AS (SELECT series_id, avg(y) AS my, avg(t) AS mt, avg(x) AS mx, covar_pop(t, t) AS tt, covar_pop(x, x) AS xx, covar_pop(t, x) AS tx,
             covar_pop(t, y) AS ty, covar_pop(x, y) AS xy FROM z GROUP BY series_id),
c AS (SELECT series_id, my, mt, mx, (ty * xx - xy * tx) / (tt * xx - tx * tx) AS bt, (xy * tt - ty * tx) / (tt * xx - tx * tx) AS bx FROM q)
SELECT series_id, 'trend_m' AS term, {r('my - bt * mt - bx * mx', 4)} AS coef FROM c
UNION ALL SELECT series_id, 'trend_k', {r('bt', 4)} FROM c UNION ALL SELECT series_id, 'reg_n_events', {r('bx', 4)} FROM c""")
def fit_regressor(spark, sf):
    """G3 + G5 value check: straight line and one standardised regressor, against the closed-form normal equations."""
    df = fx.hourly_by_type(spark, sf).select("series_id", "ds", "y", F.col("n_events").cast("double").alias("n_events"))
    return rounded(mdl.coefficients(mdl.fit(df, OLS_SPEC.with_regressors(["n_events"]))), 4)


@register("fit_pooled", f"""WITH {HBT},
b AS (SELECT min({EH}) AS t0, max({EH}) AS t1, max(abs(y)) AS ys FROM hbt),
x AS (SELECT h.y, ({EH} - b.t0) / (b.t1 - b.t0) AS t FROM hbt h, b)
SELECT 'trend_m' AS term, {r('regr_intercept(y, t)', 4)} AS coef FROM x UNION ALL SELECT 'trend_k', {r('regr_slope(y, t)', 4)} FROM x""")
def fit_pooled(spark, sf):
    """G2 value check: a pooled model's straight line over all series' rows."""
    df = fx.hourly_by_type(spark, sf).select("series_id", "ds", "y")
    model = mdl.fit(df, replace(OLS_SPEC, scope="global"))
    out = model.select("y_scale", F.explode(F.arrays_zip("terms", "beta")).alias("e"))
    return rounded(out.select(F.col("e.terms").alias("term"), (F.col("e.beta") * F.col("y_scale")).alias("coef")), 4)


@register("fit_multiplicative")
def fit_multiplicative(spark, sf):
    """G1 + G5: the first family's configuration as it stands (multiplicative, 25 changepoints over all of the history,
    yearly, weekly and daily seasons) on the long daily series, by Gauss-Newton, one Gram pass per step."""
    model, _, _ = train(cut_lineage(fx.daily_orders(spark, sf).select("series_id", "ds", "y", "n_orders"), "daily"), CONFIG_A, regressors=("n_orders",))
    return mdl.coefficients(model)


@register("forecast_recursive")
def forecast_recursive(spark, sf):
    """Hour-by-hour recursive forecast of the held-out week; each prediction feeds the next hour's
    lag / rolling features."""
    panel, end, hi = flagship_panel(spark, sf)
    model, spec, _ = train(panel, FLAG_SPEC, end=end, regressors=FLAG_REGS)
    hist = between_ts(panel, None, end).select("series_id", "ds", "y")
    fut = between_ts(panel, end, hi, closed="right").select("series_id", "ds")
    return rounded(_forecast_recursive(model, hist, fut, spec))


RECURSIVE_SPEC = OLS_SPEC.with_regressors(("lag_1",))


_RECURSIVE_SQL = f"""WITH RECURSIVE {HBT},
h AS (SELECT series_id, ds, y, {EH} AS t, lag(y) OVER ({W_SER}) AS l FROM hbt WHERE ds < {CUT}),
m AS (SELECT series_id, avg(t) AS mt, avg(l) AS ml, avg(y) AS my, covar_pop(t, t) AS tt, covar_pop(t, l) AS tl, covar_pop(l, l) AS ll, covar_pop(t, y) AS ty, covar_pop(l, y) AS ly
      FROM h WHERE l IS NOT NULL GROUP BY series_id),
c AS (SELECT *, (ll * ty - tl * ly) / (tt * ll - tl * tl) AS bt, (tt * ly - tl * ty) / (tt * ll - tl * tl) AS bl FROM m),
f AS (SELECT series_id, ds, {EH} AS t, row_number() OVER ({W_SER}) AS k FROM hbt WHERE ds >= {CUT}),
r AS (SELECT series_id, 0::BIGINT AS k, NULL::TIMESTAMP AS ds, arg_max(y, ds) AS yhat FROM h GROUP BY series_id
      UNION ALL
      SELECT f.series_id, f.k, f.ds, c.my + c.bt * (f.t - c.mt) + c.bl * (r.yhat - c.ml) FROM r JOIN f ON f.series_id = r.series_id AND f.k = r.k + 1 JOIN c ON c.series_id = f.series_id)
SELECT series_id, ds, {r('yhat', 4)} AS yhat FROM r WHERE k > 0"""


def _recursive_case(spark, sf):
    df = fx.hourly_by_type(spark, sf).select("series_id", "ds", "y")
    hist, fut = df.filter(F.col("ds") < cut_of(df)), df.filter(F.col("ds") >= cut_of(df)).select("series_id", "ds")
    model = mdl.fit(ordd.add_lags(hist, "y", [1]).filter("lag_1 is not null"), RECURSIVE_SPEC)
    return model, hist, fut, RECURSIVE_SPEC


@register("forecast_recursive_lag", _RECURSIVE_SQL)
def forecast_recursive_lag(spark, sf):
    """Recursion on trend and the hour before, fitted by least squares on the history."""
    return rounded(_forecast_recursive(*_recursive_case(spark, sf)).select("series_id", "ds", "yhat"), 4)


@register("forecast_recursive_long", _RECURSIVE_SQL)
def forecast_recursive_long(spark, sf):
    """The same recursion, its horizon cut into blocks of 32 hours that are forecast side by side."""
    return rounded(_forecast_recursive_long(*_recursive_case(spark, sf), block=32).select("series_id", "ds", "yhat"), 4)


_FOLDS, _ALPHAS = 5, 20


@register("lasso_cv_single", f"""WITH {HWIDE},
d AS (SELECT n_click::DOUBLE AS x, (n_click + n_view)::DOUBLE AS y, row_number() OVER (ORDER BY ds) - 1 AS i, count(*) OVER () AS n FROM hw),
k AS (SELECT x, y, n, CASE WHEN i < (n // {_FOLDS} + 1) * (n % {_FOLDS}) THEN i // (n // {_FOLDS} + 1) ELSE n % {_FOLDS} + (i - (n // {_FOLDS} + 1) * (n % {_FOLDS})) // (n // {_FOLDS}) END AS fold FROM d),
s AS (SELECT fold, count(*)::DOUBLE AS m, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM k GROUP BY fold),
t AS (SELECT sum(m) AS m, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM s),
a AS (SELECT g, abs(sxy - sx * sy / m) / m * pow(10.0, -3.0 * g / {_ALPHAS - 1}) AS alpha FROM t, range({_ALPHAS}) r(g)),
p AS (SELECT s.*, g, alpha, t.m - s.m AS om, (t.sx - s.sx) / (t.m - s.m) AS mx, (t.sy - s.sy) / (t.m - s.m) AS my,
             (t.sxx - s.sxx) - (t.sx - s.sx) * (t.sx - s.sx) / (t.m - s.m) AS cxx, (t.sxy - s.sxy) - (t.sx - s.sx) * (t.sy - s.sy) / (t.m - s.m) AS cxy FROM s, t, a),
b AS (SELECT *, sign(cxy) * greatest(abs(cxy) - alpha * om, 0) / cxx AS b FROM p),
e AS (SELECT g, alpha, avg((syy - 2 * ((my - mx * b) * sy + b * sxy) + (my - mx * b) * (my - mx * b) * m + 2 * (my - mx * b) * b * sx + b * b * sxx) / m) AS mse FROM b GROUP BY g, alpha),
z AS (SELECT alpha FROM e ORDER BY mse, g LIMIT 1),
f AS (SELECT alpha, sign(sxy - sx * sy / m) * greatest(abs(sxy - sx * sy / m) - alpha * m, 0) / (sxx - sx * sx / m) AS coef FROM z, t)
SELECT 'n_click' AS feature, {r('coef')} AS coef, {r('alpha')} AS alpha, coef <> 0 AS selected FROM f""")
def lasso_cv_single(spark, sf):
    """Cross-validated Lasso of one feature, where each step has a closed form."""
    df = fx.hourly_wide(spark, sf).withColumn("n_both", F.col("n_click") + F.col("n_view"))
    return rounded(_lasso_cv(df, ["n_click"], "n_both", folds=_FOLDS, n_alphas=_ALPHAS))


def _sel_frame(spark, sf):
    from hourwise.catalog.selection import FEATS, selection_frame

    return selection_frame(spark, sf), list(FEATS)


@register("lasso_cv")
def lasso_cv(spark, sf):
    """Cross-validated Lasso (10 contiguous folds) from per-fold Gram statistics."""
    frame, feats = _sel_frame(spark, sf)
    return rounded(_lasso_cv(frame, feats, "y", folds=10))


@register("rfe_forest")
def rfe_forest(spark, sf):
    """Recursive elimination with MLlib random forests down to 10 features."""
    frame, feats = _sel_frame(spark, sf)
    return _rfe(frame, feats, "y", n_select=10)


@register("consensus_three")
def consensus_three(spark, sf):
    """Features that Lasso, the forest elimination and binned mutual information all choose."""
    from hourwise.catalog.selection import BINS
    from hourwise.operators import selection as sel

    frame, feats = _sel_frame(spark, sf)
    frame = cut_lineage(frame, "selection")
    lasso = _lasso_cv(frame, feats, "y", folds=10).filter("selected")
    forest = _rfe(frame, feats, "y", n_select=10).filter("rank = 1")
    return sel.consensus(lasso, forest, sel.top_k(sel.mutual_info(frame, feats, "y", BINS), 10))


@register("pca2")
def pca2(spark, sf):
    """Two principal components of four centred count columns, appended to the rows."""
    df = fx.hourly_wide(spark, sf).select("ds", "n_click", "n_view", "n_error", "n_purchase")
    return rounded(_pca(df, ["n_click", "n_view", "n_error", "n_purchase"], 2).select("ds", "PCA_1", "PCA_2"))


_PC4 = ("n_click", "n_view", "n_error", "n_purchase")


@register("pca_norms", f"""WITH {HWIDE}, m AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in _PC4)} FROM hw)
SELECT ds, {r(' + '.join(f'({c} - m_{c}) * ({c} - m_{c})' for c in _PC4), 4)} AS norm2 FROM hw, m""")
def pca_norms(spark, sf):
    """L9 value check: all components together keep each centred row's length."""
    df = fx.hourly_wide(spark, sf).select("ds", *_PC4)
    out = _pca(df, list(_PC4), 4)
    return rounded(out.select("ds", sum((F.col(f"PCA_{i}") ** 2 for i in range(2, 5)), F.col("PCA_1") ** 2).alias("norm2")), 4)


@register("fit_global")
def fit_global(spark, sf):
    """The second family's configuration as it stands - additive, pooled over all series (global normalisation),
    40 changepoints over the first 95 % with L1 trend regularisation 0.1 and seasonality regularisation 0.1."""
    panel, end, _ = flagship_panel(spark, sf)
    model, _, _ = train(panel, CONFIG_B, end=end, regressors=FLAG_REGS)
    return rounded(mdl.coefficients(model))


@register("fit_config_b_local")
def fit_config_b_local(spark, sf):
    """G2, local variant: the second family's configuration fitted per series, on the long daily series."""
    model, _, _ = train(cut_lineage(fx.daily_orders(spark, sf).select("series_id", "ds", "y"), "daily"), CONFIG_B_LOCAL, regressors=())
    return mdl.coefficients(model)


@register("train_auto")
def train_auto(spark, sf):
    """G13 (automatic mode): calendar, Fourier, lag, rolling and EMA features of the count columns, then binned-MI
    selection with interactions over every numeric column, then an additive fit on the chosen features."""
    from hourwise.catalog.selection import MI_T

    panel = cut_lineage(engineer(fx.hourly_wide(spark, sf), list(fx_counts()), degree2=("n_click", "n_view")), "engineered")
    model, spec, _ = train(panel, FLAG_SPEC, threshold=MI_T)
    return rounded(mdl.coefficients(model))


def fx_counts():
    return [f"n_{t}" for t in fx.EVENT_TYPES]


@register("model_roundtrip", f"""WITH {HBT}, {_OLS_SQL}
SELECT x.series_id, x.ds, {r('f.intercept + f.slope * x.t', 4)} AS yhat FROM x JOIN f ON x.series_id = f.series_id
WHERE x.ds >= {CUT}""")
def model_roundtrip(spark, sf):
    """The fitted coefficient table saved as Parquet in the shared folder, loaded back and used to predict."""
    df, model = _ols(spark, sf)
    path = scratch_path(spark, "model")
    io.save_model(model, path)
    loaded = io.load_model(spark, path)
    fut = df.filter(F.col("ds") >= cut_of(df))
    return rounded(mdl.predict(loaded, fut, OLS_SPEC, intervals=False).select("series_id", "ds", "yhat"), 4)


@register("forecast_roundtrip", f"""WITH {HBT}, {_NAIVE}
SELECT series_id, ds, {r('yhat')} AS yhat FROM fc WHERE ds >= {CUT}""")
def forecast_roundtrip(spark, sf):
    """A forecast frame written as header CSV and read back with its schema."""
    _, fc = _naive(spark, sf)
    path = scratch_path(spark, "forecast", ".csv")
    io.save_forecast(fc, path)
    back = io.load_dataset(spark, path, schema="series_id string, ds timestamp_ntz, yhat double")
    return rounded(back)
