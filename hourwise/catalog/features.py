"""Registered queries: windows, EMA, expansion, joins, set operations (W, X, J, U)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hourwise import fixtures as fx
from hourwise.catalog import GAPPY, HBT, HWIDE, r, register, regular_sql, rounded
from hourwise.operators import expand as ex
from hourwise.operators import joins as jn
from hourwise.operators import ordered as ordd
from hourwise.operators.ema import add_ema

TWO_PI = 2.0 * math.pi
W_SER = "PARTITION BY series_id ORDER BY ds"


def _lag_sql(col, k, name, w=W_SER):
    return f"lag({col}, {k}) OVER ({w}) AS {name}"


def _roll_sql(col, n, stat, w=W_SER):
    frame = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    fn = "avg" if stat == "mean" else "stddev_samp"
    return f"CASE WHEN count({col}) OVER {frame} = {n} THEN {fn}({col}) OVER {frame} END"


def ema_recursive_sql(src: str, col: str, spans, out_names, key: str = "series_id", p: str = "e") -> str:
    """CTEs computing pandas-adjusted EMAs by plain recursion: S = d S + x, W = d W + [x observed]."""
    ds = [1.0 - 2.0 / (s + 1.0) for s in spans]
    init = ", ".join(f"coalesce({col}, 0)::DOUBLE AS s{i}, CASE WHEN {col} IS NULL THEN 0 ELSE 1 END::DOUBLE AS w{i}"
                     for i in range(len(spans)))
    step = ", ".join(f"{d!r} * e.s{i} + coalesce(b.{col}, 0), {d!r} * e.w{i} + CASE WHEN b.{col} IS NULL THEN 0 ELSE 1 END"
                     for i, d in enumerate(ds))
    cols = ", ".join(f"s{i}, w{i}" for i in range(len(spans)))
    outs = ", ".join(f"{r(f'CASE WHEN e.w{i} > 0 THEN e.s{i} / e.w{i} END')} AS {n}" for i, n in enumerate(out_names))
    name = "ema" if p == "e" else f"ema_{p}"
    return f"""{p}b AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ds) - 1 AS i FROM {src}),
{p}r({key}, i, {cols}) AS (
  SELECT {key}, i, {init} FROM {p}b WHERE i = 0
  UNION ALL
  SELECT b.{key}, b.i, {step} FROM {p}r e JOIN {p}b b ON b.{key} = e.{key} AND b.i = e.i + 1),
{name} AS (SELECT b.*, {outs} FROM {p}b b JOIN {p}r e ON b.{key} = e.{key} AND b.i = e.i)"""


# ------------------------------------------------------------------ lags, rolling, EMA, positions


@register("lags_single", f"""WITH {HBT}
SELECT series_id, ds, {r('y')} AS y, {', '.join(r(f'lag(y, {k}) OVER ({W_SER})') + f' AS lag_{k}' for k in (1, 3, 6, 12, 24))}
FROM hbt""")
def lags_single(spark, sf):
    """``lag_{k}`` of the target per series, k in 1, 3, 6, 12, 24 (chunked windows with a halo)."""
    df = fx.hourly_by_type(spark, sf).select("series_id", "ds", "y")
    return rounded(ordd.add_lags(df, "y", [1, 3, 6, 12, 24]))


@register("lags_multi", f"""WITH {HWIDE}
SELECT ds, {r('y')} AS y, n_click, n_view,
  {', '.join(r(f'lag({c}, {k}) OVER (ORDER BY ds)') + f' AS {c}_lag_{k}' for c in ('y', 'n_click', 'n_view') for k in (1, 24))}
FROM hw""")
def lags_multi(spark, sf):
    """``{col}_lag_{k}`` for several columns in one window pass."""
    df = fx.hourly_wide(spark, sf).select("series_id", "ds", "y", "n_click", "n_view")
    out = ordd.add_lags(df, ["y", "n_click", "n_view"], [1, 24]).drop("series_id")
    return rounded(out.select(*[F.col(c).cast("double") if "_lag_" in c and not c.startswith("y_") else F.col(c) for c in out.columns]))


@register("rolling_mean_std", f"""WITH {GAPPY}
SELECT series_id, ds, {r('y')} AS y,
  {', '.join(r(_roll_sql('y', n, s)) + f' AS rolling_{s}_{n}h' for n in (1, 3, 6, 24) for s in ('mean', 'std'))}
FROM gappy""")
def rolling_mean_std(spark, sf):
    """W3 + W4: trailing mean / sample std with the all-rows-present guard, on a series with gaps
    (window 1 std is all NULL, D10)."""
    df = fx.hourly_gappy(spark, sf).select("series_id", "ds", "y")
    return rounded(ordd.add_rolling(df, "y", [1, 3, 6, 24]))


@register("rolling_multi", f"""WITH {HWIDE}
SELECT ds, {', '.join(r(_roll_sql(c, n, s, 'ORDER BY ds')) + f' AS {c}_rolling_{s}_{n}h' for c in ('n_click', 'n_view') for n in (3, 12) for s in ('mean', 'std'))}
FROM hw""")
def rolling_multi(spark, sf):
    """Rolling mean and std for every (column, window) pair in one pass."""
    df = fx.hourly_wide(spark, sf).select("series_id", "ds", "n_click", "n_view")
    return rounded(ordd.add_rolling(df, ["n_click", "n_view"], [3, 12]).drop("series_id", "n_click", "n_view"))


@register("ema_single", f"""WITH RECURSIVE {GAPPY}, {ema_recursive_sql('gappy', 'y', (3, 12, 24), ('ema_3h', 'ema_12h', 'ema_24h'))}
SELECT series_id, ds, {r('y')} AS y, ema_3h, ema_12h, ema_24h FROM ema""")
def ema_single(spark, sf):
    """Pandas-adjusted EMA (spans 3, 12, 24) on a series with missing values."""
    df = fx.hourly_gappy(spark, sf).select("series_id", "ds", "y")
    return rounded(add_ema(df, "y", [3, 12, 24]))


@register("ema_multi", f"""WITH RECURSIVE {HWIDE},
hw2 AS (SELECT series_id, ds, y, n_click::DOUBLE AS n_click FROM hw),
{ema_recursive_sql('hw2', 'y', (12, 24), ('y_ema_12h', 'y_ema_24h'), p='a')},
{ema_recursive_sql('hw2', 'n_click', (12, 24), ('n_click_ema_12h', 'n_click_ema_24h'), p='b')}
SELECT a.ds, a.y_ema_12h, a.y_ema_24h, b.n_click_ema_12h, b.n_click_ema_24h
FROM ema_a a JOIN ema_b b ON a.ds = b.ds""")
def ema_multi(spark, sf):
    """EMA of several columns and spans (one pass per span, all columns together)."""
    df = fx.hourly_wide(spark, sf).select("series_id", "ds", "y", F.col("n_click").cast("double"))
    return rounded(add_ema(df, ["y", "n_click"], [12, 24]).select("ds", "y_ema_12h", "y_ema_24h", "n_click_ema_12h", "n_click_ema_24h"))


@register("seq_index", f"""WITH {GAPPY}
SELECT series_id, ds, row_number() OVER ({W_SER}) - 1 AS seq FROM gappy""")
def seq_index(spark, sf):
    """0-based position per series via per-bucket counts and offsets (no whole-series window)."""
    return ordd.seq_index(fx.hourly_gappy(spark, sf).select("series_id", "ds"))


_TB_LAGS = (1, 3, 6, 12, 24, 48, 72, 168)
_TB_WIN = (3, 6, 12, 24, 168)
_TB_EMA = (12, 24, 168)


@register("target_bundle", f"""WITH RECURSIVE {HBT},
src AS (SELECT series_id, ds, y FROM hbt),
{ema_recursive_sql('src', 'y', _TB_EMA, tuple(f'ema_{s}h' for s in _TB_EMA))}
SELECT series_id, ds, {r('y')} AS y,
  {', '.join(r(f'lag(y, {k}) OVER ({W_SER})') + f' AS lag_{k}' for k in _TB_LAGS)},
  {', '.join(r(_roll_sql('y', n, s)) + f' AS rolling_{s}_{n}h' for n in _TB_WIN for s in ('mean', 'std'))},
  {', '.join(f'ema_{s}h' for s in _TB_EMA)}
FROM ema""")
def target_bundle(spark, sf):
    """W10 (with W1, W3, W4, W6): the reference's target bundle - 8 lags, 5 rolling windows (mean, std),
    3 EMAs - lags and rolling in one window pass, then one pass per EMA span."""
    from hourwise.plans.workflows import target_features

    df = fx.hourly_by_type(spark, sf).select("series_id", "ds", "y")
    return rounded(target_features(df, "y", _TB_LAGS, _TB_WIN, _TB_EMA, exclude_current=False))


# ------------------------------------------------------------------ expansion


def _fourier_sql(period, order, t="t"):
    out = []
    for i in range(1, order + 1):
        c = TWO_PI * i
        out.append(r(f"sin({c!r} * {t} / {float(period)!r})") + f" AS sin_{period}_{i}")
        out.append(r(f"cos({c!r} * {t} / {float(period)!r})") + f" AS cos_{period}_{i}")
    return ", ".join(out)


@register("fourier_weekly", f"""WITH {HBT},
x AS (SELECT series_id, ds, row_number() OVER ({W_SER}) - 1 AS t FROM hbt)
SELECT series_id, ds, {_fourier_sql(168, 5)} FROM x""")
def fourier_weekly(spark, sf):
    """X2 + W8: weekly Fourier terms (period 168, order 5) of the row position."""
    df = fx.hourly_by_type(spark, sf).select("series_id", "ds")
    return rounded(ex.fourier(df, 168, 5))


@register("cyclic_encode", f"""WITH {HWIDE}
SELECT ds, {r(f'sin({TWO_PI!r} * "H" / 24.0)')} AS sin_hour, {r(f'cos({TWO_PI!r} * "H" / 24.0)')} AS cos_hour,
  {r(f'sin({TWO_PI!r} * "Day" / 7.0)')} AS sin_day_of_week, {r(f'cos({TWO_PI!r} * "Day" / 7.0)')} AS cos_day_of_week
FROM hw""")
def cyclic_encode(spark, sf):
    """sin/cos of hour/24 and weekday/7."""
    df = fx.hourly_wide(spark, sf).select("ds", "Day", "H")
    df = ex.cyclic(ex.cyclic(df, "H", 24, "hour"), "Day", 7, "day_of_week")
    return rounded(df.drop("Day", "H"))


_N = ("n_click", "n_view", "n_error", "n_purchase", "n_signup")


@register("interactions_all", f"""WITH {HWIDE}
SELECT ds, {', '.join(f'{a} * {b} AS {a}_x_{b}' for i, a in enumerate(_N) for b in _N[i + 1:])} FROM hw""")
def interactions_all(spark, sf):
    """All C(n, 2) products in one projection."""
    df = fx.hourly_wide(spark, sf).select("ds", *_N)
    return ex.interactions(df, list(_N)).drop(*_N)


@register("interactions_base_only", f"""WITH {HWIDE}
SELECT ds, n_click * n_view AS n_click_x_n_view, n_click * n_error AS n_click_x_n_error, n_view * n_error AS n_view_x_n_error
FROM hw""")
def interactions_base_only(spark, sf):
    """Interactions that skip derived (lag / rolling / EMA) columns."""
    df = fx.hourly_wide(spark, sf).select("series_id", "ds", "y", "n_click", "n_view", "n_error")
    df = ordd.add_history_features(df, "y", [1], [3])
    cols = ["n_click", "lag_1", "n_view", "rolling_mean_3h", "n_error"]
    out = ex.interactions(df, cols, exclude_derived=True)
    return out.select("ds", *[c for c in out.columns if "_x_" in c])


_PAIRS = (("n_click", "n_view"), ("n_error", "y"), ("n_signup", "n_purchase"))


@register("interact_pairs", f"""WITH {HWIDE}
SELECT ds, {', '.join(r(f'{a} * {b}') + f' AS {a}_x_{b}' for a, b in _PAIRS)} FROM hw""")
def interact_pairs(spark, sf):
    """Listed pairs only."""
    df = fx.hourly_wide(spark, sf)
    out = ex.interact_pairs(df, _PAIRS)
    return rounded(out.select("ds", *[f"{a}_x_{b}" for a, b in _PAIRS]).select(
        "ds", *[F.col(f"{a}_x_{b}").cast("double") for a, b in _PAIRS]))


@register("polynomial2", f"""WITH {HWIDE}
SELECT ds, {r('1.0 * n_click * n_click')} AS n_click__p2, {r('1.0 * n_click * n_view')} AS n_click__n_view,
  {r('1.0 * n_click * y')} AS n_click__y, {r('1.0 * n_view * n_view')} AS n_view__p2, {r('1.0 * n_view * y')} AS n_view__y,
  {r('1.0 * y * y')} AS y__p2
FROM hw""")
def polynomial2(spark, sf):
    """Degree-2 terms, new terms only (D2: no duplicated degree-1 columns)."""
    df = fx.hourly_wide(spark, sf).select("ds", "n_click", "n_view", "y")
    return rounded(ex.polynomial(df, ["n_click", "n_view", "y"]).drop("n_click", "n_view", "y"))


_KS = (1, 2, 3, 7, 30)


@register("dft_selected", f"""WITH {GAPPY},
x AS (SELECT series_id, row_number() OVER ({W_SER}) - 1 AS t, coalesce(y, 0.0) AS x, count(*) OVER (PARTITION BY series_id) AS n
      FROM gappy),
f AS (SELECT x.*, k.k FROM x, (VALUES {', '.join(f'({k})' for k in _KS)}) k(k)),
s AS (SELECT series_id, k, sum(x * cos({TWO_PI!r} * k * t / n)) AS re, -sum(x * sin({TWO_PI!r} * k * t / n)) AS im FROM f GROUP BY ALL)
SELECT series_id, k::INTEGER AS k, {r('re', 4)} AS re, {r('im', 4)} AS im, {r('sqrt(re * re + im * im)', 4)} AS magnitude FROM s""")
def dft_selected(spark, sf):
    """DFT coefficients (missing -> 0) at selected frequencies, per series."""
    df = fx.hourly_gappy(spark, sf).select("series_id", "ds", "y")
    return rounded(ex.dft(df, "y", _KS), 4)


@register("abs_sqrt", f"""WITH {HBT}
SELECT series_id, ds, {r(f'abs(y - lag(y, 24) OVER ({W_SER}))')} AS abs_change_24, {r('sqrt(y)')} AS sqrt_y FROM hbt""")
def abs_sqrt(spark, sf):
    """X7 + X9: absolute value and square root."""
    df = ordd.add_lags(fx.hourly_by_type(spark, sf).select("series_id", "ds", "y"), "y", [24])
    return rounded(df.select("series_id", "ds", F.abs(F.col("y") - F.col("lag_24")).alias("abs_change_24"),
                             F.sqrt("y").alias("sqrt_y")))


@register("same_row_concat", f"""WITH {HWIDE}
SELECT ds, {r(f'sin({TWO_PI!r} * "H" / 24.0)')} AS sin_hour, n_click * n_view AS n_click_x_n_view, {r('1.0 * y * y')} AS y__p2
FROM hw""")
def same_row_concat(spark, sf):
    """Column blocks from several builders combined on the same rows in one projection."""
    df = fx.hourly_wide(spark, sf).select("ds", "H", "n_click", "n_view", "y")
    out = jn.same_row_concat(
        df,
        lambda d: [F.sin(F.lit(TWO_PI) * F.col("H") / F.lit(24.0)).alias("sin_hour")],
        lambda d: [(F.col("n_click") * F.col("n_view")).alias("n_click_x_n_view")],
        lambda d: [(F.lit(1.0) * F.col("y") * F.col("y")).alias("y__p2")],
    )
    return rounded(out.select("ds", "sin_hour", "n_click_x_n_view", "y__p2"))


# ------------------------------------------------------------------ joins and appends

# held-out part of the hourly panel: its last eleven days
CUT = "(SELECT max(ds) - INTERVAL 264 HOUR FROM hbt)"


@register("attach_features", f"""WITH {HWIDE},
f AS (SELECT ds, lag(y, 1) OVER (ORDER BY ds) AS lag_1, lag(y, 24) OVER (ORDER BY ds) AS lag_24 FROM hw)
SELECT h.ds, {r('h.y')} AS y, h.n_click, {r('f.lag_1')} AS lag_1, {r('f.lag_24')} AS lag_24
FROM hw h LEFT JOIN f ON h.ds = f.ds""")
def attach_features(spark, sf):
    """Left join of only the new feature columns, key uniqueness checked first."""
    base = fx.hourly_wide(spark, sf).select("series_id", "ds", "y", "n_click")
    feats = ordd.add_lags(base, "y", [1, 24])
    return rounded(jn.attach_features(base, feats, on=["series_id", "ds"]).drop("series_id"))


@register("align_actuals", f"""WITH {HBT},
fc AS (SELECT series_id, ds, lag(y, 24) OVER ({W_SER}) AS yhat FROM hbt)
SELECT a.series_id, a.ds, {r('a.y')} AS y, {r('f.yhat')} AS yhat
FROM hbt a JOIN fc f ON a.series_id = f.series_id AND a.ds = f.ds WHERE f.ds >= {CUT}""")
def align_actuals(spark, sf):
    """Actuals inner-joined with a (seasonal naive) forecast on (series, hour)."""
    actual = fx.hourly_by_type(spark, sf).select("series_id", "ds", "y")
    fc = ordd.add_lags(actual, "y", [24]).select("series_id", "ds", F.col("lag_24").alias("yhat"))
    fc = fc.filter(F.col("ds") >= actual.agg(F.max("ds") - F.expr("INTERVAL 264 HOURS")).scalar())
    return rounded(jn.align_actuals(actual, fc))


@register("append_rows", f"""WITH {HBT},
fc AS (SELECT series_id, ds, lag(y, 24) OVER ({W_SER}) AS yhat FROM hbt)
SELECT series_id, ds, {r('y')} AS y, NULL::DOUBLE AS yhat FROM hbt WHERE ds < {CUT}
UNION ALL
SELECT series_id, ds, NULL::DOUBLE AS y, {r('yhat')} AS yhat FROM fc WHERE ds >= {CUT}""")
def append_rows(spark, sf):
    """History rows and forecast rows appended by name, missing columns NULL."""
    actual = fx.hourly_by_type(spark, sf).select("series_id", "ds", "y")
    fc = ordd.add_lags(actual, "y", [24]).select("series_id", "ds", F.col("lag_24").alias("yhat"))
    cut = actual.agg(F.max("ds") - F.expr("INTERVAL 264 HOURS")).scalar()
    return rounded(jn.append_rows(actual.filter(F.col("ds") < cut), fc.filter(F.col("ds") >= cut)))


@register("scaled_columns", f"""WITH {HBT},
s AS (SELECT series_id, avg(y) AS my, stddev_samp(y) AS sy, avg(n_events) AS mn, stddev_samp(n_events) AS sn FROM hbt GROUP BY ALL)
SELECT h.series_id, h.ds, {r('(h.y - s.my) / s.sy')} AS y, {r('(h.n_events - s.mn) / s.sn')} AS n_events
FROM hbt h JOIN s ON h.series_id = s.series_id""")
def scaled_columns(spark, sf):
    """Normalisation step of the model: per-series standard scaling."""
    df = fx.hourly_by_type(spark, sf).select("series_id", "ds", "y", "n_events")
    return rounded(jn.scale_columns(df, ["y", "n_events"]))


def _lagrange_sql(a, b, c):
    """(pos, value) column names of three known points -> parabola at x (same operation order as Spark)."""
    (x0, y0), (x1, y1), (x2, y2) = a, b, c
    return (f"{y0} * (x - {x1}) * (x - {x2}) / (({x0} - {x1}) * ({x0} - {x2}))"
            f" + {y1} * (x - {x0}) * (x - {x2}) / (({x1} - {x0}) * ({x1} - {x2}))"
            f" + {y2} * (x - {x0}) * (x - {x1}) / (({x2} - {x0}) * ({x2} - {x1}))")


_QUAD = (f"CASE WHEN r.y IS NOT NULL THEN r.y WHEN r.a IS NULL THEN NULL WHEN r.b IS NULL THEN ka.v "
         f"WHEN ka.pp IS NOT NULL THEN {_lagrange_sql(('ka.pp', 'ka.pv'), ('ka.pos', 'ka.v'), ('kb.pos', 'kb.v'))} "
         f"WHEN kb.np IS NOT NULL THEN {_lagrange_sql(('ka.pos', 'ka.v'), ('kb.pos', 'kb.v'), ('kb.np', 'kb.nv'))} "
         f"ELSE ka.v + (kb.v - ka.v) * (x - ka.pos) / (kb.pos - ka.pos) END")


@register("interp_quadratic", f"""WITH {GAPPY}, {regular_sql('gappy')},
x0 AS (SELECT series_id, ds, y, row_number() OVER ({W_SER}) - 1 AS pos FROM reg),
kn AS (SELECT series_id, pos, y AS v, lag(pos) OVER w AS pp, lag(y) OVER w AS pv, lead(pos) OVER w AS np, lead(y) OVER w AS nv
       FROM x0 WHERE y IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
r AS (SELECT *, pos::DOUBLE AS x,
        max(CASE WHEN y IS NOT NULL THEN pos END) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
        min(CASE WHEN y IS NOT NULL THEN pos END) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
      FROM x0)
SELECT r.series_id, r.ds, {r(_QUAD)} AS y
FROM r LEFT JOIN kn ka ON r.series_id = ka.series_id AND r.a = ka.pos LEFT JOIN kn kb ON r.series_id = kb.series_id AND r.b = kb.pos""")
def interp_quadratic(spark, sf):
    """M6 (re-aimed): parabola through the nearest known points, on the regular hourly grid."""
    from hourwise.operators.missing import regularize

    df = regularize(fx.hourly_gappy(spark, sf).select("series_id", "ds", "y"), flag=None, pos_col="_pos")
    return rounded(ordd.interpolate_quadratic(df, ["y"], pos_col="_pos").drop("_pos"))


_RLO, _RHI = "2024-01-10 00:00:00", "2024-01-16 23:00:00"


@register("history_in_range", f"""WITH {HBT}, {regular_sql('hbt')},
f AS (SELECT series_id, ds, y, lag(y, 1) OVER ({W_SER}) AS lag_1, lag(y, 24) OVER ({W_SER}) AS lag_24,
      {_roll_sql('y', 6, 'mean')} AS rolling_mean_6h FROM reg)
SELECT series_id, ds, {r('y')} AS y, {r('lag_1')} AS lag_1, {r('lag_24')} AS lag_24, {r('rolling_mean_6h')} AS rolling_mean_6h
FROM f WHERE ds >= TIMESTAMP '{_RLO}' AND ds <= TIMESTAMP '{_RHI}'""")
def history_in_range(spark, sf):
    """Predicate through the window: lags / rolling mean for one week of the regular grid,
    computed from that week plus a 24-hour look-back margin only."""
    from hourwise.operators.missing import regularize

    df = regularize(fx.hourly_by_type(spark, sf).select("series_id", "ds", "y"), flag=None)
    def build(d):
        return ordd.add_rolling(ordd.add_lags(d, "y", [1, 24]), "y", [6], stats=("mean",))

    return rounded(ordd.features_between(df, _RLO, _RHI, build, lookback_hours=24))


# ------------------------------------------------------------------ further branches

_XB_LAGS, _XB_WIN, _XB_EMA = (1, 24, 168), (6, 24), (12, 24)
_XB = ("n_click", "n_view")


@register("exogenous_bundle", f"""WITH RECURSIVE {HWIDE},
xw AS (SELECT series_id, ds, n_click::DOUBLE AS n_click, n_view::DOUBLE AS n_view FROM hw),
{ema_recursive_sql('xw', 'n_click', _XB_EMA, tuple(f'n_click_ema_{s}h' for s in _XB_EMA), p='a')},
{ema_recursive_sql('xw', 'n_view', _XB_EMA, tuple(f'n_view_ema_{s}h' for s in _XB_EMA), p='b')}
SELECT x.ds,
  {', '.join(r(f'lag(x.{c}, {k}) OVER (ORDER BY x.ds)') + f' AS {c}_lag_{k}' for c in _XB for k in _XB_LAGS)},
  {', '.join(r(f'CASE WHEN count(x.{c}) OVER (ORDER BY x.ds ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN {f}(x.{c}) OVER (ORDER BY x.ds ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END') + f' AS {c}_rolling_{s}_{n}h' for c in _XB for n in _XB_WIN for s, f in (('mean', 'avg'), ('std', 'stddev_samp')))},
  {', '.join(f'a.n_click_ema_{s}h, b.n_view_ema_{s}h' for s in _XB_EMA)}
FROM xw x JOIN ema_a a ON x.ds = a.ds JOIN ema_b b ON x.ds = b.ds""")
def exogenous_bundle(spark, sf):
    """Lags, rolling statistics and EMAs of two exogenous columns."""
    from hourwise.plans.workflows import exogenous_features

    df = fx.hourly_wide(spark, sf).select("series_id", "ds", *[F.col(c).cast("double").alias(c) for c in _XB])
    return rounded(exogenous_features(df, _XB, _XB_LAGS, _XB_WIN, _XB_EMA).drop("series_id", *_XB))


@register("attach_dedupe", f"""WITH {HBT},
f AS (SELECT series_id, date_trunc('day', ds)::TIMESTAMP AS ds, n_events, y FROM hbt),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id, ds ORDER BY n_events, y) AS rn FROM f)
SELECT h.series_id, h.ds, {r('k.n_events')} AS day_events, {r('k.y')} AS day_y
FROM hbt h LEFT JOIN k ON h.series_id = k.series_id AND h.ds = k.ds AND k.rn = 1""")
def attach_dedupe(spark, sf):
    """J1 with a feature side that repeats keys: one existing row of each key is taken."""
    base = fx.hourly_by_type(spark, sf)
    feats = base.select("series_id", F.date_trunc("day", "ds").cast("timestamp_ntz").alias("ds"), F.col("n_events").cast("double").alias("day_events"), F.col("y").alias("day_y"))
    return rounded(jn.attach_features(base.select("series_id", "ds"), feats, dedupe=True))


@register("scaled_minmax", f"""WITH {HBT}, s AS (SELECT min(y) AS lo, max(y) AS hi FROM hbt)
SELECT h.series_id, h.ds, {r('(h.y - s.lo) / (s.hi - s.lo)')} AS y FROM hbt h, s""")
def scaled_minmax(spark, sf):
    """Normalisation by minimum and maximum over all series."""
    df = fx.hourly_by_type(spark, sf).select("series_id", "ds", "y")
    return rounded(jn.scale_columns(df, ["y"], partition_cols=(), method="minmax"))


@register("spectrum_rows", f"""WITH {HBT},
d AS (SELECT series_id, date_trunc('day', ds)::TIMESTAMP AS day, hour(ds) AS t, y FROM hbt),
n AS (SELECT series_id, day, t, y, row_number() OVER (PARTITION BY series_id, day ORDER BY t) - 1 AS p, count(*) OVER (PARTITION BY series_id, day) AS n FROM d),
s AS (SELECT a.series_id, a.day, a.t, sum(b.y * cos({TWO_PI!r} * a.p * b.p / a.n)) AS re, -sum(b.y * sin({TWO_PI!r} * a.p * b.p / a.n)) AS im
      FROM n a JOIN n b ON a.series_id = b.series_id AND a.day = b.day GROUP BY ALL)
SELECT series_id, day, t::INTEGER AS t, {r('re', 4)} AS fft_re, {r('im', 4)} AS fft_im, {r('sqrt(re * re + im * im)', 4)} AS fft_abs FROM s""")
def spectrum_rows(spark, sf):
    """The whole spectrum of many short series (one per event type and day), attached to their rows."""
    df = fx.hourly_by_type(spark, sf).select("series_id", F.date_trunc("day", "ds").cast("timestamp_ntz").alias("day"), F.hour("ds").alias("t"), "y")
    return rounded(ex.spectrum(df, "y", ["series_id", "day"], "t").drop("y"), 4)
