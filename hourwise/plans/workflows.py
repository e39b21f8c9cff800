"""End-to-end flows (G8, G9, G13, G14): future-frame preparation, regressor checks, training in automatic
or manual mode, and train-then-forecast.  Every step is a lazy DataFrame operator; actions happen only at
the MI scoring (top-k names), the Gram aggregate and the writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from hourwise.operators import columns as cols
from hourwise.operators import filters as flt
from hourwise.operators import ordered as ordd
from hourwise.operators.calendar import ALL_PARTS, calendar_features
from hourwise.operators.ema import add_ema
from hourwise.operators.expand import fourier, polynomial
from hourwise.operators.selection import select_by_mi
from hourwise.plans import model as mdl
from hourwise.plans.evaluate import evaluate
from hourwise.plans.spec import ForecastSpec


def prepare_future(df: DataFrame, start, end, regressors: Sequence[str], ts: str = "ds", fmt: str | None = None,
                   partition_cols=("series_id",), check_non_empty: bool = False) -> DataFrame:
    """Coerce-parse and round the timestamp, drop rows without one, keep ``start <= ds <= end``, then fill
    each regressor forward, backward, and with 0."""
    out = df
    if dict(df.dtypes).get(ts) == "string":
        out = cols.parse_ts(out, ts, fmt, strict=False)
    out = cols.round_hour(out, ts)
    out = flt.drop_null_ts(out, ts)
    out = flt.between_ts(out, start, end, ts)
    if check_non_empty:
        flt.require_non_empty(out, "future frame")
    regs = list(regressors)
    if regs:
        out = ordd.ffill_bfill(out, regs, partition_cols=partition_cols, order_col=ts)
        out = ordd.fill_zero(out, regs)
    return out


def check_regressors(model_spec: ForecastSpec, df: DataFrame) -> None:
    """Every model regressor must be a column of the frame."""
    cols.require_cols(df, model_spec.regressors)


def target_features(df: DataFrame, y: str = "y", lags=(1, 3, 6, 12, 24, 48, 72, 168), windows=(3, 6, 12, 24, 168),
                    spans=(12, 24, 168), exclude_current: bool = True, partition_cols=("series_id",),
                    order_col: str = "ds", pos_col: str | None = None) -> DataFrame:
    """Lags, rolling statistics and EMAs of the target: positions once, one window pass for lags and
    rolling frames, one pass per EMA span."""
    base = df.columns
    pc = list(partition_cols)
    df, pos, created = ordd.ensure_pos(df, pc, order_col, pos_col)
    out = ordd.add_history_features(df, y, lags, windows, pc, order_col, pos_col=pos, exclude_current=exclude_current)
    if spans:
        out = add_ema(out, y, spans, pc, order_col, pos_col=pos, exclude_current=exclude_current)
    return out.drop(pos) if created and pos not in base else out


def exogenous_features(df: DataFrame, cols: Sequence[str], lags=(1, 3, 6, 12, 24, 48, 72, 168), windows=(3, 6, 12, 24, 168),
                       spans=(12, 24, 168), partition_cols=("series_id",), order_col: str = "ds", pos_col: str | None = None) -> DataFrame:
    """Lags, rolling statistics and EMAs of several exogenous columns, names prefixed by the column: positions
    once, one window pass for lags and rolling frames, one for all EMAs."""
    base = df.columns
    pc = list(partition_cols)
    df, pos, created = ordd.ensure_pos(df, pc, order_col, pos_col)
    out = ordd.add_history_features(df, list(cols), lags, windows, pc, order_col, pos_col=pos, prefix_names=True)
    if spans:
        out = add_ema(out, list(cols), spans, pc, order_col, pos_col=pos, prefix_names=True)
    return out.drop(pos) if created and pos not in base else out


def engineer(df: DataFrame, exogenous: Sequence[str], degree2: Sequence[str] = (), order_col: str = "ds",
             partition_cols=("series_id",)) -> DataFrame:
    """The features that automatic training scores: calendar parts, weekly Fourier terms, lags, rolling statistics and
    EMAs of the exogenous columns, and degree-2 terms of ``degree2``. Parts that the frame has already stay as they
    are."""
    have = set(df.columns)
    out = calendar_features(df, order_col, parts=[p for p in ALL_PARTS if p not in have])
    out = fourier(out, 168, 5, partition_cols=partition_cols, order_col=order_col)
    out = exogenous_features(out, exogenous, partition_cols=partition_cols, order_col=order_col) if exogenous else out
    return polynomial(out, list(degree2)) if degree2 else out


def train(df: DataFrame, spec: ForecastSpec, start=None, end=None, regressors: Sequence[str] | None = None,
          top: int = 10, threshold: float = 0.3, bins: int = 16, exogenous: Sequence[str] = (), degree2: Sequence[str] = ()):
    """Automatic mode (no ``regressors``): feature engineering on the ``exogenous`` columns, then MI selection over
    every non-key numeric column with interactions of the top features; manual mode: exactly the given regressors.
    Returns (model, spec, chosen score table or None)."""
    if regressors is None and (exogenous or degree2):
        df = engineer(df, exogenous, degree2)
    hist = flt.between_ts(df, start, end)
    scores = None
    if regressors is None:
        feats = cols.numeric_cols(hist, exclude=("y",))
        complete = flt.drop_nulls(hist, ["y", *feats])
        hist, scores = select_by_mi(complete, feats, "y", top=top, threshold=threshold, bins=bins)
        regressors = [r["feature"] for r in scores.collect()]  # names only: one row per chosen feature
    hist = flt.drop_nulls(hist, ["y", *regressors])
    spec = spec.with_regressors(regressors)
    model = mdl.fit(hist, spec)
    return model, spec, scores


def train_then_forecast(df: DataFrame, spec: ForecastSpec, end, cutoff, regressors: Sequence[str],
                        start=None) -> tuple[DataFrame, DataFrame]:
    """Fit on ``ds <= end``, predict ``end < ds <= cutoff`` (direct: regressors from the rows), and
    evaluate where actuals exist: rows that ``is_filled`` marks as interpolated (M7) are no actuals.  Returns
    (forecast, metrics per series)."""
    model, spec, _ = train(df, spec, start, end, regressors)
    future = flt.between_ts(df, end, cutoff, closed="right")
    check_regressors(spec, future)
    future = prepare_future(future, end, cutoff, spec.regressors)
    fc = mdl.predict(model, future.select("series_id", "ds", *spec.regressors), spec)
    actual = flt.between_ts(df, end, cutoff, closed="right")
    if "is_filled" in df.columns:
        actual = actual.filter("is_filled = 0")
    actual = actual.select("series_id", "ds", "y")
    return fc, evaluate(actual, fc, by=["series_id"])
