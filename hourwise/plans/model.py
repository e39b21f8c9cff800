"""Design matrix, distributed Gram fit and prediction.

Model per series (``scope="local"``) or pooled (``"global"``), y scaled by max |y| of the history:

    additive:        y = g(t) + S(tau) + R(x)
    multiplicative:  y = g(t) * (1 + S(tau) + R(x))

``g`` = intercept + slope * t + hinges ``max(0, t - s_j)`` (t = history time scaled to [0, 1]);
``S`` = Fourier terms of absolute epoch hours; ``R`` = regressors, standardised unless binary.

Plan:
* one small per-series statistics aggregate (time range, y scale, regressor mean / std) joined back; a pooled model's
  one row is a scalar subquery;
* the design vector is an ``array<double>`` column built from JVM expressions;
* each task sorts its rows by series and folds them into one partial Gram ``X'X, X'y, y'y, n`` per series (numpy);
  partials are merged by (series, task mod ``FANIN``), then always by series;
* the penalised normal equations are solved where each series' Gram row lies (ridge for Gaussian priors, reweighted
  ridge for the Laplace prior of the hinges, noise variance re-estimated from the same Gram; ``converged`` says
  whether this came to rest); multiplicative mode runs Gauss-Newton, one Jacobian Gram pass per iteration.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwise.functions import time as tf
from hourwise.operators.joins import null_safe_join, with_constants
from hourwise.operators.reduce import FANIN, sum_arrays
from hourwise.plans.spec import ForecastSpec

GLOBAL_ID = "__global__"
#: Stands for a NULL series in the model table.
NULL_ID = "__null__"
TWO_PI = 2.0 * math.pi


def _key(df: DataFrame, spec: ForecastSpec, series_col: str) -> DataFrame:
    if spec.scope == "global" or series_col not in df.columns:
        return df.withColumn("_sid", F.lit(GLOBAL_ID))
    return df.withColumn("_sid", F.coalesce(F.col(series_col).cast("string"), F.lit(NULL_ID)))


def _with_model(keyed: DataFrame, table: DataFrame, spec: ForecastSpec, series_col: str) -> DataFrame:
    """Rows with the columns of their series' row of ``table``; NULLs where a series has none. A pooled model's one
    row is a scalar subquery, not a join on a constant."""
    if spec.scope == "global" or series_col not in keyed.columns:
        return with_constants(keyed, table.drop("_sid"))
    return keyed.join(table, "_sid", "left")


def history_stats(df: DataFrame, spec: ForecastSpec, series_col: str = "series_id", y: str = "y") -> DataFrame:
    """Per-series constants of the model (one row per series)."""
    keyed = _key(df, spec, series_col)
    aggs = [tf.epoch_hours(F.min("ds")).cast("double").alias("t0"), tf.epoch_hours(F.max("ds")).cast("double").alias("t1"),
            F.max(F.abs(F.col(y))).alias("y_scale"), F.count(F.col(y)).alias("n_obs")]
    for i, r in enumerate(spec.regressors):
        c = F.col(f"`{r}`").cast("double")
        binary = F.bool_and(c.isin(0.0, 1.0))
        aggs += [F.when(binary, F.lit(0.0)).otherwise(F.avg(c)).alias(f"_rm{i}"),
                 F.when(binary | (F.stddev_samp(c) == 0) | F.stddev_samp(c).isNull(), F.lit(1.0)).otherwise(F.stddev_samp(c)).alias(f"_rs{i}")]
    st = keyed.groupBy("_sid").agg(*aggs)
    reg_m = F.array(*[F.col(f"_rm{i}") for i in range(len(spec.regressors))]) if spec.regressors else F.array().cast("array<double>")
    reg_s = F.array(*[F.col(f"_rs{i}") for i in range(len(spec.regressors))]) if spec.regressors else F.array().cast("array<double>")
    cps = [spec.changepoint_range * (j + 1) / spec.n_changepoints for j in range(spec.n_changepoints)]
    return st.select("_sid", "t0", F.when(F.col("t1") > F.col("t0"), F.col("t1")).otherwise(F.col("t0") + 1).alias("t1"),
                     F.when(F.col("y_scale") > 0, F.col("y_scale")).otherwise(F.lit(1.0)).alias("y_scale"), "n_obs",
                     reg_m.alias("reg_mean"), reg_s.alias("reg_std"),
                     F.array(*[F.lit(float(c)) for c in cps]).cast("array<double>").alias("changepoints"))


def design_columns(spec: ForecastSpec) -> dict[str, Column]:
    """Design blocks as array<double> expressions over a frame joined with ``history_stats``."""
    t = (tf.epoch_hours("ds").cast("double") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    tau = tf.epoch_hours("ds").cast("double")
    trend = F.concat(F.array(F.lit(1.0), t), F.transform(F.col("changepoints"), lambda s: F.greatest(F.lit(0.0), t - s)))
    seas = []
    for _, period, order in spec.seasonal_terms():
        for i in range(1, order + 1):
            ang = F.lit(TWO_PI * i / period) * tau
            seas += [F.sin(ang), F.cos(ang)]
    seasonal = F.array(*seas) if seas else F.array().cast("array<double>")
    regs = [((F.col(f"`{r}`").cast("double") - F.col("reg_mean")[i]) / F.col("reg_std")[i]) for i, r in enumerate(spec.regressors)]
    regressor = F.array(*regs) if regs else F.array().cast("array<double>")
    return {"t": t, "trend_x": trend, "seas_x": seasonal, "reg_x": regressor}


def design_frame(df: DataFrame, stats: DataFrame, spec: ForecastSpec, series_col: str = "series_id",
                 y: str | None = "y", also: tuple[str, ...] = ()) -> DataFrame:
    """(``_sid``, ds, t, trend_x, seas_x, reg_x, x[, y_s]) with the model constants joined per series."""
    keyed = _key(df, spec, series_col)
    j = _with_model(keyed, stats, spec, series_col)
    d = design_columns(spec)
    cols = [F.col("_sid"), F.col("ds"), d["t"].alias("t"), d["trend_x"].alias("trend_x"), d["seas_x"].alias("seas_x"),
            d["reg_x"].alias("reg_x"), F.col("y_scale"), *also]
    if series_col in df.columns and series_col != "_sid":
        cols.insert(1, F.col(series_col))
    if y is not None and y in df.columns:
        cols.append((F.col(y) / F.col("y_scale")).alias("y_s"))
    out = j.select(*cols)
    return out.withColumn("x", F.concat("trend_x", "seas_x", "reg_x"))


# ---------------------------------------------------------------- Gram


def _partial_gram_fn(p: int):
    """Fold a partition, whose rows come sorted by series, into one partial Gram per series: one p x p accumulator at
    a time, whatever the number of series."""

    def fn(batches):
        sid, acc = None, None

        def done():
            return pd.DataFrame({"_sid": [sid], "xtx": [acc[0].ravel()], "xty": [acc[1]], "yty": [acc[2]], "n": [acc[3]]})

        for pdf in batches:
            if pdf.empty:
                continue
            ids = pdf["_sid"].to_numpy()
            x, y = np.stack(pdf["x"].to_numpy()), pdf["y_s"].to_numpy(dtype=float)
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]
            for lo, hi in zip(edges, edges[1:]):
                if acc is not None and ids[lo] != sid:
                    yield done()
                    acc = None
                if acc is None:
                    sid, acc = ids[lo], [np.zeros((p, p)), np.zeros(p), 0.0, 0.0]
                own = x[lo:hi]
                acc[0] += own.T @ own
                acc[1] += own.T @ y[lo:hi]
                acc[2] += float(y[lo:hi] @ y[lo:hi])
                acc[3] += float(hi - lo)
        if acc is not None:
            yield done()
    return fn


GRAM_SCHEMA = "_sid string, xtx array<double>, xty array<double>, yty double, n double"


def gram(design: DataFrame, p: int) -> DataFrame:
    """Per-series ``X'X`` (flattened), ``X'y``, ``y'y``, ``n`` of a frame with ``_sid, x, y_s``.

    One partial per task and series (a local sort, no shuffle of rows); partials are merged by (series, task mod
    ``FANIN``) and then by series, always."""
    rows = design.select("_sid", "x", "y_s").filter(F.col("y_s").isNotNull()).sortWithinPartitions("_sid")
    parts = rows.mapInPandas(_partial_gram_fn(p), GRAM_SCHEMA).withColumn("_part", F.spark_partition_id() % FANIN)
    for keys in (["_sid", "_part"], ["_sid"]):
        parts = parts.groupBy(*keys).agg(sum_arrays("xtx", p * p).alias("xtx"), sum_arrays("xty", p).alias("xty"),
                                         F.sum("yty").alias("yty"), F.sum("n").alias("n"))
    return parts


# ---------------------------------------------------------------- solve


def _penalties(spec: ForecastSpec, n: float, sigma2: float) -> tuple[np.ndarray, np.ndarray]:
    """Ridge weights and L1 weights (on the sum-of-squares scale) per term."""
    n_trend, n_seas, n_reg = spec.blocks()
    p = n_trend + n_seas + n_reg
    ridge = np.zeros(p)
    l1 = np.zeros(p)
    if spec.trend_reg is not None:
        l1[2:n_trend] = spec.trend_reg * n
    elif spec.changepoint_prior_scale is not None:
        l1[2:n_trend] = 2.0 * sigma2 / spec.changepoint_prior_scale
    if spec.trend_prior_scale is not None:
        ridge[:2] = sigma2 / spec.trend_prior_scale ** 2
    if spec.seasonality_reg is not None:
        ridge[n_trend:n_trend + n_seas] = spec.seasonality_reg * n
    elif spec.seasonality_prior_scale is not None:
        ridge[n_trend:n_trend + n_seas] = sigma2 / spec.seasonality_prior_scale ** 2
    if spec.regressor_prior_scale is not None:
        ridge[n_trend + n_seas:] = sigma2 / spec.regressor_prior_scale ** 2
    return ridge, l1


def solve_penalized(xtx: np.ndarray, xty: np.ndarray, yty: float, n: float, spec: ForecastSpec) -> tuple[np.ndarray, float, bool]:
    """Penalised least squares from sufficient statistics; returns (beta, residual variance, converged): the noise
    variance that the penalties use and the reweighted L1 part are iterated to a fixed point."""
    p = len(xty)
    sigma2 = max(yty / max(n, 1.0) - (xty[0] / max(n, 1.0)) ** 2, 1e-12) if p else 1.0
    beta, converged = np.zeros(p), False
    for _ in range(VARIANCE_ROUNDS):
        ridge, l1 = _penalties(spec, n, sigma2)
        beta, inner = _reweighted(xtx, xty, ridge, l1, beta)
        sse = float(yty - 2.0 * beta @ xty + beta @ xtx @ beta)
        new = max(sse / max(n, 1.0), 1e-12)
        same = abs(new - sigma2) <= 1e-9 * max(sigma2, 1e-12)
        sigma2 = new
        if same or not (np.any(l1) or np.any(ridge)):
            converged = inner
            break
    return beta, sigma2, converged


#: Rounds after which a fit is reported as not converged.
VARIANCE_ROUNDS, L1_ROUNDS = 50, 500


def _reweighted(a: np.ndarray, b: np.ndarray, ridge: np.ndarray, l1: np.ndarray, start: np.ndarray, shift=0.0) -> tuple[np.ndarray, bool]:
    """Minimiser of x'ax/2 - b'x with ridge and L1 on (shift + x), the L1 part by reweighted ridge steps."""
    x = start.copy()
    for _ in range(L1_ROUNDS):
        lam = ridge + l1 / (2.0 * np.maximum(np.abs(shift + x), 1e-6))
        new = np.linalg.solve(a + np.diag(lam) + 1e-10 * np.eye(len(b)), b - lam * shift)
        close = np.max(np.abs(new - x), initial=0.0) < 1e-9 * max(1.0, float(np.max(np.abs(new), initial=0.0)))
        x = new
        if close or not np.any(l1):
            return x, True
    return x, False


MODEL_SCHEMA = "_sid string, beta array<double>, sigma double, sse double, n double, converged boolean, factor array<double>"


def _factor(a: np.ndarray, ridge: np.ndarray, l1: np.ndarray, beta: np.ndarray) -> list[float]:
    """Inverse of the triangular factor of the penalised Gram at ``beta``, row by row: a row x of the design has the
    coefficients' variance |factor x|^2 sigma^2. Directions that the data doesn't tell have none."""
    values, vectors = np.linalg.eigh(a + np.diag(ridge + l1 / (2.0 * np.maximum(np.abs(beta), 1e-6))))
    good = values > 1e-10 * max(float(values.max(initial=0.0)), 1e-300)
    root = vectors[:, good] / np.sqrt(values[good])
    # the same quadratic form by a triangle: R of the QR factors of the root's transpose
    tri = np.linalg.qr(root.T, mode="r") if root.size else np.zeros((0, len(beta)))
    out = np.zeros((len(beta), len(beta)))
    out[:len(tri)] = tri
    return out.ravel().tolist()


def _solve(grams: DataFrame, spec: ForecastSpec, p: int) -> DataFrame:
    """Solve each series' normal equations where its one Gram row lies."""

    def fn(batches):
        for pdf in batches:
            out = []
            for sid, xtx, xty, yty, n in pdf[["_sid", "xtx", "xty", "yty", "n"]].itertuples(index=False):
                beta, s2, ok = solve_penalized(np.asarray(xtx, dtype=float).reshape(p, p), np.asarray(xty, dtype=float), float(yty), float(n), spec)
                out.append((sid, beta.tolist(), math.sqrt(s2), s2 * n, n, ok, _factor(np.asarray(xtx, dtype=float).reshape(p, p), *_penalties(spec, n, s2), beta)))
            yield pd.DataFrame(out, columns=["_sid", "beta", "sigma", "sse", "n", "converged", "factor"])

    return grams.mapInPandas(fn, MODEL_SCHEMA)


def _model_table(coefs: DataFrame, stats: DataFrame, spec: ForecastSpec) -> DataFrame:
    terms = F.array(*[F.lit(t) for t in spec.term_names()])
    joined = with_constants(coefs, stats.drop("_sid", "n_obs")) if spec.scope == "global" else coefs.join(stats, "_sid", "inner")
    return joined.select(
        "_sid", terms.alias("terms"), "beta", "sigma", "n", "converged", "factor", "t0", "t1", "y_scale", "reg_mean", "reg_std", "changepoints",
        F.lit(spec.mode).alias("mode"))


def fit(df: DataFrame, spec: ForecastSpec, series_col: str = "series_id", y: str = "y") -> DataFrame:
    """Fit on rows with a target; returns the model table (one row per series)."""
    df = df.filter(F.col(y).isNotNull())
    stats = history_stats(df, spec, series_col, y)
    design = design_frame(df, stats, spec, series_col, y)
    p = len(spec.term_names())
    if spec.mode == "additive":
        return _model_table(_solve(gram(design, p), spec, p), stats, spec)
    return _fit_multiplicative(design, stats, spec, p)


def _fit_multiplicative(design: DataFrame, stats: DataFrame, spec: ForecastSpec, p: int) -> DataFrame:
    """Gauss-Newton on the bilinear model y = g * s, g = A theta (trend block), s = 1 + F beta (seasonal and
    regressor block).  Each iteration is ONE Gram pass over the Jacobian rows [s * A, g * F] with the current
    residual as target; the same Gram gives the current SSE.  Start: additive trend-only fit, beta = 0.

    The design is cut from lineage once (checkpoint in the shared folder); the parameter table (one row per
    series) is checkpointed every iteration, so iteration k never recomputes earlier ones.
    """
    from dataclasses import replace

    from hourwise.session import cut_lineage

    n_trend, n_seas, n_reg = spec.blocks()
    design = cut_lineage(design.select("_sid", "ds", "trend_x", F.concat("seas_x", "reg_x").alias("f_x"), "y_s"))
    trend_spec = replace(spec, yearly=0, weekly=0, daily=0, seasonalities=(), regressors=(), mode="additive")
    t0 = _solve(gram(design.withColumn("x", F.col("trend_x")), n_trend), trend_spec, n_trend)
    params = cut_lineage(t0.select("_sid", F.col("beta").alias("theta"),
                                   F.array_repeat(F.lit(0.0), n_seas + n_reg).alias("phi"), "n"))
    prev_sse, done = None, False
    for _ in range(spec.max_rounds):
        g = _dot("trend_x", "theta")
        sfac = F.lit(1.0) + _dot("f_x", "phi")
        jac = _with_params(design, params.select("_sid", "theta", "phi"), spec).select(
            "_sid", F.concat(F.transform("trend_x", lambda v: v * sfac), F.transform("f_x", lambda v: v * g)).alias("x"),
            (F.col("y_s") - g * sfac).alias("y_s"))
        gm = _with_params(gram(jac, p), params.select("_sid", "theta", "phi"), spec)
        step = cut_lineage(gm.mapInPandas(_gn_step_fn(spec, n_trend, n_seas, n_reg), GN_SCHEMA), "gauss-newton")
        sse = step.agg(F.sum("sse")).first()[0] or 0.0
        params = step
        if prev_sse is not None and abs(prev_sse - sse) <= spec.tol * max(prev_sse, 1e-12):
            done = True
            break
        prev_sse = sse
    both = params.select("_sid", F.concat("theta", "phi").alias("beta"), "sigma", "n", (F.col("converged") & F.lit(done)).alias("converged"), "factor")
    return _model_table(both, stats, spec)


def _with_params(df: DataFrame, params: DataFrame, spec: ForecastSpec) -> DataFrame:
    return with_constants(df, params.drop("_sid")) if spec.scope == "global" else df.join(params, "_sid")


GN_SCHEMA = "_sid string, theta array<double>, phi array<double>, sigma double, sse double, n double, converged boolean, factor array<double>"


#: Share of the Gram's diagonal that is added to it in a Gauss-Newton step; it changes the path, not the end.
DAMPING = 1e-3


def _gn_step_fn(spec: ForecastSpec, n_trend: int, n_seas: int, n_reg: int):
    """One Gauss-Newton step per series from the Jacobian Gram: minimise ||r - J d||^2 + penalties on the
    updated parameters (ridge; L1 on the hinges)."""
    p = n_trend + n_seas + n_reg

    def fn(batches):
        for pdf in batches:
            out = []
            for sid, xtx, xty, yty, n, theta, phi in pdf[["_sid", "xtx", "xty", "yty", "n", "theta", "phi"]].itertuples(index=False):
                cur = np.concatenate([np.asarray(theta, dtype=float), np.asarray(phi, dtype=float)])
                sigma2 = max(float(yty) / max(n, 1.0), 1e-12)  # SSE at the current parameters
                ridge, l1 = _penalties(spec, n, sigma2)
                jtj = np.asarray(xtx, dtype=float).reshape(p, p)
                # damped where trend and seasons explain the same (a daily season of daily data)
                d, ok = _reweighted(jtj + DAMPING * np.diag(np.diag(jtj)), np.asarray(xty, dtype=float), ridge, l1, np.zeros(p), cur)
                new = cur + d
                out.append((sid, new[:n_trend].tolist(), new[n_trend:].tolist(), math.sqrt(sigma2), float(yty), n, ok, _factor(jtj, ridge, l1, new)))
            yield pd.DataFrame(out, columns=["_sid", "theta", "phi", "sigma", "sse", "n", "converged", "factor"])

    return fn


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda u, v: u * v), F.lit(0.0), lambda acc, z: acc + z)


# ---------------------------------------------------------------- predict


def predict(model: DataFrame, future: DataFrame, spec: ForecastSpec, series_col: str = "series_id",
            intervals: bool | str = True) -> DataFrame:
    """G6 + G7: components and ``yhat`` for rows carrying ``ds`` (and the regressors); the model table
    (one row per series) is joined on the series key.  Interval: ``yhat +/- z * sigma`` (residual noise), or with
    ``intervals="predictive"`` one that widens: the noise, the coefficients' own uncertainty (the model's ``factor``),
    and, after the history's end, trend changes to come. These are as frequent as the model's changepoints and as large
    as its changes are on average (Laplace), and add up to a variance in closed form; nothing is simulated.
    Rows of a series without a model stay, with NULL predictions (``without_model`` lists these series)."""
    wide = intervals == "predictive"
    also = ("beta", "sigma", "factor") if wide else ("beta", "sigma")
    table = model.select("_sid", "t0", "t1", "y_scale", "reg_mean", "reg_std", "changepoints", *also)
    d = design_frame(future, table, spec, series_col, y=None, also=also)
    keep = [c for c in d.columns if c in (series_col,)]
    n_trend, n_seas, n_reg = spec.blocks()
    b = F.col("beta")

    def part(col, start, size):
        if size == 0:
            return F.lit(0.0)
        return F.aggregate(F.zip_with(F.col(col), F.slice(b, start + 1, size), lambda u, v: u * v), F.lit(0.0), lambda a, z: a + z)

    trend = part("trend_x", 0, n_trend)
    seas = part("seas_x", n_trend, n_seas)
    reg = part("reg_x", n_trend + n_seas, n_reg)
    if spec.mode == "multiplicative":
        yhat_s = trend * (F.lit(1.0) + seas + reg)
    else:
        yhat_s = trend + seas + reg
    ys = F.col("y_scale")
    sigma = F.col("sigma")
    if wide:
        season = F.lit(1.0) + seas + reg if spec.mode == "multiplicative" else F.lit(1.0)
        sigma = F.sqrt(sigma * sigma * (F.lit(1.0) + _spread(spec, trend, season)) + season * season * _coming_changes(spec))
    out = d.select(*keep, "ds", (trend * ys).alias("trend"), (seas * ys).alias("seasonal"), (reg * ys).alias("regressors"),
                   (yhat_s * ys).alias("yhat"), (sigma * ys).alias("_sig"))
    if intervals:
        z = spec.z()
        out = out.withColumn("yhat_lower", F.col("yhat") - F.lit(z) * F.col("_sig")).withColumn(
            "yhat_upper", F.col("yhat") + F.lit(z) * F.col("_sig"))
    return out.drop("_sig")


def _spread(spec: ForecastSpec, trend: Column, season: Column) -> Column:
    """|factor x|^2 of a row of the design (for a multiplicative model, of its derivatives in the coefficients)."""
    p = sum(spec.blocks())
    x = F.col("x")
    if spec.mode == "multiplicative":
        x = F.concat(F.transform("trend_x", lambda v: v * season), F.transform(F.concat("seas_x", "reg_x"), lambda v: v * trend))
    dot = lambda i: F.aggregate(F.zip_with(F.slice("factor", i * p + 1, p), x, lambda u, v: u * v), F.lit(0.0), lambda a, z: a + z)
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda i: F.pow(dot(i), F.lit(2.0))), F.lit(0.0), lambda a, z: a + z)


def _coming_changes(spec: ForecastSpec) -> Column:
    """Variance of the trend from changes after the history's end: n changes a history, each Laplace with the mean size of
    the model's, at even risk: n 2 size^2 h^3 / 3 for h histories ahead."""
    n = spec.n_changepoints
    if not n:
        return F.lit(0.0)
    size = F.aggregate(F.transform(F.slice("beta", 3, n), lambda v: F.abs(v)), F.lit(0.0), lambda a, z: a + z) / F.lit(float(n))
    ahead = F.greatest(F.col("t") - F.lit(1.0), F.lit(0.0))
    return F.lit(2.0 * n / 3.0) * size * size * ahead * ahead * ahead


def without_model(model: DataFrame, future: DataFrame, series_col: str = "series_id") -> DataFrame:
    """Series of ``future`` that have no row in the model table (``predict`` gives them NULLs)."""
    known = model.select(F.nullif("_sid", F.lit(NULL_ID)).alias(series_col))
    return null_safe_join(future.select(series_col).distinct(), known, [series_col], "left_anti")


def coefficients(model: DataFrame) -> DataFrame:
    """Model table in long form ``(series, term, coef)`` for reports and the rows-only check."""
    return model.select("_sid", F.explode(F.arrays_zip("terms", "beta")).alias("e")).select(
        F.col("_sid").alias("series_id"), F.col("e.terms").alias("term"), F.col("e.beta").alias("coef"))
