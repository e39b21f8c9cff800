"""Quadratic spline interpolation through all known points (M6), for series of any length.

The spline of order 2 has one coefficient for each known point and knots midway between known points (none next to the
ends); requiring its value at each point gives a tridiagonal system over the whole series. The system is solved in parts:
each chunk of points is eliminated towards the two unknowns outside it (three right-hand sides), the chunks' first and
last unknowns make a small system of their own, and its solution is put back into the chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.operators.joins import null_safe_join
from hourwise.operators.ordered import DEFAULT_CHUNK, _cols, _replace, ensure_pos, fill_multi, seq_index
from hourwise.session import cut_lineage


def _basis(x, a, b, c, d):
    """Values at x (in [b, c]) of the three quadratic B-splines that live there, for knots a <= b < c <= d."""
    left = (c - x) ** 2 / ((c - a) * (c - b))
    right = (x - b) ** 2 / ((d - b) * (c - b))
    return left, 1 - left - right, right


def _knots(x: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    """Knots (a, b, c, d) of the rows ``i`` (inner points) from the points' places ``x`` (five for each row, two on each
    side; what lies outside the series isn't looked at)."""
    first, last = x[np.arange(len(i)), 2 - np.minimum(i, 2)], x[np.arange(len(i)), 2 + np.minimum(n - 1 - i, 2)]
    mid = (x[:, 1:] + x[:, :-1]) / 2
    return np.column_stack([np.where(i <= 2, first, mid[:, 0]), np.where(i <= 1, first, mid[:, 1]),
                            np.where(i + 2 >= n, last, mid[:, 2]), np.where(i + 3 >= n, last, mid[:, 3])])


def _thomas(low: np.ndarray, diag: np.ndarray, up: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a tridiagonal system for several right-hand sides (columns)."""
    n = len(diag)
    c, d = np.empty(n), np.empty_like(right)
    c[0], d[0] = up[0] / diag[0], right[0] / diag[0]
    for k in range(1, n):
        m = diag[k] - low[k] * c[k - 1]
        c[k] = up[k] / m
        d[k] = (right[k] - low[k] * d[k - 1]) / m
    for k in range(n - 2, -1, -1):
        d[k] -= c[k] * d[k + 1]
    return d


def _eliminated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a chunk's points (with two more on each side): knots, and the coefficient as g - v left - w right in the
    coefficients before and after the chunk."""
    pdf = pdf.sort_values("_i")
    own = np.flatnonzero(pdf["_own"].to_numpy())
    at, n = pdf["_i"].to_numpy()[own], int(pdf["_n"].iat[0])
    padded = np.concatenate([[0.0] * 2, pdf["_x"].to_numpy(float), [0.0] * 2])
    x = padded[own[:, None] + np.arange(5)]
    knots = _knots(x, at, n)
    inner = (at > 0) & (at < n - 1)
    low, diag, up = np.zeros(len(at)), np.ones(len(at)), np.zeros(len(at))
    low[inner], diag[inner], up[inner] = _basis(x[inner, 2], *knots[inner].T)
    right = np.zeros((len(at), 3))
    right[:, 0] = pdf["_y"].to_numpy(float)[own]
    right[0, 1], right[-1, 2] = low[0], up[-1]
    g = _thomas(low, diag, up, right)
    out = pdf.iloc[own].drop(columns=["_own"]).reset_index(drop=True)
    return out.assign(_a=knots[:, 0], _b=knots[:, 1], _c=knots[:, 2], _d=knots[:, 3], _g=g[:, 0], _v=g[:, 1], _w=g[:, 2])


def _coupled(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Coefficients before and after each chunk of a series, from the chunks' first and last rows: two unknowns a chunk."""
    pdf = pdf.sort_values("_part")
    k = len(pdf)
    first, last = pdf[["_g0", "_v0", "_w0"]].to_numpy(float), pdf[["_g1", "_v1", "_w1"]].to_numpy(float)
    # elimination from the left: last = p - q * (first of the next chunk)
    p, q = np.zeros(k), np.zeros(k)
    for j in range(k):
        before, gain = (p[j - 1], q[j - 1]) if j else (0.0, 0.0)
        # first = g - v (before - gain first) - w next, and so on for last
        scale = 1 - first[j, 1] * gain
        a, b = (first[j, 0] - first[j, 1] * before) / scale, first[j, 2] / scale
        p[j] = last[j, 0] - last[j, 1] * (before - gain * a)
        q[j] = last[j, 2] + last[j, 1] * gain * b
    left, right = np.zeros(k), np.zeros(k)
    ahead = 0.0
    for j in range(k - 1, -1, -1):
        before, gain = (p[j - 1], q[j - 1]) if j else (0.0, 0.0)
        scale = 1 - first[j, 1] * gain
        own = (first[j, 0] - first[j, 1] * before - first[j, 2] * ahead) / scale
        left[j], right[j] = before - gain * own, ahead
        ahead = own
    return pdf[[*keys, "_part"]].reset_index(drop=True).assign(_left=left, _right=right)


def _solved(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Each known point with the three coefficients and four knots that the spline has around it (the ends: those of their
    inner neighbour)."""
    pdf = pdf.sort_values("_i").reset_index(drop=True)
    left, right = float(pdf["_left"].iat[0]), float(pdf["_right"].iat[0])
    u = (pdf["_g"] - pdf["_v"] * left - pdf["_w"] * right).to_numpy(float)
    u = np.concatenate([[left], u, [right]])
    at, n = pdf["_i"].to_numpy(), int(pdf["_n"].iat[0])
    row = np.arange(len(at)) + (at == 0) - (at == n - 1)
    out = pdf[[*keys, "_x", "_y"]].copy()
    for name in ("_a", "_b", "_c", "_d"):
        out[name] = pdf[name].to_numpy(float)[row]
    for j, name in enumerate(("_u0", "_u1", "_u2")):
        out[name] = u[row + j]
    return out


def spline_coefficients(known: DataFrame, pc: list[str], chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """(keys, _x, _y, _a .. _d, _u0 .. _u2) of the known points (keys, _x, _y) of series with three points or more."""
    kind = "".join(f"`{c}` {known.schema[c].dataType.simpleString()}, " for c in pc)
    chunk = max(4, int(chunk))
    rows = seq_index(known, pc, "_x", out="_i")
    sizes = rows.groupBy(*pc).agg(F.count(F.lit(1)).alias("_n"))
    rows = cut_lineage(null_safe_join(rows, sizes, pc, "inner").filter(F.col("_n") > 2), "spline-points")
    # the last chunk takes what is left over, so no chunk is shorter than the others
    parts = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(chunk)))
    part = lambda i: F.greatest(F.lit(0), F.least(F.floor(i / F.lit(chunk)), parts - 1))
    i = F.col("_i")
    spread = rows.withColumn("_at", part(i)).withColumn("_part", F.explode(F.sequence(part(i - 2), part(i + 2))))
    spread = spread.withColumn("_own", F.col("_at") == F.col("_part")).drop("_at")
    schema = kind + "_x double, _y double, _i long, _n long, _part long"
    spread = spread.select(*pc, F.col("_x").cast("double").alias("_x"), F.col("_y").cast("double").alias("_y"), "_i", "_n", "_part", "_own")
    chunks = cut_lineage(spread.groupBy(*pc, "_part").applyInPandas(_eliminated, schema + ", _a double, _b double, _c double, _d double, _g double, _v double, _w double"), "spline-chunks")
    ends = chunks.groupBy(*pc, "_part").agg(*[f(F.col(f"_{c}"), F.col("_i")).alias(f"_{c}{j}") for j, f in ((0, F.min_by), (1, F.max_by)) for c in "gvw"])
    around = ends.groupBy(*pc).applyInPandas(lambda pdf: _coupled(pdf, pc), kind + "_part long, _left double, _right double")
    both = null_safe_join(chunks, around, [*pc, "_part"], "inner")
    return both.groupBy(*pc, "_part").applyInPandas(lambda pdf: _solved(pdf, pc), kind + "_x double, _y double, _a double, _b double, _c double, _d double, _u0 double, _u1 double, _u2 double")


def interpolate_spline(df: DataFrame, cols, partition_cols=("series_id",), order_col: str = "ds", chunk: int = DEFAULT_CHUNK,
                       pos_col: str | None = None) -> DataFrame:
    """M6: missing values (NULL, NaN) lie on the quadratic spline through all known points of the series, in row position.
    A leading gap stays NULL and a trailing one takes the last known value; series with two known points or fewer are
    interpolated on a line. A NULL series is a series; rows without a time come last; known values and other columns stay
    as they are; an empty table gives an empty one."""
    pc = _cols(partition_cols)
    base = df.columns
    df, pos, _ = ensure_pos(df, pc, order_col, pos_col)
    for c in _cols(cols):
        v = F.col(f"`{c}`").cast("double")
        df = cut_lineage(df.withColumn("_value", F.when(~F.isnan(v), v)), "spline-rows")
        known = df.filter(F.col("_value").isNotNull()).select(*pc, F.col(pos).alias("_x"), F.col("_value").alias("_y"))
        around = spline_coefficients(known, pc, chunk)
        names = ("_a", "_b", "_c", "_d", "_u0", "_u1", "_u2")
        side = around.select(*pc, F.col("_x").cast("long").alias(pos), F.struct(*names).alias("_s"))
        at = null_safe_join(df, side, [*pc, pos])
        at = at.withColumn("_known", F.when(F.col("_value").isNotNull(), F.struct(F.col(pos).alias("p"), F.col("_value").alias("v"), F.col("_s").alias("s")))).drop("_s")
        at = fill_multi(at, [("_known", "forward", "_before", False), ("_known", "backward", "_after", False)], pc, order_col, "chunked", DEFAULT_CHUNK, pos)
        x, p, q = F.col(pos).cast("double"), F.col("_before"), F.col("_after")
        s = F.when(x < (p["p"] + q["p"]) / F.lit(2.0), p["s"]).otherwise(q["s"])
        one, two, three = _basis(x, s["_a"], s["_b"], s["_c"], s["_d"])
        spline = s["_u0"] * one + s["_u1"] * two + s["_u2"] * three
        line = p["v"] + (q["v"] - p["v"]) * (x - p["p"]) / (q["p"] - p["p"])
        value = (F.when(F.col("_value").isNotNull(), F.col("_value")).when(p.isNull(), F.lit(None)).when(q.isNull(), p["v"])
                 .when(s.isNull(), line).otherwise(spline))
        df = _replace(at, [c], [value]).drop("_value", "_known", "_before", "_after")
    return df.select(*[F.col(f"`{c}`") for c in base])
