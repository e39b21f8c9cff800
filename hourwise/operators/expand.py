"""Feature expansion (X1-X9): cyclic and Fourier terms, interactions, polynomial terms, DFT."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.operators.joins import null_safe_join, with_constants
from hourwise.functions.names import is_derived
from hourwise.operators.ordered import _cols, seq_index

TWO_PI = 2.0 * math.pi


def cyclic(df: DataFrame, col: str, period: float, name: str | None = None) -> DataFrame:
    """``sin/cos(2*pi*x/period)`` as ``sin_{name}``, ``cos_{name}``."""
    name = name or col
    ang = F.lit(TWO_PI) * F.col(col) / F.lit(float(period))
    return df.select("*", F.sin(ang).alias(f"sin_{name}"), F.cos(ang).alias(f"cos_{name}"))


def fourier(df: DataFrame, period: float = 168, order: int = 5, t_col: str | None = None,
            partition_cols=("series_id",), order_col: str = "ds", mode: str = "chunked") -> DataFrame:
    """``sin_{period}_{i}``, ``cos_{period}_{i}`` for i = 1..order of ``t`` = row position from 0
    (``seq_index``), or of an existing ``t_col`` (e.g. epoch hours, gap-safe)."""
    base = df
    if t_col is None:
        base = seq_index(df, partition_cols, order_col, out="_t", mode=mode)
        t = F.col("_t")
    else:
        t = F.col(t_col)
    p = int(period) if float(period).is_integer() else period
    terms = []
    for i in range(1, order + 1):
        ang = F.lit(TWO_PI * i) * t / F.lit(float(period))
        terms += [F.sin(ang).alias(f"sin_{p}_{i}"), F.cos(ang).alias(f"cos_{p}_{i}")]
    out = base.select("*", *terms)
    return out.drop("_t") if t_col is None else out


def interactions(df: DataFrame, cols: Sequence[str], sep: str = "_x_", exclude_derived: bool = False) -> DataFrame:
    """All pairwise products ``{a}{sep}{b}`` in one projection; optionally skip lag/rolling/EMA columns."""
    cols = [c for c in cols if not (exclude_derived and is_derived(c))]
    pairs = list(itertools.combinations(cols, 2))
    return df.select("*", *[(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"{a}{sep}{b}") for a, b in pairs])


def interact_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], sep: str = "_x_") -> DataFrame:
    """Listed pairs only."""
    return df.select("*", *[(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"{a}{sep}{b}") for a, b in pairs])


def polynomial(df: DataFrame, cols: Sequence[str], degree: int = 2, keep_linear: bool = False) -> DataFrame:
    """All monomials of degree 2..``degree`` (and 1 when ``keep_linear``), no bias.

    Names: ``a__p2`` for squares, ``a__b`` for products; the display name (``a^2``, ``a b``) is kept in the
    column metadata under ``display``.
    """
    cols = list(cols)
    terms = []
    start = 1 if keep_linear else 2
    for d in range(start, degree + 1):
        for combo in itertools.combinations_with_replacement(cols, d):
            expr = F.lit(1.0)
            for c in combo:
                expr = expr * F.col(f"`{c}`")
            counts = {c: combo.count(c) for c in dict.fromkeys(combo)}
            name = "__".join(c if k == 1 else f"{c}__p{k}" for c, k in counts.items())
            display = " ".join(c if k == 1 else f"{c}^{k}" for c, k in counts.items())
            if d == 1:
                name = f"{combo[0]}__p1"
            terms.append(expr.alias(name, metadata={"display": display}))
    return df.select("*", *terms)


def dft(df: DataFrame, col: str = "y", ks: Sequence[int] = (1, 2, 3), partition_cols=("series_id",),
        order_col: str = "ds", mode: str = "chunked") -> DataFrame:
    """Discrete Fourier coefficients of the series (missing -> 0) at the requested frequencies:
    ``re = sum x_t cos(2 pi k t / N)``, ``im = -sum x_t sin(2 pi k t / N)``, ``magnitude = |re + i im|``
    (numpy FFT convention).  Rows x frequencies are combined with a broadcast of the small ``ks`` table
    (size fixed by the argument) and reduced by (series, k) with map-side partial sums.
    """
    pc = _cols(partition_cols)
    indexed = seq_index(df, pc, order_col, out="_t", mode=mode)
    size = F.count(F.lit(1)).alias("_n")
    x = F.coalesce(F.col(col).cast("double"), F.lit(0.0))
    rows = indexed.select(*pc, "_t", x.alias("_x"))
    rows = null_safe_join(rows, df.groupBy(*pc).agg(size), pc) if pc else with_constants(rows, df.agg(size))
    # one output row per requested frequency: a fixed-size explode, not a join
    freq = rows.select(*pc, "_t", "_x", "_n", F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    # whole turns are taken off in integers first, so that long series keep their digits
    ang = F.lit(TWO_PI) * F.pmod(F.col("k") * F.col("_t"), F.col("_n")) / F.col("_n")
    prod = freq.select(*pc, "k", (F.col("_x") * F.cos(ang)).alias("_c"), (F.col("_x") * F.sin(ang)).alias("_s"))
    agg = prod.groupBy(*pc, "k").agg(F.sum("_c").alias("re"), (-F.sum("_s")).alias("im"))
    return agg.select(*pc, "k", "re", "im", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("magnitude"))


def spectrum(df: DataFrame, col: str, partition_cols: Sequence[str], order_col: str = "ds", prefix: str = "fft") -> DataFrame:
    """X8, row-attached: each row gets the Fourier coefficient (missing -> 0) whose number is the row's position in its
    series: ``{prefix}_re``, ``{prefix}_im``, ``{prefix}_abs``. For many short series: a series is one group of one
    task (``dft`` gives chosen frequencies of long ones)."""
    import numpy as np

    pc = list(partition_cols)
    names = [f"{prefix}_{x}" for x in ("re", "im", "abs")]

    def run(pdf):
        pdf = pdf.sort_values(order_col)
        z = np.fft.fft(pdf[col].astype(float).fillna(0.0).to_numpy())
        return pdf.assign(**dict(zip(names, (z.real, z.imag, np.abs(z)))))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + ", ".join(f"{n} double" for n in names)
    return df.groupBy(*pc).applyInPandas(run, schema)
