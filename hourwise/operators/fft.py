"""Whole Fourier spectra of long series (X8) by a four-step transform.

The N values of a series are read as a matrix of N1 x N2. Columns are transformed on their own (groups of N1 values),
multiplied by powers of the N-th root of unity, and dealt anew by row; rows are transformed (groups of N2 values). One
shuffle transposes the matrix, and no task holds more than one column or row, about the root of N.

A length without balanced divisors goes through the chirp transform: a product of chirps makes the spectrum a circular
convolution of any larger length, taken as a power of two and done by three four-step transforms. Angles are reduced in
integers first, so long series keep their digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.operators.joins import null_safe_join, with_constants
from hourwise.operators.ordered import _cols, seq_index
from hourwise.session import cut_lineage

#: Rows over columns of a length that is transformed directly, at most.
UNBALANCE = 8


def _shape(n: int) -> tuple[int, int, bool]:
    """(columns' length, rows' length, whether the chirp transform is needed) for a series of ``n`` values."""
    for a in range(isqrt(n), 0, -1):
        if n % a == 0:
            if n // a <= UNBALANCE * a:
                return a, n // a, False
            break
    bits = (2 * n - 2).bit_length()
    return 1 << bits // 2, 1 << bits - bits // 2, True


def _lengths(sizes: DataFrame) -> DataFrame:
    """(keys, n) with the transform's shape: _n1, _n2, _chirp; one row per series."""

    def run(batches):
        for pdf in batches:
            shapes = [_shape(int(n)) for n in pdf["_n"]]
            yield pdf.assign(_n1=[s[0] for s in shapes], _n2=[s[1] for s in shapes], _chirp=[s[2] for s in shapes])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sizes.schema.fields)
    return sizes.mapInPandas(run, f"{schema}, _n1 long, _n2 long, _chirp boolean")


def _keyed(rows: DataFrame, pc: list[str]) -> str:
    return "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in pc)


def four_step(rows: DataFrame, pc: list[str], inverse: bool = False) -> DataFrame:
    """(keys, _n, _n1, _n2, _t, _re, _im): the transform of length n1 n2 of each series; absent positions are zeros.
    The inverse isn't scaled."""
    keys = _keyed(rows, pc)
    sign = 1.0 if inverse else -1.0

    def column(pdf: pd.DataFrame) -> pd.DataFrame:
        n, n1, n2, j = (int(pdf[c].iat[0]) for c in ("_n", "_n1", "_n2", "_j"))
        z = np.zeros(n1, dtype=complex)
        z[pdf["_t"].to_numpy() // n2] = pdf["_re"].to_numpy() + 1j * pdf["_im"].to_numpy()
        z = np.fft.ifft(z) * n1 if inverse else np.fft.fft(z)
        k = np.arange(n1, dtype=np.int64)
        z = z * np.exp(sign * 2j * np.pi * (j * k % (n1 * n2)) / (n1 * n2))
        return pd.DataFrame({**{c: [pdf[c].iat[0]] * n1 for c in pc}, "_n": n, "_n1": n1, "_n2": n2, "_j": j, "_k": k, "_re": z.real, "_im": z.imag})

    def row(pdf: pd.DataFrame) -> pd.DataFrame:
        n, n1, n2, k = (int(pdf[c].iat[0]) for c in ("_n", "_n1", "_n2", "_k"))
        z = np.zeros(n2, dtype=complex)
        z[pdf["_j"].to_numpy()] = pdf["_re"].to_numpy() + 1j * pdf["_im"].to_numpy()
        z = np.fft.ifft(z) * n2 if inverse else np.fft.fft(z)
        return pd.DataFrame({**{c: [pdf[c].iat[0]] * n2 for c in pc}, "_n": n, "_n1": n1, "_n2": n2, "_t": k + n1 * np.arange(n2, dtype=np.int64), "_re": z.real, "_im": z.imag})

    columns = rows.withColumn("_j", F.pmod(F.col("_t"), F.col("_n2"))).groupBy(*pc, "_j").applyInPandas(
        column, keys + "_n long, _n1 long, _n2 long, _j long, _k long, _re double, _im double")
    return columns.groupBy(*pc, "_k").applyInPandas(row, keys + "_n long, _n1 long, _n2 long, _t long, _re double, _im double")


def _turned(rows: DataFrame, sign: float) -> DataFrame:
    """Values times exp(sign i pi t^2 / n); t^2 is reduced modulo 2 n without leaving the longs."""
    t, n2 = F.col("_t"), F.col("_n") * 2
    # t^2 mod 2n by halves of 2^20, exact up to 2^40 positions
    high, low = F.shiftright(t, 20), t.bitwiseAND(F.lit((1 << 20) - 1))
    square = F.pmod(F.pmod(F.pmod(high * high, n2) * F.lit(1 << 20), n2) * F.lit(1 << 20) + F.pmod(high * low * 2, n2) * F.lit(1 << 20) + low * low, n2)
    angle = F.lit(sign * np.pi) * square / F.col("_n")
    re, im = F.col("_re"), F.col("_im")
    return rows.withColumns({"_re": re * F.cos(angle) - im * F.sin(angle), "_im": re * F.sin(angle) + im * F.cos(angle)})


def _chirp(rows: DataFrame, lengths: DataFrame, pc: list[str]) -> DataFrame:
    m = F.col("_n1") * F.col("_n2")
    near = lengths.select(*pc, "_n", "_n1", "_n2", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / 4096))).alias("_c"))
    near = near.select(*pc, "_n", "_n1", "_n2", F.explode(F.sequence(F.col("_c") * 4096, F.least(F.col("_n"), (F.col("_c") + 1) * 4096) - 1)).alias("_t"))
    one = _turned(near.withColumns({"_re": F.lit(1.0), "_im": F.lit(0.0)}), 1.0)
    # the chirp lies around position 0 of the circle
    kernel = one.unionByName(one.filter(F.col("_t") > 0).withColumn("_t", m - F.col("_t")))
    a, b = four_step(_turned(rows, -1.0), pc), four_step(kernel, pc)
    b = b.select(*pc, "_t", F.col("_re").alias("_br"), F.col("_im").alias("_bi"))
    re, im, br, bi = (F.col(c) for c in ("_re", "_im", "_br", "_bi"))
    product = null_safe_join(a, b, [*pc, "_t"], "inner").withColumns({"_re": re * br - im * bi, "_im": re * bi + im * br}).drop("_br", "_bi")
    back = four_step(product, pc, inverse=True).filter(F.col("_t") < F.col("_n"))
    return _turned(back.withColumns({"_re": re / m, "_im": im / m}), -1.0)


def fft_long(df: DataFrame, col: str = "y", partition_cols: Sequence[str] = ("series_id",), order_col: str = "ds") -> DataFrame:
    """All Fourier coefficients of each series, one row for each frequency k = 0 ... N - 1: re, im, magnitude (numpy's
    ``fft`` of the ordered values). Missing values (NULL, NaN) are zeros; a NULL series is a series; rows of equal time and
    without a time are placed as in ``seq_index``; an empty table gives an empty result."""
    pc = _cols(partition_cols)
    x = F.col(f"`{col}`").cast("double")
    rows = seq_index(df, pc, order_col, out="_t").select(*pc, "_t", F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x).alias("_re"), F.lit(0.0).alias("_im"))
    sizes = rows.groupBy(*pc).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 0)
    lengths = cut_lineage(_lengths(sizes), "fft-lengths")
    kinds = {r[0] for r in lengths.select("_chirp").distinct().collect()}
    parts = []
    for chirp in (False, True):
        own = lengths.filter(F.col("_chirp") == chirp).drop("_chirp")
        if chirp in kinds or not (kinds or chirp):
            there = null_safe_join(rows, own, pc, "inner") if pc else with_constants(rows, own)
            parts.append(_chirp(there, own, pc) if chirp else four_step(there, pc))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(*pc, F.col("_t").alias("k"), F.col("_re").alias("re"), F.col("_im").alias("im"), F.hypot("_re", "_im").alias("magnitude"))
