"""Model-based selectors (L7-L9): cross-validated Lasso, recursive elimination with random forests, PCA.

``lasso_cv`` works from sufficient statistics: one data pass builds the Gram ``[1, X]'[1, X]``, ``[1, X]'y``,
``y'y`` of every contiguous fold (the ``model.gram`` tree reduction keyed by fold).  Training statistics of
fold k are total minus fold k; the held-out error is exact from the fold's own Gram.  Coordinate descent over
the whole alpha path then runs on p x p matrices in one ``applyInPandas`` group of K rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.operators.joins import with_constants
from hourwise.operators.ordered import seq_index
from hourwise.plans.model import gram


def contiguous_folds(df: DataFrame, k: int, order_col: str = "ds") -> DataFrame:
    """Fold id 0..k-1 by row position (``KFold`` without shuffling)."""
    # equal times are put in order by a hash of the rows' values; identical rows are interchangeable
    idx = seq_index(df, (), order_col, out="_pos")
    j = with_constants(idx, df.agg(F.count(F.lit(1)).alias("_n")))
    # sklearn KFold: the first n % k folds hold one extra row
    base = F.floor(F.col("_n") / F.lit(k))
    extra = F.col("_n") % F.lit(k)
    big = (base + 1) * extra
    fold = F.when(F.col("_pos") < big, F.floor(F.col("_pos") / (base + 1))).otherwise(
        extra + F.floor((F.col("_pos") - big) / base))
    return j.withColumn("_fold", fold.cast("int")).drop("_n", "_pos")


def _cd_path(C: np.ndarray, c: np.ndarray, n: float, alphas: np.ndarray, tol: float = 1e-4, max_iter: int = 1000):
    """Coordinate descent for (1/2n)||y - Xb||^2 + a||b||_1 on centred statistics; warm starts along the path.
    Stops when the largest update is below ``tol`` times the largest coefficient (the sklearn criterion)."""
    p = len(c)
    b = np.zeros(p)
    diag = np.diag(C).copy()
    out = []
    for a in alphas:
        for _ in range(max_iter):
            delta = 0.0
            for j in range(p):
                if diag[j] <= 0:
                    continue
                rho = c[j] - C[j] @ b + diag[j] * b[j]
                new = np.sign(rho) * max(abs(rho) - a * n, 0.0) / diag[j]
                delta = max(delta, abs(new - b[j]))
                b[j] = new
            if delta < tol * max(1.0, np.max(np.abs(b))):
                break
        out.append(b.copy())
    return out


def _centred(xtx, xty, yty, n):
    xbar = xtx[0, 1:] / n
    ybar = xty[0] / n
    C = xtx[1:, 1:] - n * np.outer(xbar, xbar)
    c = xty[1:] - n * xbar * ybar
    return C, c, xbar, ybar


def lasso_cv(df: DataFrame, cols: Sequence[str], target: str = "y", folds: int = 10, n_alphas: int = 100,
             eps: float = 1e-3, order_col: str = "ds") -> DataFrame:
    """LassoCV (contiguous folds, alpha grid from alpha_max down to eps * alpha_max, intercept fitted,
    no standardisation); returns ``(feature, coef, alpha, selected)`` of the refit at the best alpha."""
    from hourwise.session import cut_lineage

    cols = list(cols)
    p = len(cols) + 1
    # the regression input feeds fold positions, counts and the Gram: materialise it once
    data = contiguous_folds(cut_lineage(df.select(order_col, target, *cols).na.drop()), folds, order_col)
    design = data.select(F.col("_fold").cast("string").alias("_sid"),
                         F.array(F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in cols]).alias("x"),
                         F.col(target).cast("double").alias("y_s"))
    g = gram(design, p).withColumn("_grp", F.lit(0))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        Gs = {int(r["_sid"]): (np.asarray(r["xtx"]).reshape(p, p), np.asarray(r["xty"]), float(r["yty"]), float(r["n"]))
              for _, r in pdf.iterrows()}
        tot = [sum(v[i] for v in Gs.values()) for i in range(4)]
        C, c, _, _ = _centred(*tot)
        amax = np.max(np.abs(c)) / tot[3] if len(c) else 1.0
        alphas = np.logspace(math.log10(amax), math.log10(amax * eps), n_alphas) if amax > 0 else np.array([0.0])
        mse = np.zeros(len(alphas))
        for k, (xk, yk, yyk, nk) in Gs.items():
            tr = (tot[0] - xk, tot[1] - yk, tot[2] - yyk, tot[3] - nk)
            Ct, ct, xbar, ybar = _centred(*tr)
            path = _cd_path(Ct, ct, tr[3], alphas)
            for i, bta in enumerate(path):
                w = np.concatenate([[ybar - xbar @ bta], bta])
                sse = yyk - 2.0 * w @ yk + w @ xk @ w
                mse[i] += sse / nk
        best = int(np.argmin(mse / len(Gs)))
        b = _cd_path(C, c, tot[3], alphas[: best + 1])[-1]
        return pd.DataFrame({"feature": cols, "coef": b, "alpha": float(alphas[best]), "selected": b != 0})

    schema = "feature string, coef double, alpha double, selected boolean"
    return g.groupBy("_grp").applyInPandas(fn, schema)


#: Rows of a partition that the forests are grown on.
FOREST_PART = 1 << 18


def rfe_forest(df: DataFrame, cols: Sequence[str], target: str = "y", n_select: int = 10, num_trees: int = 100,
               max_depth: int = 12, seed: int = 42) -> DataFrame:
    """Recursive feature elimination with MLlib random forests, one feature per round; returns
    ``(feature, rank)`` (rank 1 = kept, larger = eliminated earlier). Every split tries all features. Rows are dealt and
    ordered by their values, so ranks don't follow the partitioning of ``df``; rows with a missing value are left out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from hourwise.session import cut_lineage

    remaining = list(cols)
    ranks: dict[str, int] = {}
    base = cut_lineage(df.select(target, *remaining).na.drop(), "rfe")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in base.columns])
    base = base.repartition(max(1, -(-base.count() // FOREST_PART)), row).sortWithinPartitions(row, *[F.col(f"`{c}`") for c in base.columns])
    if remaining:
        rank = len(remaining) - n_select + 1
        while len(remaining) > n_select:
            va = VectorAssembler(inputCols=remaining, outputCol="_features")
            rf = RandomForestRegressor(featuresCol="_features", labelCol=target, numTrees=num_trees, maxDepth=max_depth,
                                       featureSubsetStrategy="all", seed=seed)
            m = rf.fit(va.transform(base))
            imp = m.featureImportances.toArray()
            worst = remaining[int(np.argmin(imp))]
            ranks[worst] = rank
            rank -= 1
            remaining.remove(worst)
        for c in remaining:
            ranks[c] = 1
    return df.sparkSession.createDataFrame([(c, ranks[c]) for c in cols], "feature string, rank int")


def pca(df: DataFrame, cols: Sequence[str], k: int = 2, prefix: str = "PCA_") -> DataFrame:
    """Principal components of mean-centred columns appended as ``PCA_1..k`` (MLlib PCA; component sign
    fixed so the largest-magnitude loading is positive). Components come from the rows without a missing (NULL or NaN)
    value; a row with one has NULL components."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`").cast("double"))
    va = VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="keep")
    assembled = va.transform(df).withColumn("_whole", whole)
    some = assembled.filter("_whole")
    scaler = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(some)
    model = PCA(k=k, inputCol="_c", outputCol="_pc").fit(scaler.transform(some))
    pcm = model.pc.toArray()
    signs = [1.0 if pcm[np.argmax(np.abs(pcm[:, i])), i] >= 0 else -1.0 for i in range(k)]
    arr = vector_to_array(F.col("_pc"))
    out = model.transform(scaler.transform(assembled)).select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.when(F.col("_whole"), arr[i] * F.lit(signs[i])).alias(f"{prefix}{i + 1}") for i in range(k)])
    return out
