"""Feature scoring and selection.

Score tables are small DataFrames ``(feature, score)`` with one row per feature; the data passes that
produce them are single aggregates over the wide frame (map-side partial aggregation, one small shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourwise.functions.names import is_derived
from hourwise.operators.expand import interactions
from hourwise.operators.joins import with_constants
from hourwise.operators.ordered import seq_index
from hourwise.operators.reduce import FANIN, sum_arrays
from hourwise.session import cut_lineage


#: Columns of a tile of cross products.
CORR_TILE = 128
CORR_SCHEMA = "feature_a string, feature_b string, pos_a int, pos_b int, corr double"


def _q(c: str):
    return F.col(f"`{c}`")


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str = "y") -> DataFrame:
    """L1: Pearson correlation of every column with the target (pairwise-complete rows), one aggregate."""
    cols = list(cols)
    wide = df.agg(*[F.corr(_q(c).cast("double"), _q(target).cast("double")).alias(c) for c in cols])
    return wide.unpivot([], cols, "feature", "score")


def corr_matrix(df: DataFrame, cols: Sequence[str], tile: int = CORR_TILE) -> DataFrame:
    """L2: upper-triangle Pearson matrix in long form ``(feature_a, feature_b, pos_a, pos_b, corr)``,
    pairwise-complete rows (pandas ``corr``; NaN counts as missing, NULL where a column is constant).

    One pass: each task adds up masked cross products of the mean-centred columns, O(p^2) numbers however many rows. They
    go on in tiles of ``tile`` columns by as many, are merged by tile in two steps and turned into correlations there:
    no buffer holds more than ``FANIN`` tiles, whatever the number of columns.
    """
    cols = list(cols)
    p = len(cols)
    if p < 2:
        return df.sparkSession.createDataFrame([], CORR_SCHEMA)
    value = lambda c: F.when(~F.isnan(_q(c).cast("double")), _q(c).cast("double"))
    means = df.agg(*[F.avg(value(c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    centred = with_constants(df.select(*[value(c).alias(f"_v{i}") for i, c in enumerate(cols)]), means).select(
        F.array(*[F.col(f"_v{i}") - F.col(f"_m{i}") for i in range(p)]).alias("x"))
    starts = list(range(0, p, tile))

    def partial(batches):
        acc = {}
        for b in batches:
            column = b.column(0).combine_chunks() if hasattr(b.column(0), "combine_chunks") else b.column(0)
            x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)
            m = (~np.isnan(x)).astype(float)
            x0 = np.nan_to_num(x)
            for i in starts:
                for j in starts:
                    if j < i or not len(x):
                        continue
                    left, right, ml, mr = x0[:, i:i + tile], x0[:, j:j + tile], m[:, i:i + tile], m[:, j:j + tile]
                    own = np.stack([ml.T @ mr, left.T @ mr, (left * left).T @ mr, left.T @ right, ml.T @ right, ml.T @ (right * right)])
                    acc[i, j] = acc[i, j] + own if (i, j) in acc else own
        for (i, j), v in acc.items():
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "size": pa.array([v.size], pa.int32()), "s": pa.array([v.ravel()], pa.list_(pa.float64()))})

    def finish(batches):
        for pdf in batches:
            out = []
            for i0, j0, s in pdf[["i", "j", "s"]].itertuples(index=False):
                n, sx, sq, cxy, sy, sr = np.asarray(s, dtype=float).reshape(6, min(tile, p - i0), -1)
                vx, vy = n * sq - sx ** 2, n * sr - sy ** 2
                # each column against its own magnitude: the other's scale says nothing about it
                flat = (vx <= 1e-12 * n * sq) | (vy <= 1e-12 * n * sr)
                with np.errstate(invalid="ignore", divide="ignore"):
                    corr = (n * cxy - sx * sy) / np.sqrt(vx) / np.sqrt(vy)
                for a in range(corr.shape[0]):
                    for b in range(max(0, i0 + a + 1 - j0), corr.shape[1]):
                        out.append((cols[i0 + a], cols[j0 + b], i0 + a, j0 + b, None if flat[a, b] else corr[a, b]))
            yield pd.DataFrame(out, columns=["feature_a", "feature_b", "pos_a", "pos_b", "corr"])

    parts = centred.mapInArrow(partial, "i int, j int, size int, s array<double>").withColumn("_part", F.spark_partition_id() % FANIN)
    for keys in (["i", "j", "size", "_part"], ["i", "j", "size"]):
        parts = parts.groupBy(*keys).agg(sum_arrays("s", F.col("size")).alias("s"))
    return parts.mapInPandas(finish, CORR_SCHEMA)


def prune_correlated(df: DataFrame, cols: Sequence[str], threshold: float = 0.9, corr: DataFrame | None = None) -> DataFrame:
    """L3: drop a column when |corr| > threshold with any *earlier* column (dropped ones still count).
    Returns the kept ``(feature, pos)`` rows."""
    cols = list(cols)
    cm = corr if corr is not None else corr_matrix(df, cols)
    dropped = cm.filter(F.abs(F.col("corr")) > F.lit(threshold)).select(F.col("feature_b").alias("feature")).distinct()
    spark = df.sparkSession
    feats = spark.createDataFrame([(c, i) for i, c in enumerate(cols)], "feature string, pos int")
    return feats.join(dropped, "feature", "left_anti")


def moderate_pairs(corr: DataFrame, lo: float = 0.3, hi: float = 0.8) -> DataFrame:
    """L4: pairs with lo < |corr| < hi (candidates for interaction terms)."""
    a = F.abs(F.col("corr"))
    return corr.filter((a > lo) & (a < hi)).select("feature_a", "feature_b", a.alias("abs_corr"))


def corr_distinct_values(corr: DataFrame, digits: int = 6, nudge: float = 3e-9) -> DataFrame:
    """Distinct |corr| values of the full matrix (upper triangle + the diagonal 1.0), by value at
    ``digits`` decimals (the reference's ``drop_duplicates`` on the unstacked matrix)."""
    vals = corr.select((F.round(F.abs(F.col("corr")) + F.lit(nudge), digits) + F.lit(0.0)).alias("abs_corr"))
    diag = corr.sparkSession.range(1).select(F.lit(1.0).alias("abs_corr"))
    return vals.unionByName(diag).distinct()


def mutual_info(df: DataFrame, cols: Sequence[str], target: str = "y", bins: int = 16,
                bias_correction: bool = True) -> DataFrame:
    """L5 (re-aimed): binned mutual information in nats between every feature and the target.

    Equal-width bins on [min, max] of each column (deterministic, exact in any engine); plug-in estimate
    ``sum p(x,y) ln(p(x,y) / (p(x) p(y)))`` minus the Miller-Madow bias ``(K_xy - K_x - K_y + 1) / (2n)``,
    clipped at 0.  Rows with a missing value in the feature or target are skipped per feature.

    Plan: one min/max aggregate as a scalar subquery; every task counts its cells (feature, bx, by) in one NumPy array
    of features x bins^2, so the shuffle carries at most that many rows per task; one more small shuffle groups each
    feature's <= bins^2 cells, and the marginals and the sum are higher-order functions over that bounded array.
    """
    cols = list(cols)
    b, p = int(bins), len(cols)
    allc = cols + [target]
    value = lambda c: F.when(~F.isnan(_q(c).cast("double")), _q(c).cast("double"))
    stats = df.agg(*[F.min(value(c)).alias(f"_mn{i}") for i, c in enumerate(allc)], *[F.max(value(c)).alias(f"_mx{i}") for i, c in enumerate(allc)])

    def bin_of(i):
        x, mn, mx = F.col(f"_v{i}"), F.col(f"_mn{i}"), F.col(f"_mx{i}")
        raw = F.floor((x - mn) / (mx - mn) * F.lit(float(b)))
        return F.coalesce(F.when(x.isNull(), None).when(mx == mn, F.lit(0)).otherwise(F.least(raw, F.lit(b - 1))).cast("int"), F.lit(-1)).alias(f"_b{i}")

    binned = with_constants(df.select(*[value(c).alias(f"_v{i}") for i, c in enumerate(allc)]), stats).select(*[bin_of(i) for i in range(p + 1)])

    def count(batches):
        acc = np.zeros((p, b * b), dtype=np.int64)
        for pdf in batches:
            y = pdf[f"_b{p}"].to_numpy()
            for i in range(p):
                x = pdf[f"_b{i}"].to_numpy()
                ok = (x >= 0) & (y >= 0)
                acc[i] += np.bincount(x[ok] * b + y[ok], minlength=b * b)
        at = np.nonzero(acc)
        yield pd.DataFrame({"feature": np.array(cols, dtype=object)[at[0]], "bx": (at[1] // b).astype(np.int32), "_by": (at[1] % b).astype(np.int32), "c": acc[at]})

    cells = binned.mapInPandas(count, "feature string, bx int, _by int, c long").groupBy("feature", "bx", "_by").agg(F.sum("c").alias("c"))
    # one group per feature holding its <= bins^2 cells (bounded); marginals, K counts and the MI sum are
    # higher-order functions over that small array - one shuffle instead of a window per marginal
    per = cells.groupBy("feature").agg(F.collect_list(F.struct("bx", "_by", "c")).alias("cells"))
    cl = F.col("cells")
    n = F.aggregate(cl, F.lit(0).cast("bigint"), lambda acc, e: acc + e["c"])

    def marginal(e, key):
        return F.aggregate(F.filter(cl, lambda o: o[key] == e[key]), F.lit(0).cast("bigint"), lambda acc, o: acc + o["c"])

    per = per.select("feature", "cells", n.alias("n"))
    terms = F.transform(cl, lambda e: (e["c"] / F.col("n")) * F.log((e["c"] * F.col("n")) / (marginal(e, "bx") * marginal(e, "_by"))))
    mi = F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)
    kxy = F.size(cl)
    kx = F.size(F.array_distinct(F.transform(cl, lambda e: e["bx"])))
    ky = F.size(F.array_distinct(F.transform(cl, lambda e: e["_by"])))
    score = mi
    if bias_correction:
        score = mi - (kxy - kx - ky + F.lit(1)) / (F.lit(2.0) * F.col("n"))
    out = per.select("feature", F.greatest(score, F.lit(0.0)).alias("score"))
    # features without any complete row score 0 (the name table has one row per feature: broadcast)
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in cols], "feature string")
    return out.join(F.broadcast(names), "feature", "right").select("feature", F.coalesce("score", F.lit(0.0)).alias("score"))


def quantile_edges(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact discrete quantiles of all columns at once: (feature, prob, value), the smallest value with at least that share
    of the column's known (not NULL, not NaN) values at or below it; a column without one has no row.

    Values are counted, and their running counts come from ``seq_index``: a tree of buckets, counted again only where a
    bucket is full. No buffer and no task holds a whole column.
    """
    cols = list(cols)
    value = lambda c: F.when(~F.isnan(_q(c).cast("double")), _q(c).cast("double"))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), value(c).alias("value")) for c in cols])).alias("v")).select("v.*")
    counts = cut_lineage(long.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c")), "quantile-values")
    running = seq_index(counts, ["feature"], "value", out="before", weight="c")
    total = counts.groupBy("feature").agg(F.sum("c").alias("n"))
    ranked = running.join(total, "feature").withColumn("prob", F.explode(F.array(*[F.lit(float(q)) for q in probs])))
    rank = F.greatest(F.ceil(F.col("prob") * F.col("n")), F.lit(1))
    return ranked.filter((rank > F.col("before")) & (rank <= F.col("before") + F.col("c"))).select("feature", "prob", "value")


def sort_scores(scores: DataFrame, ascending: bool = False, col: str = "score") -> DataFrame:
    """O1/O2: ranked score table (ties broken by name); the table has one row per feature."""
    order = F.col(col).asc() if ascending else F.col(col).desc()
    w = Window.orderBy(order, F.col("feature"))
    return scores.select("*", F.row_number().over(w).cast("bigint").alias("rank"))


def top_k(scores: DataFrame, k: int = 10, col: str = "score") -> DataFrame:
    """O3: the k best features (TakeOrderedAndProject) - the limit is the feature."""
    return scores.orderBy(F.col(col).desc(), F.col("feature")).limit(k)


def threshold_select(scores: DataFrame, threshold: float = 0.3, col: str = "score") -> DataFrame:
    """O4."""
    return scores.filter(F.col(col) > F.lit(threshold))


def select_by_mi(df: DataFrame, cols: Sequence[str], target: str = "y", top: int = 10, threshold: float = 0.3,
                 rescore: bool = True, exclude_derived: bool = True, bins: int = 16) -> tuple[DataFrame, DataFrame]:
    """Score -> top-k -> pairwise interactions of the (non-derived) top features -> re-score all ->
    keep score > threshold.  Returns (frame with the interaction columns, selected score table).

    The only value brought to the driver is the top-k name list (k rows)."""
    df = cut_lineage(df)  # scanned by two scoring passes, the top-k action and the interactions
    scores = cut_lineage(mutual_info(df, cols, target, bins), "scores")  # one row per feature
    if not rescore:
        return df, threshold_select(scores, threshold)
    best = [r["feature"] for r in top_k(scores, top).collect()]
    base = [c for c in best if not (exclude_derived and is_derived(c))]
    wide = interactions(df, base)
    new = [c for c in wide.columns if c not in df.columns]
    # a column's score is the same beside new columns: only these are scored
    rescored = scores.unionByName(mutual_info(wide, new, target, bins)) if new else scores
    return wide, threshold_select(rescored, threshold)


def consensus(*feature_sets: DataFrame) -> DataFrame:
    """Features chosen by every selector (``intersect`` on the name column)."""
    out = feature_sets[0].select("feature")
    for s in feature_sets[1:]:
        out = out.intersect(s.select("feature"))
    return out


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features in ``a`` and not in ``b``."""
    return a.select("feature").join(b.select("feature"), "feature", "left_anti").distinct()


def union_sets(*feature_sets: DataFrame) -> DataFrame:
    """U4."""
    out = feature_sets[0].select("feature")
    for s in feature_sets[1:]:
        out = out.union(s.select("feature"))
    return out.distinct()
