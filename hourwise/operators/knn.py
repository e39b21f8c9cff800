"""Mutual information by nearest neighbours (L5): the estimator of Kraskov, Stoegbauer and Grassberger, without noise.

For each row the distance to its k-th nearest row in the plane of feature and target (the larger of both differences) is
found, then the rows nearer than that in the feature alone and in the target alone are counted; the score is
digamma(n) + digamma(k) - mean(digamma(n_x + 1) + digamma(n_y + 1)).

No pair of all rows is formed. Rows are cut by rank into slabs of the feature and, inside, into tiles of the target, of a
bounded number of rows whatever the values' distribution. A row's k nearest in its own tile bound its distance; only tiles
that reach into the square of that half width are looked at as well. Counts inside a distance are differences of running
counts over the sorted values. Values are scaled to unit deviation and rounded to whole numbers of 2^-30, so distances
and counts are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwise.operators.joins import with_constants
from hourwise.operators.ordered import seq_index
from hourwise.session import cut_lineage

#: Rows of a tile, about (never more than twice as many).
TILE_ROWS = 128
#: Steps of a unit deviation.
GRID = 1 << 30
_EULER = 0.5772156649015329
_SMALL = 16


def digamma(m: Column) -> Column:
    """Digamma of whole numbers from 1 on: harmonic sums below ``_SMALL``, the asymptotic series from there."""
    sums, total = [], 0.0
    for i in range(1, _SMALL):
        sums.append(total - _EULER)
        total += 1.0 / i
    x = m.cast("double")
    y = F.lit(1.0) / (x * x)
    series = F.log(x) - F.lit(0.5) / x - y * (F.lit(1 / 12) - y * (F.lit(1 / 120) - y * (F.lit(1 / 252) - y * F.lit(1 / 240))))
    return F.when(m < _SMALL, F.element_at(F.array(*[F.lit(v) for v in sums]), F.least(m, F.lit(_SMALL - 1)).cast("int"))).otherwise(series)


def _points(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """(feature, x, y) in whole steps, of the rows with both values."""
    value = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    every = [*cols, target]
    plain = df.select(*[value(c).alias(f"_v{i}") for i, c in enumerate(every)])
    scales = plain.agg(*[F.stddev_pop(f"_v{i}").alias(f"_s{i}") for i in range(len(every))])
    steps = lambda i: F.round(F.col(f"_v{i}") / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(F.lit(1.0)) * F.lit(float(GRID))).cast("long")
    scaled = with_constants(plain, scales).select(*[steps(i).alias(f"_x{i}") for i in range(len(every))])
    long = scaled.select(F.col(f"_x{len(cols)}").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"_x{i}").alias("x")) for i, c in enumerate(cols)])).alias("p"))
    return long.select("p.feature", "p.x", "y").filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def _tiled(points: DataFrame, tile_rows: int) -> DataFrame:
    """(feature, n, slab, tile, id, x, y): slabs by rank of x, tiles by rank of y in a slab, all nearly equal in rows."""
    width = GRID / 64.0
    placed = seq_index(points, ["feature"], "x", out="id", bucket_width=width)
    n = points.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    slabs = F.greatest(F.lit(1), F.floor(F.sqrt(F.col("n") / F.lit(float(tile_rows)))))
    placed = cut_lineage(placed.join(n.withColumn("slabs", slabs), "feature").withColumn("slab", F.floor(F.col("id") * F.col("slabs") / F.col("n"))), "knn-slabs")
    inside = seq_index(placed, ["feature", "slab"], "y", out="_at", bucket_width=width)
    rows = placed.groupBy("feature", "slab").agg(F.count(F.lit(1)).alias("m"))
    rows = rows.withColumn("tiles", F.greatest(F.lit(1), F.floor(F.col("m") / F.lit(tile_rows))))
    tiled = inside.join(rows, ["feature", "slab"]).withColumn("tile", F.floor(F.col("_at") * F.col("tiles") / F.col("m")))
    return cut_lineage(tiled.select("feature", "n", "slab", "tile", "id", "x", "y"), "knn-tiles")


def _nearest(points: Column, k: int, x: Column, y: Column) -> Column:
    """The k smallest distances from (x, y) to ``points``, ascending."""
    return F.slice(F.array_sort(F.transform(points, lambda p: F.greatest(F.abs(p["x"] - x), F.abs(p["y"] - y)))), 1, k)


def kth_distances(tiled: DataFrame, k: int) -> DataFrame:
    """(feature, n, id, x, y, distance): distance of each point's k-th nearest other point."""
    at = ["feature", "slab", "tile"]
    tiles = tiled.groupBy(*at).agg(F.collect_list(F.struct("x", "y")).alias("points"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    tiles = cut_lineage(tiles, "knn-points")  # rows of a tile are bounded by construction
    # in its own tile each point finds itself first
    own = tiled.join(tiles.select(*at, "points"), at).withColumn("near", _nearest(F.col("points"), k + 1, F.col("x"), F.col("y"))).drop("points")
    own = own.withColumn("r", F.when(F.size("near") > k, F.element_at("near", -1)).otherwise(F.lit(1 << 60)))
    own = cut_lineage(own, "knn-own")
    # slabs, then tiles in them, that reach into the square around a point: arrays of the root of the number of tiles
    slab = tiles.groupBy("feature", "slab").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.collect_list(F.struct("tile", "x0", "x1", "y0", "y1")).alias("boxes"))
    edges = slab.groupBy("feature").agg(F.collect_list(F.struct("slab", "x0", "x1")).alias("slabs"))
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    asks = own.select("feature", F.col("slab").alias("home"), F.col("tile").alias("home_tile"), "id", "x", "y", "r").join(edges, "feature")
    asks = asks.withColumn("s", F.explode(F.filter("slabs", lambda s: (s["x0"] < x + r) & (s["x1"] > x - r)))).select("feature", "home", "home_tile", "id", "x", "y", "r", F.col("s.slab").alias("slab"))
    asks = asks.join(slab.select("feature", "slab", "boxes"), ["feature", "slab"])
    reach = lambda b: (b["x0"] < x + r) & (b["x1"] > x - r) & (b["y0"] < y + r) & (b["y1"] > y - r)
    asks = asks.withColumn("b", F.explode(F.filter("boxes", reach))).withColumn("tile", F.col("b.tile")).drop("boxes", "b")
    asks = asks.filter((F.col("slab") != F.col("home")) | (F.col("tile") != F.col("home_tile")))
    others = asks.join(tiles.select(*at, "points"), at).select("feature", "id", _nearest(F.col("points"), k, x, y).alias("near"))
    others = others.groupBy("feature", "id").agg(F.flatten(F.collect_list("near")).alias("more"))
    both = own.join(others, ["feature", "id"], "left")
    all_near = F.array_sort(F.concat("near", F.coalesce("more", F.array().cast("array<bigint>"))))
    return both.select("feature", "n", "id", "x", "y", F.element_at(all_near, k + 1).alias("distance"))


def knn_mutual_info(df: DataFrame, cols: Sequence[str], target: str = "y", k: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(feature, score), the mutual information in nats of each feature with the target by k nearest neighbours.

    Rows with a missing (NULL or NaN) feature or target are left out for that feature. Equal rows are neighbours at distance
    0 (no noise is added); a row's neighbours inside a distance of 0 are those equal in that column. A feature with no more
    than ``k`` rows scores 0, as does a negative estimate; an empty table gives 0 for every feature.
    """
    cols = list(cols)
    tiled = _tiled(_points(df, cols, target), tile_rows).filter(F.col("n") > k)
    known = cut_lineage(kth_distances(tiled, k), "knn-distances")
    e = F.col("distance")
    ends = lambda v: [F.struct((F.col(v) + F.greatest(e - 1, F.lit(0))).alias("v"), F.lit(1).alias("sign")), F.struct((F.col(v) - F.greatest(e, F.lit(1))).alias("v"), F.lit(-1).alias("sign"))]
    asked = known.select("feature", "id", F.explode(F.array(*[
        F.struct(F.lit(axis).alias("axis"), s.alias("end")) for axis in ("x", "y") for s in ends(axis)])).alias("a"))
    asked = asked.select("feature", "id", "a.axis", "a.end.v", "a.end.sign")
    there = known.select("feature", F.explode(F.array(*[F.struct(F.lit(axis).alias("axis"), F.col(axis).alias("v"), F.lit(1).alias("c")) for axis in ("x", "y")])).alias("a")).select("feature", "a.*")
    values = there.unionByName(asked.select("feature", "axis", "v", F.lit(0).alias("c"))).groupBy("feature", "axis", "v").agg(F.sum("c").alias("c"))
    running = seq_index(cut_lineage(values, "knn-values"), ["feature", "axis"], "v", out="below", bucket_width=GRID / 64.0, weight="c")
    upto = running.select("feature", "axis", "v", (F.col("below") + F.col("c")).alias("upto"))
    # rows nearer than the distance, the row itself included
    near = asked.join(upto, ["feature", "axis", "v"]).groupBy("feature", "id", "axis").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"))
    parts = near.groupBy("feature").agg(F.sum(digamma(F.col("m"))).alias("s"))
    n = known.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    score = digamma(F.col("n")) + digamma(F.lit(k)) - F.col("s") / F.col("n")
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")  # a row for each feature
    out = names.join(n.join(parts, "feature"), "feature", "left")
    return out.select("feature", F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)).alias("score"))
