"""Queries of the operators that spread one long series over many tasks, and of NULL keys and bursts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hourwise import fixtures as fx
from hourwise.catalog import GAPPY, HBT, HWIDE, r, register, rounded
from hourwise.functions import time as tf
from hourwise.operators import fft, knn, missing, ordered, selection, spline

TWO_PI = 2.0 * math.pi


def _dft_sql(source: str) -> str:
    """All coefficients of each series of ``source`` (series_id, ds, y), by the definition."""
    return f"""x AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS t, coalesce(y, 0.0) AS y,
      count(*) OVER (PARTITION BY series_id) AS n FROM {source}),
s AS (SELECT a.series_id, a.t AS k, sum(b.y * cos({TWO_PI!r} * ((a.t * b.t) % a.n) / a.n)) AS re, -sum(b.y * sin({TWO_PI!r} * ((a.t * b.t) % a.n) / a.n)) AS im
      FROM x a JOIN x b ON a.series_id = b.series_id GROUP BY ALL)
SELECT series_id, k, {r('re', 4)} AS re, {r('im', 4)} AS im, {r('sqrt(re * re + im * im)', 4)} AS magnitude FROM s"""


@register("fft_long", f"WITH {HWIDE},\n{_dft_sql('hw')}")
def fft_long(spark, sf):
    """The whole spectrum of one series, the hours of all events."""
    return rounded(fft.fft_long(fx.hourly_wide(spark, sf).select("series_id", "ds", "y")), 4)


@register("fft_long_by_type", f"WITH {GAPPY},\n{_dft_sql('gappy')}")
def fft_long_by_type(spark, sf):
    """Whole spectra of several series with gaps, of lengths with and without balanced divisors."""
    return rounded(fft.fft_long(fx.hourly_gappy(spark, sf).select("series_id", "ds", "y")), 4)


_KNN = ("n_click", "n_view", "n_error", "n_purchase", "n_signup", "H")
_K = 3


@register("knn_mi", f"""WITH {HWIDE},
p AS (UNPIVOT (SELECT y, {', '.join(f'"{c}"::DOUBLE AS "{c}"' for c in _KNN)} FROM hw) ON {', '.join(f'"{c}"' for c in _KNN)} INTO NAME feature VALUE x),
s AS (SELECT feature, round(x / coalesce(nullif(stddev_pop(x) OVER (PARTITION BY feature), 0), 1) * {knn.GRID})::BIGINT AS x,
             round(y / coalesce(nullif(stddev_pop(y) OVER (PARTITION BY feature), 0), 1) * {knn.GRID})::BIGINT AS y FROM p),
i AS (SELECT *, row_number() OVER (PARTITION BY feature) AS id FROM s),
d AS (SELECT a.feature, a.id, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM i a JOIN i b ON a.feature = b.feature),
e AS (SELECT feature, id, min(greatest(dx, dy), {_K + 1})[{_K + 1}] AS e FROM d GROUP BY ALL),
c AS (SELECT feature, id, count(*) FILTER (WHERE dx < greatest(e, 1)) AS nx, count(*) FILTER (WHERE dy < greatest(e, 1)) AS ny FROM d JOIN e USING (feature, id) GROUP BY ALL),
h AS (SELECT m, coalesce(sum(1.0::DOUBLE / m) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM range(1, 100001) t(m))
SELECT feature, {r(f'greatest(0.0, any_value(hn.h) + any_value(hk.h) - avg(hx.h) - avg(hy.h))')} AS score
FROM c JOIN h hx ON hx.m = nx JOIN h hy ON hy.m = ny JOIN h hn ON hn.m = (SELECT count(*) FROM hw WHERE y IS NOT NULL) JOIN h hk ON hk.m = {_K}
GROUP BY feature""")
def knn_mi(spark, sf):
    """Mutual information of the hourly features with the target by three nearest neighbours."""
    return rounded(knn.knn_mutual_info(fx.hourly_wide(spark, sf), _KNN, "y", _K))


@register("interp_spline", f"""WITH RECURSIVE {HBT},
g AS (SELECT series_id, ds, CASE WHEN (epoch_us(ds) // 3600000000) % 17 >= 4 THEN y END AS y, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS pos FROM hbt),
k AS (SELECT series_id, pos::DOUBLE AS x, y, row_number() OVER s - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n, min(pos) OVER (PARTITION BY series_id) AS x0,
             max(pos) OVER (PARTITION BY series_id) AS x1 FROM g WHERE y IS NOT NULL WINDOW s AS (PARTITION BY series_id ORDER BY pos)),
t AS (SELECT *, CASE WHEN i <= 2 THEN x0 ELSE (lag(x, 2) OVER s + lag(x, 1) OVER s) / 2 END AS a, CASE WHEN i <= 1 THEN x0 ELSE (lag(x, 1) OVER s + x) / 2 END AS b,
             CASE WHEN i + 2 >= n THEN x1 ELSE (x + lead(x, 1) OVER s) / 2 END AS c, CASE WHEN i + 3 >= n THEN x1 ELSE (lead(x, 1) OVER s + lead(x, 2) OVER s) / 2 END AS d
      FROM k WINDOW s AS (PARTITION BY series_id ORDER BY i)),
e AS MATERIALIZED (SELECT *, CASE WHEN i IN (0, n - 1) THEN 0 ELSE (c - x) * (c - x) / ((c - a) * (c - b)) END AS low,
             CASE WHEN i IN (0, n - 1) THEN 0 ELSE (x - b) * (x - b) / ((d - b) * (c - b)) END AS up FROM t),
fw AS (SELECT series_id, i, up AS cp, y AS dp FROM e WHERE i = 0
       UNION ALL
       SELECT e.series_id, e.i, e.up / (1 - e.low - e.up - e.low * f.cp), (e.y - e.low * f.dp) / (1 - e.low - e.up - e.low * f.cp) FROM fw f JOIN e ON e.series_id = f.series_id AND e.i = f.i + 1),
fm AS MATERIALIZED (SELECT * FROM fw),
bw AS (SELECT f.series_id, f.i, f.dp AS u FROM fm f JOIN e ON e.series_id = f.series_id AND e.i = f.i AND e.i = e.n - 1
       UNION ALL
       SELECT f.series_id, f.i, f.dp - f.cp * b.u FROM bw b JOIN fm f ON f.series_id = b.series_id AND f.i = b.i - 1),
q AS (SELECT g.*, max(k.i) OVER (PARTITION BY g.series_id ORDER BY g.pos ROWS UNBOUNDED PRECEDING) AS i FROM g LEFT JOIN k ON k.series_id = g.series_id AND k.x = g.pos),
m AS (SELECT q.series_id, q.ds, q.y, q.pos, p.y AS py, z.y AS zy, greatest(1, least(p.n - 2, CASE WHEN q.pos < (p.x + z.x) / 2 THEN q.i ELSE q.i + 1 END)) AS j
      FROM q LEFT JOIN k p ON p.series_id = q.series_id AND p.i = q.i LEFT JOIN k z ON z.series_id = q.series_id AND z.i = q.i + 1),
v AS (SELECT m.*, (e.c - pos) * (e.c - pos) / ((e.c - e.a) * (e.c - e.b)) AS l, (pos - e.b) * (pos - e.b) / ((e.d - e.b) * (e.c - e.b)) AS r, u0.u AS ua, u1.u AS ub, u2.u AS uc
      FROM m LEFT JOIN e ON e.series_id = m.series_id AND e.i = m.j LEFT JOIN bw u0 ON u0.series_id = m.series_id AND u0.i = m.j - 1
      LEFT JOIN bw u1 ON u1.series_id = m.series_id AND u1.i = m.j LEFT JOIN bw u2 ON u2.series_id = m.series_id AND u2.i = m.j + 1)
SELECT series_id, ds, {r('CASE WHEN y IS NOT NULL THEN y WHEN py IS NULL THEN NULL WHEN zy IS NULL THEN py ELSE l * ua + (1 - l - r) * ub + r * uc END')} AS y FROM v""")
def interp_spline(spark, sf):
    """M6: the quadratic spline through all known points of each series."""
    df = fx.hourly_by_type(spark, sf).select("series_id", "ds", F.when(tf.epoch_hours("ds") % 17 >= 4, F.col("y")).alias("y"))
    return rounded(spline.interpolate_spline(df, "y", chunk=64))


_UNNAMED = "u AS (SELECT nullif(series_id, 'error') AS series_id, ds, y FROM gappy)"


def _unnamed(spark, sf):
    return fx.hourly_gappy(spark, sf).select(F.nullif("series_id", F.lit("error")).alias("series_id"), "ds", "y")


@register("lags_null_keys", f"""WITH {GAPPY}, {_UNNAMED}
SELECT series_id, ds, y, lag(y, 1) OVER w AS lag_1, lag(y, 24) OVER w AS lag_24 FROM u WINDOW w AS (PARTITION BY series_id ORDER BY ds)""")
def lags_null_keys(spark, sf):
    """Lags where one series has no name."""
    return ordered.add_lags(_unnamed(spark, sf), "y", [1, 24], chunk=128)


@register("regularize_null_series", f"""WITH {GAPPY}, {_UNNAMED},
b AS (SELECT series_id, min(ds) AS lo, max(ds) AS hi FROM u GROUP BY series_id),
g AS (SELECT series_id, unnest(range(lo, hi + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ds FROM b)
SELECT g.series_id, g.ds, u.y, CASE WHEN u.ds IS NULL THEN 1 ELSE 0 END AS is_filled FROM g LEFT JOIN u ON g.ds = u.ds AND g.series_id IS NOT DISTINCT FROM u.series_id""")
def regularize_null_series(spark, sf):
    """M7: the hourly grid where one series has no name."""
    return missing.regularize(_unnamed(spark, sf))


@register("seq_index_events", """WITH p AS (SELECT event_type AS series_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS seq FROM events)
SELECT series_id, ts, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM p GROUP BY ALL""")
def seq_index_events(spark, sf):
    """Positions of the raw events of each type, in windows of 256 rows at most; equal times share a run of them."""
    ev = fx.table(spark, sf, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id")
    at = ordered.seq_index(ev, order_col="ts", bucket_rows=256)
    return at.groupBy("series_id", "ts").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


_EDGES, _PROBS = ("y", "n_click", "n_view", "H"), (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)


@register("quantile_edges", f"""WITH {HWIDE},
p AS (UNPIVOT (SELECT {', '.join(f'"{c}"::DOUBLE AS "{c}"' for c in _EDGES)} FROM hw) ON {', '.join(f'"{c}"' for c in _EDGES)} INTO NAME feature VALUE x)
SELECT feature, prob, {r('quantile_disc(x, prob)')} AS value FROM p, (VALUES {', '.join(f'({q}::DOUBLE)' for q in _PROBS)}) t(prob) GROUP BY feature, prob""".replace("quantile_disc(x, prob)", "list_sort(list(x))[greatest(1, ceil(prob * count(*)))::BIGINT]"))
def quantile_edges(spark, sf):
    """Exact quantiles of several columns at once (edges of bins of equal depth)."""
    return rounded(selection.quantile_edges(fx.hourly_wide(spark, sf), _EDGES, _PROBS))


@register("corr_tiled", f"""WITH {HWIDE}, x AS (SELECT epoch_us(ds) // 3600000000 AS h, n_click::DOUBLE AS c, y FROM hw),
w AS (SELECT unnest(range(40)) AS k),
v AS (SELECT k, h, c * cos(0.1 * k) + coalesce(y, 0.0) * sin(0.1 * k) AS v FROM x, w)
SELECT 'f' || a.k AS feature_a, 'f' || b.k AS feature_b, {r('corr(a.v, b.v)')} AS corr FROM v a JOIN v b ON a.h = b.h AND a.k < b.k GROUP BY a.k, b.k""")
def corr_tiled(spark, sf):
    """L2: correlations of forty mixtures of two columns, in tiles of sixteen."""
    wide = fx.hourly_wide(spark, sf).select(*[(F.col("n_click") * math.cos(0.1 * k) + F.coalesce("y", F.lit(0.0)) * math.sin(0.1 * k)).alias(f"f{k}") for k in range(40)])
    return rounded(selection.corr_matrix(wide, [f"f{k}" for k in range(40)], tile=16).select("feature_a", "feature_b", "corr"))
