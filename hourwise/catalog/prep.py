"""Registered queries: sources, typing, filters, missing data, calendar (S, P, F, M, T, A)."""

from __future__ import annotations


from pyspark.sql import functions as F

from hourwise import fixtures as fx
from hourwise.catalog import DAILY, GAPPY, HBT, HWIDE, ROUND_HOUR, TEXT_DATES, r, register, regular_sql, rounded
from hourwise.functions import time as tf
from hourwise.operators import calendar as cal
from hourwise.operators import columns as cols
from hourwise.operators import filters as flt
from hourwise.operators import missing as miss
from hourwise.operators import ordered as ordd
from hourwise.session import scratch_path
from hourwise.sources import io

LO, HI = "2024-01-05 00:00:00", "2024-01-12 23:00:00"


@register("hourly_round", f"""WITH {HBT}
SELECT series_id, ds, {r('y')} AS y, n_events, n_users FROM hbt""")
def hourly_round(spark, sf):
    """Timestamps rounded to the nearest hour (ties to even) and aggregated per (series, hour)."""
    return rounded(fx.hourly_by_type(spark, sf))


@register("parse_coerce", f"""WITH {TEXT_DATES}
SELECT event_id, event_type, try_strptime(ts_text, '%Y-%m-%d %H:%M:%S') AS ts, TRY_CAST(value_text AS DOUBLE) AS value
FROM td WHERE try_strptime(ts_text, '%Y-%m-%d %H:%M:%S') IS NOT NULL""")
def parse_coerce(spark, sf):
    """P2 + P4 + F7: coercing timestamp and number parsers, then rows without a timestamp dropped."""
    df = fx.text_dates(spark, sf)
    df = cols.parse_ts(df, "ts_text", "yyyy-MM-dd HH:mm:ss", strict=False, out="ts")
    df = cols.to_numeric(df, ["value_text"]).withColumnRenamed("value_text", "value")
    return flt.drop_null_ts(df, "ts").select("event_id", "event_type", "ts", "value")


@register("parse_strict", f"""WITH {TEXT_DATES}
SELECT event_id, strptime(ts_text, '%Y-%m-%d %H:%M:%S') AS ds FROM td
WHERE ts_text <> 'bad' AND strptime(ts_text, '%Y-%m-%d %H:%M:%S') >= TIMESTAMP '2024-01-10 00:00:00'""")
def parse_strict(spark, sf):
    """P1 + P15: strict parse (raises on a bad value, so bad rows are removed first) and a parsed bound."""
    df = fx.text_dates(spark, sf).filter(F.col("ts_text") != "bad")
    df = cols.parse_ts(df, "ts_text", "yyyy-MM-dd HH:mm:ss", strict=True, out="ds")
    return df.filter(F.col("ds") >= tf.ts_bound("2024-01-10 00:00:00")).select("event_id", "ds")


@register("model_frame", """SELECT o_orderdate AS ds, o_totalprice AS y, o_orderkey, o_custkey, o_orderstatus, o_orderpriority
FROM orders""")
def model_frame(spark, sf):
    """P5: timestamp -> ``ds``, target -> ``y``, originals dropped."""
    return cols.as_model_frame(fx.table(spark, sf, "orders"), ts="o_orderdate", target="o_totalprice")


@register("select_drop_cast", f"""WITH {HWIDE}
SELECT ds, {r('y')} AS y, n_click, n_view, CAST(n_error > 0 AS INTEGER) AS n_error FROM hw""")
def select_drop_cast(spark, sf):
    """P6 + P9 + P13 + P16: tolerant drop, projection of chosen features, boolean -> int."""
    df = fx.hourly_wide(spark, sf)
    df = cols.drop_cols(df, ["Day", "H", "WDAY", "PriceCZ", "series_id"])  # PriceCZ absent: skipped
    feats, target = cols.split_xy(df, "y", "ds")
    keep = [c for c in feats if c in ("n_click", "n_view", "n_error")]
    df = df.withColumn("n_error", F.col("n_error") > 0)
    df = cols.bool_to_int(df, ["n_error"])
    return rounded(cols.select_features(df, keep, keep=("ds", target)))


@register("range_closed", f"""WITH {HBT}
SELECT series_id, ds, {r('y')} AS y, n_events FROM hbt
WHERE ds >= TIMESTAMP '{LO}' AND ds <= TIMESTAMP '{HI}'""")
def range_closed(spark, sf):
    """``lo <= ds <= hi``."""
    return rounded(flt.between_ts(fx.hourly_by_type(spark, sf, LO, HI), LO, HI).select("series_id", "ds", "y", "n_events"))


@register("range_half_open", f"""WITH {HBT}
SELECT series_id, ds, {r('y')} AS y FROM hbt
WHERE ds > TIMESTAMP '{LO}' AND ds <= TIMESTAMP '{HI}'""")
def range_half_open(spark, sf):
    """``lo < ds <= hi``."""
    return rounded(flt.between_ts(fx.hourly_by_type(spark, sf, LO, HI), LO, HI, closed="right").select("series_id", "ds", "y"))


@register("at_hour", f"""WITH {HBT}
SELECT series_id, ds, {r('y')} AS y, n_events FROM hbt WHERE ds = TIMESTAMP '2024-01-10 12:00:00'""")
def at_hour(spark, sf):
    """rows of one hour."""
    hour = "2024-01-10 12:00:00"
    return rounded(flt.at_ts(fx.hourly_by_type(spark, sf, hour, hour), hour).select("series_id", "ds", "y", "n_events"))


@register("data_bounds", f"""WITH {TEXT_DATES}
SELECT event_type, count(*) AS n_rows, count(try_strptime(ts_text, '%Y-%m-%d %H:%M:%S')) AS n_valid,
       min(try_strptime(ts_text, '%Y-%m-%d %H:%M:%S')) AS min_ds, max(try_strptime(ts_text, '%Y-%m-%d %H:%M:%S')) AS max_ds
FROM td GROUP BY event_type""")
def data_bounds(spark, sf):
    """F5 + T11: count, valid count, min and max timestamp after coercion, per event type."""
    df = cols.parse_ts(fx.text_dates(spark, sf), "ts_text", "yyyy-MM-dd HH:mm:ss", strict=False, out="ds")
    return flt.data_bounds(df, "ds", ["event_type"])


@register("row_count_span", f"""WITH {HBT}
SELECT count(*) AS n_rows, count(ds) AS n_valid, min(ds) AS min_ds, max(ds) AS max_ds FROM hbt""")
def row_count_span(spark, sf):
    """A1 + A2: row count and min / max timestamp of the whole panel."""
    return flt.data_bounds(fx.hourly_by_type(spark, sf), "ds")


@register("drop_incomplete", f"""WITH {GAPPY}
SELECT series_id, ds, {r('y')} AS y, n_events FROM gappy WHERE y IS NOT NULL""")
def drop_incomplete(spark, sf):
    """F8: rows with any missing value dropped."""
    df = fx.hourly_gappy(spark, sf).select("series_id", "ds", "y", "n_events")
    return rounded(flt.drop_nulls(df))


@register("has_nulls", f"""WITH {GAPPY}
SELECT bool_or(series_id IS NULL) AS series_id, bool_or(ds IS NULL) AS ds, bool_or(y IS NULL) AS y,
       bool_or(n_events IS NULL) AS n_events, bool_or(n_users IS NULL) AS n_users FROM gappy""")
def has_nulls(spark, sf):
    """any-missing flag per column from one aggregate."""
    return flt.has_nulls(fx.hourly_gappy(spark, sf))


@register("zscore_outliers", f"""WITH {HBT},
s AS (SELECT series_id, avg(y) AS mu, stddev_pop(y) AS sd FROM hbt GROUP BY series_id)
SELECT h.series_id, h.ds, {r('h.y')} AS y FROM hbt h JOIN s ON h.series_id = s.series_id
WHERE h.y IS NULL OR s.sd IS NULL OR s.sd = 0 OR abs((h.y - s.mu) / s.sd) <= 3""")
def zscore_outliers(spark, sf):
    """rows with |z| > 3 (population std, per series) removed."""
    df = fx.hourly_by_type(spark, sf).select("series_id", "ds", "y")
    return rounded(flt.remove_outliers(df, "y", 3.0, ["series_id"]))


@register("null_counts", f"""WITH {GAPPY},
l AS (SELECT *, lag(y, 1) OVER w AS lag_1, lag(y, 24) OVER w AS lag_24 FROM gappy
      WINDOW w AS (PARTITION BY series_id ORDER BY ds))
SELECT * FROM (UNPIVOT (SELECT count(*) FILTER (WHERE y IS NULL) AS y, count(*) FILTER (WHERE n_events IS NULL) AS n_events,
  count(*) FILTER (WHERE n_users IS NULL) AS n_users, count(*) FILTER (WHERE lag_1 IS NULL) AS lag_1,
  count(*) FILTER (WHERE lag_24 IS NULL) AS lag_24 FROM l)
  ON y, n_events, n_users, lag_1, lag_24 INTO NAME "column" VALUE n_missing)""")
def null_counts(spark, sf):
    """M8: missing count per numeric column (long form) after lag features."""
    df = ordd.add_lags(fx.hourly_gappy(spark, sf), "y", [1, 24])
    return miss.null_counts(df)


@register("null_counts_by_month", f"""WITH {GAPPY},
l AS (SELECT *, lag(y, 24) OVER (PARTITION BY series_id ORDER BY ds) AS lag_24 FROM gappy)
SELECT series_id, make_timestamp(year(ds), month(ds), 1, 0, 0, 0) AS month,
       count(*) FILTER (WHERE y IS NULL) AS y, count(*) FILTER (WHERE lag_24 IS NULL) AS lag_24
FROM l GROUP BY ALL HAVING greatest(count(*) FILTER (WHERE y IS NULL), count(*) FILTER (WHERE lag_24 IS NULL), 0) > 0""")
def null_counts_by_month(spark, sf):
    """M9: missing counts per (series, month), only months with a gap."""
    df = ordd.add_lags(fx.hourly_gappy(spark, sf), "y", [24])
    return miss.null_counts_by_month(df, ["y", "lag_24"], group_cols=["series_id"])


@register("grouped_null_counts", f"""WITH {GAPPY}
SELECT make_timestamp(year(ds), month(ds), 1, 0, 0, 0) AS month, count(*) FILTER (WHERE y IS NULL) AS y
FROM gappy GROUP BY ALL HAVING count(*) FILTER (WHERE y IS NULL) > 0""")
def grouped_null_counts(spark, sf):
    """A3: grouped missing counts (by month)."""
    return miss.null_counts_by_month(fx.hourly_gappy(spark, sf), ["y"])


@register("missing_hours", f"""WITH {GAPPY}
SELECT DISTINCT ds FROM gappy WHERE y IS NULL""")
def missing_hours(spark, sf):
    """Distinct hours where the target is missing."""
    return miss.missing_dates(fx.hourly_gappy(spark, sf), "y")


@register("regularize_hourly", f"""WITH {GAPPY}, {regular_sql('gappy')}
SELECT series_id, ds, {r('y')} AS y, CAST(n_events AS DOUBLE) AS n_events, is_filled FROM reg""")
def regularize_hourly(spark, sf):
    """M7 + T10: full hourly grid per series, missing hours inserted with NULLs and a flag."""
    df = fx.hourly_gappy(spark, sf).select("series_id", "ds", "y", F.col("n_events").cast("double"))
    return rounded(miss.regularize(df))


@register("ffill_panel", f"""WITH {GAPPY}
SELECT series_id, ds, {r('last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS y
FROM gappy""")
def ffill_panel(spark, sf):
    """M1: forward fill (chunked, carry across chunks)."""
    return rounded(ordd.ffill(fx.hourly_gappy(spark, sf).select("series_id", "ds", "y"), "y"))


@register("bfill_panel", f"""WITH {GAPPY}
SELECT series_id, ds, {r('first_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS y
FROM gappy""")
def bfill_panel(spark, sf):
    """M2: backward fill."""
    return rounded(ordd.bfill(fx.hourly_gappy(spark, sf).select("series_id", "ds", "y"), "y"))


_FF = "last_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BF = "first_value({c} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@register("ffill_bfill_zero", f"""WITH {GAPPY}, {regular_sql('gappy')}
SELECT series_id, ds, {r('coalesce(' + _FF.format(c='y') + ', ' + _BF.format(c='y') + ')')} AS y,
       coalesce(n_events, 0) AS n_events FROM reg""")
def ffill_bfill_zero(spark, sf):
    """M3 + M4: on the regular grid, forward then backward fill the target; counts of inserted hours -> 0."""
    df = miss.regularize(fx.hourly_gappy(spark, sf).select("series_id", "ds", "y", "n_events"), flag=None, pos_col="_pos")
    df = ordd.ffill_bfill(df, ["y"], pos_col="_pos").drop("_pos")
    df = df.withColumn("n_events", F.col("n_events").cast("double"))
    df = ordd.fill_zero(df, ["n_events"]).withColumn("n_events", F.col("n_events").cast("bigint"))
    return rounded(df)


@register("interp_linear", f"""WITH {GAPPY}, {regular_sql('gappy')},
x AS (SELECT series_id, ds, y, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS pos FROM reg),
k AS (SELECT *,
  {_FF.format(c='CASE WHEN y IS NOT NULL THEN pos END')} AS pp, {_FF.format(c='y')} AS pv,
  {_BF.format(c='CASE WHEN y IS NOT NULL THEN pos END')} AS np, {_BF.format(c='y')} AS nv FROM x)
SELECT series_id, ds, {r('CASE WHEN y IS NOT NULL THEN y WHEN pp IS NULL THEN NULL WHEN np IS NULL THEN pv ELSE pv + (nv - pv) * ((pos - pp) / (np - pp)) END')} AS y
FROM k""")
def interp_linear(spark, sf):
    """M5: linear interpolation by row position on the regular grid; leading gap NULL, trailing gap carried."""
    df = miss.regularize(fx.hourly_gappy(spark, sf).select("series_id", "ds", "y"), flag=None, pos_col="_pos")
    return rounded(ordd.interpolate_linear(df, ["y"], pos_col="_pos").drop("_pos"))


@register("calendar_parts", f"""WITH {HWIDE}
SELECT ds, hour(ds)::INTEGER AS hour, (isodow(ds) - 1)::INTEGER AS day_of_week, month(ds)::INTEGER AS month,
       weekofyear(ds)::INTEGER AS week_of_year, quarter(ds)::INTEGER AS quarter,
       CAST(isodow(ds) - 1 IN (5, 6) AS INTEGER) AS is_weekend, ("Day" * 24 + "H")::INTEGER AS hour_of_week
FROM hw""")
def calendar_parts(spark, sf):
    """Hour, weekday (Mon=0), month, ISO week, quarter, weekend flag, hour of week (Day*24+H)."""
    df = fx.hourly_wide(spark, sf)
    return cal.calendar_features(df, day_col="Day", hour_col="H").select("ds", *cal.ALL_PARTS)


@register("weekend_flag", f"""WITH {HBT}
SELECT series_id, ds, CAST(isodow(ds) - 1 IN (5, 6) AS INTEGER) AS is_weekend FROM hbt
WHERE isodow(ds) - 1 IN (5, 6)""")
def weekend_flag(spark, sf):
    """F10 + T6: ``isin(5, 6)`` predicate as a filter and as a flag."""
    df = cal.calendar_features(fx.hourly_by_type(spark, sf), parts=["day_of_week", "is_weekend"])
    return df.filter(flt.is_in("day_of_week", [5, 6])).select("series_id", "ds", "is_weekend")


@register("month_bucket", f"""WITH {DAILY}
SELECT make_timestamp(year(ds), month(ds), 1, 0, 0, 0) AS month, count(*) AS n_days, {r('sum(y)')} AS y
FROM daily GROUP BY ALL""")
def month_bucket(spark, sf):
    """Month bucket of the long daily series, summed."""
    df = cal.month_bucket(fx.daily_orders(spark, sf))
    return rounded(df.groupBy("month").agg(F.count(F.lit(1)).alias("n_days"), F.sum("y").alias("y")))


@register("format_minutes", f"""WITH {HBT}
SELECT series_id, strftime(ds, '%Y-%m-%d %H:%M') AS ds_text FROM hbt""")
def format_minutes(spark, sf):
    """``yyyy-MM-dd HH:mm`` text."""
    return cal.format_minutes(fx.hourly_by_type(spark, sf), "ds", "ds_text").select("series_id", "ds_text")


@register("preview_range", f"""WITH {HBT}
SELECT series_id, ds, {r('y')} AS y FROM hbt WHERE ds >= TIMESTAMP '{LO}' AND ds <= TIMESTAMP '{HI}'
ORDER BY ds, series_id LIMIT 20""")
def preview_range(spark, sf):
    """First 20 rows (by time, then series) inside a range - a preview, so the limit is the feature."""
    df = fx.hourly_by_type(spark, sf, LO, HI).select("series_id", "ds", "y")
    return rounded(cal.show_between(df, LO, HI, n=20, order=["ds", "series_id"]))


@register("mean_stdpop", f"""WITH {HBT}
SELECT series_id, {r('avg(y)')} AS mean_y, {r('stddev_pop(y)')} AS std_pop_y FROM hbt GROUP BY series_id""")
def mean_stdpop(spark, sf):
    """Mean and population standard deviation (the z-score statistics)."""
    df = fx.hourly_by_type(spark, sf)
    return rounded(df.groupBy("series_id").agg(F.avg("y").alias("mean_y"), F.stddev_pop("y").alias("std_pop_y")))


@register("distinct_values", f"""WITH {HBT}
SELECT DISTINCT n_users FROM hbt""")
def distinct_values(spark, sf):
    """Distinct values."""
    return fx.hourly_by_type(spark, sf).select("n_users").distinct()


@register("csv_roundtrip", f"""WITH {DAILY}
SELECT series_id, ds, {r('y')} AS y, n_orders, {r('qty')} AS qty FROM daily""")
def csv_roundtrip(spark, sf):
    """Feature table written as header CSV to the shared checkpoint location, read back by extension
    with an explicit schema (NaN -> NULL normalisation on load)."""
    df = fx.daily_orders(spark, sf).select("series_id", "ds", "y", "n_orders", "qty")
    path = scratch_path(spark, "csv", ".csv")
    io.save_table(df, path, "csv")
    schema = "series_id string, ds timestamp_ntz, y double, n_orders bigint, qty double"
    return rounded(io.load_dataset(spark, path, schema=schema))


# ------------------------------------------------------------------ column helpers and further branches


@register("column_helpers", f"""WITH {HWIDE}
SELECT ds, {r('y')} AS y, n_click, n_view FROM hw""")
def column_helpers(spark, sf):
    """Existing and required columns, duplicated names, numeric columns by prefix, range
    and non-empty checks."""
    df = fx.hourly_wide(spark, sf)
    have = cols.existing_cols(df, ["ds", "y", "n_click", "n_view", "no_such_column"], warn=False)
    cols.require_cols(df, have)
    twice = cols.dedupe_columns(df.select(*have, F.lit(-1).alias("n_click"), F.col("n_view")))
    chosen = cols.feature_name_filter(cols.numeric_cols(twice, exclude=("y",)), prefixes=("n_",))
    flt.validate_range_from_data(twice, *twice.agg(F.min("ds"), F.max("ds")).first())
    return rounded(flt.require_non_empty(twice).select("ds", "y", *chosen))


@register("dataset_formats", f"""WITH {DAILY}
SELECT series_id, ds, n_orders, {r('y')} AS y, {r("CASE WHEN n_orders % 2 = 0 THEN avg_discount END")} AS disc FROM daily""")
def dataset_formats(spark, sf):
    """S2 + S3: a table with NaN written as Parquet, then as ORC, each read back by its extension; NaN becomes NULL."""
    df = fx.daily_orders(spark, sf).select("series_id", "ds", "n_orders", "y", F.when(F.col("n_orders") % 2 == 0, F.col("avg_discount")).otherwise(F.lit(float("nan"))).alias("disc"))
    path = scratch_path(spark, "daily", ".parquet")
    io.save_table(df, path, "parquet")
    again = scratch_path(spark, "daily", ".orc")
    io.save_table(io.load_dataset(spark, path), again, "orc")
    return rounded(io.load_dataset(spark, again))


@register("bfill_ffill_panel", f"""WITH {GAPPY}, {regular_sql('gappy')}
SELECT series_id, ds, {r("coalesce(first_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")} AS y FROM reg""")
def bfill_ffill_panel(spark, sf):
    """M3, the other order: backward fill, then forward fill of the trailing gap."""
    df = miss.regularize(fx.hourly_gappy(spark, sf).select("series_id", "ds", "y"), flag=None)
    return rounded(ordd.bfill_ffill(df, ["y"]))


@register("regularize_offgrid", f"""WITH {HBT}, raw AS (SELECT event_type AS series_id, ts, value FROM events),
g AS (SELECT series_id, {ROUND_HOUR.format(c='ts')} AS ds, avg(value) AS y FROM raw GROUP BY ALL), {regular_sql('g')}
SELECT series_id, ds, {r('y')} AS y, is_filled FROM reg""")
def regularize_offgrid(spark, sf):
    """M7 on rows off the hour and repeated hours: rounded and averaged first, none lost."""
    raw = fx.table(spark, sf, "events").select(F.col("event_type").alias("series_id"), F.col("ts").alias("ds"), F.col("value").alias("y"))
    return rounded(miss.regularize(raw, off_grid="aggregate"))
