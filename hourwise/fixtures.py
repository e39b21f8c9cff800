"""Panels built from the driver tables (FIXTURES.md section 2).

They only reshape the given tables into the schemas the operators expect (``series_id, ds, y, ...``);
no operator result is taken from how they are built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwise.functions import time as tf

# The five event types of the driver's ``events`` table, as per-hour count columns.
EVENT_TYPES = ("click", "view", "error", "purchase", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hour_range_prefilter(df: DataFrame, lo=None, hi=None, ts: str = "ts") -> DataFrame:
    """Rows that can round into hours [lo, hi]: ``lo - 30 min <= ts <= hi + 30 min``.

    A plain comparison on the raw column, so the Parquet scan receives it as a pushed filter; an hour inside
    the range keeps all its rows, and the exact filter on the rounded hour is applied after aggregation.
    """
    c = F.col(ts)
    if lo is not None:
        df = df.filter(c >= F.lit(str(lo)).cast("timestamp_ntz") - F.expr("INTERVAL 30 MINUTES"))
    if hi is not None:
        df = df.filter(c <= F.lit(str(hi)).cast("timestamp_ntz") + F.expr("INTERVAL 30 MINUTES"))
    return df


def hourly_by_type(spark: SparkSession, sf_dir: str, lo=None, hi=None) -> DataFrame:
    """Many series: one per event type, hourly mean value, event and distinct-user counts.
    ``lo`` / ``hi`` push a superset of an hour range down to the scan (callers still filter ``ds``)."""
    ev = hour_range_prefilter(table(spark, sf_dir, "events"), lo, hi).select("event_type", "ts", "user_id", "value")
    return ev.groupBy(F.col("event_type").alias("series_id"), tf.round_hour("ts").alias("ds")).agg(
        F.avg("value").alias("y"),
        F.count(F.lit(1)).alias("n_events"),
        F.countDistinct("user_id").alias("n_users"),
    )


def hourly_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series with regressors: hourly mean value, a count per event type and calendar columns."""
    ev = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    agg = ev.groupBy(tf.round_hour("ts").alias("ds")).agg(
        F.avg("value").alias("y"),
        *[F.count_if(F.col("event_type") == F.lit(t)).alias(f"n_{t}") for t in EVENT_TYPES],
    )
    wd = tf.weekday("ds")
    return agg.select(
        F.lit("all").alias("series_id"), "*",
        wd.alias("Day"), F.hour("ds").alias("H"), (wd < 5).cast("int").alias("WDAY"),
    )


def hourly_gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hourly_by_type`` with missing targets and missing hours (irregular grid)."""
    p = hourly_by_type(spark, sf_dir)
    h = tf.epoch_hours("ds")
    return p.filter(h % 23 != 0).withColumn("y", F.when(h % 17 != 0, F.col("y")))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long daily series: order totals per day, lineitem quantities summed per order first, left-joined."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("_qty"), F.sum("l_discount").alias("_disc"), F.count(F.lit(1)).alias("_lines"))
    j = orders.join(li, orders.o_orderkey == li.l_orderkey, "left")
    return j.groupBy(tf.day_start("o_orderdate").alias("ds")).agg(
        F.sum("o_totalprice").alias("y"),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("_qty").alias("qty"),
        (F.sum("_disc") / F.sum("_lines")).alias("avg_discount"),
    ).select(F.lit("orders").alias("series_id"), "*")


def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the timestamp as text and every 50th value replaced by ``'bad'``."""
    ev = table(spark, sf_dir, "events")
    txt = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return ev.select(
        "event_id", "event_type",
        F.when(F.col("event_id") % 50 == 0, F.lit("bad")).otherwise(txt).alias("ts_text"),
        F.when(F.col("event_id") % 50 == 25, F.lit("bad")).otherwise(F.col("value").cast("string")).alias("value_text"),
    )
