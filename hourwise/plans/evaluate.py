"""Forecast evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.functions import time as tf
from hourwise.operators.filters import between_ts
from hourwise.operators.joins import align_actuals


def metrics(pairs: DataFrame, group_cols: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MAE, MSE, RMSE and n over rows with both values (one aggregate)."""
    ok = pairs.filter(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    err = F.col(y) - F.col(yhat)
    g = list(group_cols)
    agg = (ok.groupBy(*g) if g else ok.groupBy()).agg(
        F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.count(F.lit(1)).alias("n"))
    return agg.select(*g, "mae", "mse", F.sqrt("mse").alias("rmse"), "n")


def evaluate(actual: DataFrame, forecast: DataFrame, on=("series_id", "ds"), by: Sequence[str] = (),
             by_month: bool = False, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Inner-join actuals and forecasts, then metrics (overall, per ``by`` columns, optionally per month)."""
    pairs = align_actuals(actual, forecast, on, y)
    g = list(by)
    if by_month:
        pairs = pairs.withColumn("month", tf.month_start("ds"))
        g.append("month")
    return metrics(pairs, g, y, yhat)


def compare(actual: DataFrame, forecast: DataFrame, lo=None, hi=None, on=("series_id", "ds"), y: str = "y",
            yhat: str = "yhat") -> DataFrame:
    """Actual vs forecast over a range, as a tidy frame with the error columns (the data behind the
    reference's chart)."""
    pairs = align_actuals(between_ts(actual, lo, hi), between_ts(forecast, lo, hi), on, y)
    return pairs.withColumn("error", F.col(y) - F.col(yhat)).withColumn("abs_error", F.abs(F.col("error")))
