"""Structured Streaming counterparts of the batch panel build and scoring.

The reference has no streams; these keep the same operators usable on an arriving event feed:

* ``hourly_panel_stream`` - P3 + per-hour aggregation with an event-time watermark: each (series, hour) row
  is emitted once, when the watermark passes the hour (append mode), and its state is then dropped.
* ``score_stream`` - applies a fitted model table to every micro-batch of new hourly rows (``foreachBatch``),
  writing predictions to a sink; the model table is joined per series like the batch ``predict``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.functions import time as tf
from hourwise.plans.model import predict
from hourwise.plans.spec import ForecastSpec


def hourly_panel_stream(events: DataFrame, series_col: str = "event_type", ts: str = "ts", value: str = "value",
                        watermark: str = "2 hours") -> DataFrame:
    """Streaming hourly panel ``(series_id, ds, y, n_events)``; ``ds`` = nearest hour (ties to even).

    Distinct counts are not available on streams, so ``n_users`` of the batch panel is left out.
    """
    rounded = events.select(F.col(series_col).alias("series_id"), tf.round_hour(ts).cast("timestamp").alias("ds"),
                            F.col(value).alias("_v"))
    return (rounded.withWatermark("ds", watermark)
            .groupBy("series_id", "ds")
            .agg(F.avg("_v").alias("y"), F.count(F.lit(1)).alias("n_events")))


def score_stream(rows: DataFrame, model: DataFrame, spec: ForecastSpec, sink: Callable[[DataFrame, int], None],
                 checkpoint: str, trigger: dict | None = None):
    """Start a query that predicts every micro-batch of ``rows`` (series, ds, regressors) with ``model`` and
    hands the predictions to ``sink(df, batch_id)`` (idempotent writes keyed by batch id)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        fut = batch.withColumn("ds", F.col("ds").cast("timestamp_ntz"))
        sink(predict(model, fut, spec), batch_id)

    w = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
