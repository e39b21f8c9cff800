"""Sources and sinks (S1-S8): CSV / Parquet / JSON / ORC tables, score tables, forecasts, metrics, models."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

_READERS = {
    ".csv": "csv",
    ".parquet": "parquet",
    ".pq": "parquet",
    ".json": "json",
    ".jsonl": "json",
    ".orc": "orc",
}


def nan_to_null(df: DataFrame, cols=None) -> DataFrame:
    """Missing = NULL: floating NaN becomes NULL (Spark aggregates treat NaN as a value)."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = [c for c in (cols or df.columns) if c in floats]
    if not targets:
        return df
    return df.select(
        *[F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c in targets else F.col(c) for c in df.columns]
    )


def load_csv(spark: SparkSession, path: str, schema=None, normalize: bool = True) -> DataFrame:
    """Header CSV; an explicit schema avoids the inference pass (use one in production)."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return nan_to_null(df) if normalize else df


def load_dataset(spark: SparkSession, path: str, fmt: str | None = None, schema=None) -> DataFrame:
    """Dispatch on format or lower-cased file extension; unsupported -> ValueError."""
    if fmt is None:
        ext = os.path.splitext(path.rstrip("/"))[1].lower()
        fmt = _READERS.get(ext)
        if fmt is None:
            raise ValueError(f"Unsupported file type {ext!r}; use CSV, Parquet, JSON or ORC (Excel: convert upstream)")
    fmt = fmt.lower()
    if fmt == "csv":
        return load_csv(spark, path, schema)
    if fmt not in ("parquet", "json", "orc"):
        raise ValueError(f"Unsupported format {fmt!r}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return nan_to_null(reader.format(fmt).load(path))


def save_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> None:
    """Feature / prepared-data sink.  ``partition_by`` (e.g. a month column) lets range filters prune files."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def save_scores(scores: DataFrame, path: str, fmt: str = "csv") -> None:
    """Score table ``(feature, score)`` written with the display names ``Column Name, MI Score``."""
    out = scores.select(F.col("feature").alias("Column Name"), F.col("score").alias("MI Score"))
    save_table(out, path, fmt)


def load_scores(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    schema = "`Column Name` string, `MI Score` double"
    df = load_csv(spark, path, schema) if fmt == "csv" else spark.read.format(fmt).load(path)
    return df.select(F.col("Column Name").alias("feature"), F.col("MI Score").cast("double").alias("score"))


def save_forecast(df: DataFrame, path: str, fmt: str = "csv") -> None:
    save_table(df, path, fmt)


def metrics_two_decimals(metrics: DataFrame) -> DataFrame:
    """Metric values rounded to 2 decimals, as the reference prints them."""
    cols = []
    for f in metrics.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name), 2) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return metrics.select(*cols)


def save_metrics(metrics: DataFrame, path: str, fmt: str = "csv") -> None:
    save_table(metrics_two_decimals(metrics), path, fmt)


def save_model(model: DataFrame, path: str) -> None:
    """A fitted model is a coefficient table (one row per series)."""
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:  # missing file -> clear error
        raise FileNotFoundError(f"no model table at {path}: train first") from exc
