"""Tables of a job: the given ones, and those handed from one step to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourwise.session import cut_lineage, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


handed = cut_lineage
