"""Column helpers, sinks and the model table round trip."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from hourwise.operators import columns as cols
from hourwise.operators import filters as flt
from hourwise.session import shared_dir
from hourwise.sources import io


def _df(spark):
    return spark.createDataFrame([(dt.datetime(2024, 1, 1, h), float(h), h % 2 == 0) for h in range(5)],
                                 "Date timestamp_ntz, PriceHU double, flag boolean")


def test_column_helpers(spark):
    df = _df(spark)
    with pytest.warns(UserWarning):
        assert cols.existing_cols(df, ["Date", "nope"]) == ["Date"]
    with pytest.raises(KeyError):
        cols.require_cols(df, ["nope"])
    with pytest.raises(KeyError):
        cols.drop_cols(df, ["nope"], strict=True)
    assert cols.drop_cols(df, ["nope"]).columns == df.columns
    assert cols.numeric_cols(df) == ["PriceHU"]
    assert cols.feature_name_filter(["lag_1", "GAS", "rolling_mean_3h"], prefixes=["lag_", "rolling_"]) == ["lag_1", "rolling_mean_3h"]
    dup = df.select("Date", "PriceHU", F.col("flag").alias("PriceHU"))
    assert cols.dedupe_columns(dup).columns == ["Date", "PriceHU"]
    m = cols.as_model_frame(df)
    assert m.columns[:2] == ["ds", "y"] and "Date" not in m.columns


def test_validate_and_non_empty(spark):
    flt.validate_range("2024-01-01 00:00", "2024-01-02 00:00", "2017-01-01 00:00", "2024-08-20 23:00")
    with pytest.raises(ValueError):
        flt.validate_range("2024-01-02 00:00", "2024-01-01 00:00")
    with pytest.raises(ValueError):
        flt.require_non_empty(_df(spark).filter(F.lit(False)))


def test_load_dataset_dispatch_and_model_roundtrip(spark):
    with pytest.raises(ValueError):
        io.load_dataset(spark, "/tmp/x.xlsx")
    base = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    model = spark.createDataFrame([("a", [1.0, 2.0])], "_sid string, beta array<double>")
    io.save_model(model, base + "/model")
    assert io.load_model(spark, base + "/model").first()["beta"] == [1.0, 2.0]
    with pytest.raises(FileNotFoundError):
        io.load_model(spark, base + "/missing")
    io.save_forecast(_df(spark).select(F.col("Date").alias("ds"), F.col("PriceHU").alias("yhat")), base + "/fc.csv")
    back = io.load_dataset(spark, base + "/fc.csv", schema="ds timestamp_ntz, yhat double")
    assert back.count() == 5


def test_to_numeric_report_and_range_checks(spark):
    import datetime as dt

    from hourwise.operators import missing as miss

    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("2",)], "v string")
    with pytest.warns(UserWarning):
        out, lost = cols.to_numeric(df, ["v"], report=True)
    assert lost == {"v": 1} and sorted(r["v"] for r in out.collect() if r["v"] is not None) == [1.5, 2.0]
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 1, h),) for h in range(10)], "ds timestamp_ntz")
    flt.validate_range_from_data(ts, "2024-01-01 02:00:00", "2024-01-01 05:00:00")
    with pytest.raises(ValueError):
        flt.validate_range_from_data(ts, "2023-12-31 00:00:00", "2024-01-01 05:00:00")
    grid = miss.hour_range(spark, "2024-01-01 00:00:00", "2024-12-31 23:00:00")  # crosses grid chunks
    assert grid.count() == 366 * 24 and grid.distinct().count() == 366 * 24
