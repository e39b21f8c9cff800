"""hourwise: time-series preparation, feature selection, forecasting and evaluation on Spark DataFrames.

Every operator is a ``DataFrame -> DataFrame`` function.  Ordered operators take ``partition_cols``
(default ``("series_id",)``) and ``order_col`` (default ``"ds"``) and run in a chunked mode that splits a
series into bounded position chunks, so one long or hot series never lands in a single task.
"""

from hourwise.session import get_session, shared_dir  # noqa: F401

__all__ = ["get_session", "shared_dir"]
