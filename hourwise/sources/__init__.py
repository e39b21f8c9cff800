"""Readers and writers."""

from hourwise.sources.io import (  # noqa: F401
    load_csv,
    load_dataset,
    load_model,
    load_scores,
    metrics_two_decimals,
    nan_to_null,
    save_forecast,
    save_metrics,
    save_model,
    save_scores,
    save_table,
)
