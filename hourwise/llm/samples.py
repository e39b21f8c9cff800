"""Bounded samples of labelled rows, fitted in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwise.llm.arrays import lean


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text is divisible by 5. A NULL id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def share(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows of ``df``, never more than twice as many: those with the smallest hashes of ``key``."""
    n = df.count()
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 24)) < int((1 << 24) * rows / n)).limit(2 * rows)


def fitted(sample: DataFrame, fit: Callable[[pd.DataFrame], bytes]) -> bytes:
    """``fit`` of the whole (bounded) sample, run in one task; the model comes back as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        sample = pd.concat(got, ignore_index=True) if got else None
        got.clear()
        yield pd.DataFrame({"model": [fit(sample)]})

    got = sample.repartition(1).mapInPandas(lean(run), "model binary").first()
    return bytes(got[0]) if got else fit(None)
