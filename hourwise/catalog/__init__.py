"""Registered queries: each is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables, with the equivalent
DuckDB SQL when the operator is SQL-expressible.

Doubles are rounded (to ``DIGITS`` decimals, -0.0 folded to 0.0) at the end of each registered query and of
its SQL so the two engines' last-bit differences do not decide the comparison; the library operators
themselves return full precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
DIGITS = 6
# Values that are exact decimal ties (e.g. means of 2-decimal data) would round either way depending on the
# engines' last-bit differences; a fixed offset far below the rounding step moves them off the tie on both sides.
NUDGE = 3e-9


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column; ``+ 0.0`` folds -0.0 into 0.0."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(c + F.lit(NUDGE), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def r(expr: str, digits: int = DIGITS) -> str:
    """SQL twin of ``rounded`` for one expression."""
    return f"(round(({expr})::DOUBLE + {NUDGE!r}, {digits}) + 0.0)"


# ------------------------------------------------------------------ SQL building blocks (DuckDB)

ROUND_HOUR = "make_timestamp(CAST(round_even(epoch_us({c}) / 3600000000.0, 0) AS BIGINT) * 3600000000)"

HBT = f"""hbt AS (
  SELECT event_type AS series_id, {ROUND_HOUR.format(c='ts')} AS ds,
         avg(value) AS y, count(*) AS n_events, count(DISTINCT user_id) AS n_users
  FROM events GROUP BY ALL)"""

HWIDE = f"""hw0 AS (
  SELECT {ROUND_HOUR.format(c='ts')} AS ds, avg(value) AS y,
         count(*) FILTER (WHERE event_type = 'click') AS n_click,
         count(*) FILTER (WHERE event_type = 'view') AS n_view,
         count(*) FILTER (WHERE event_type = 'error') AS n_error,
         count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase,
         count(*) FILTER (WHERE event_type = 'signup') AS n_signup
  FROM events GROUP BY ALL),
hw AS (
  SELECT 'all' AS series_id, *, (isodow(ds) - 1)::INTEGER AS "Day", hour(ds)::INTEGER AS "H",
         CAST((isodow(ds) - 1) < 5 AS INTEGER) AS "WDAY"
  FROM hw0)"""

GAPPY = f"""{HBT},
gappy AS (
  SELECT series_id, ds, CASE WHEN (epoch_us(ds) // 3600000000) % 17 <> 0 THEN y END AS y, n_events, n_users
  FROM hbt WHERE (epoch_us(ds) // 3600000000) % 23 <> 0)"""

DAILY = """daily AS (
  SELECT 'orders' AS series_id, date_trunc('day', o.o_orderdate)::TIMESTAMP AS ds,
         sum(o.o_totalprice) AS y, count(*) AS n_orders, sum(li.qty) AS qty, sum(li.disc) / sum(li.lines) AS avg_discount
  FROM orders o LEFT JOIN (
      SELECT l_orderkey, sum(l_quantity) AS qty, sum(l_discount) AS disc, count(*) AS lines
      FROM lineitem GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey
  GROUP BY ALL)"""

TEXT_DATES = """td AS (
  SELECT event_id, event_type,
         CASE WHEN event_id % 50 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_text,
         CASE WHEN event_id % 50 = 25 THEN 'bad' ELSE CAST(value AS VARCHAR) END AS value_text
  FROM events)"""


def regular_sql(src: str, name: str = "reg") -> str:
    """Hourly grid per series joined with ``src`` (series_id, ds, ...)."""
    return f"""{name}_b AS (SELECT series_id, min(ds) AS lo, max(ds) AS hi FROM {src} GROUP BY series_id),
{name}_g AS (SELECT series_id, unnest(range(lo, hi + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ds FROM {name}_b),
{name} AS (SELECT g.series_id, g.ds, s.* EXCLUDE (series_id, ds), CASE WHEN s.ds IS NULL THEN 1 ELSE 0 END AS is_filled
           FROM {name}_g g LEFT JOIN {src} s ON g.series_id = s.series_id AND g.ds = s.ds)"""


def ensure_loaded() -> None:
    from hourwise.catalog import features, longseries, model, prep, selection  # noqa: F401
