"""Ordered (window) operators: positions, lags, rolling statistics, fills, interpolation.

Two execution modes, same results:

* ``mode="plain"``   - one window partition per series (``partitionBy(*partition_cols)``).  Simple, but a
  single long or hot series is sorted inside one task.
* ``mode="chunked"`` - the default.  Rows get a 0-based position ``_pos`` (``seq_index``); positions are cut
  into chunks of ``chunk`` rows and each row is also copied into the following chunk(s) when it lies within
  ``lookback`` rows of their start (a *halo*).  Windows then run over ``(series, chunk)``, halo rows are dropped.
  Lags and rolling frames only look back a bounded number of rows, so this is exact.  Operators with unbounded
  look-back (fills, EMA carry) compute per-chunk summaries, carry them across the small chunk table
  (one row per chunk) and join the carry back on ``(series, chunk)``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourwise.operators.joins import null_safe_join
from hourwise.functions import time as tf
from hourwise.functions.names import lag_name, rolling_mean_name, rolling_std_name
from hourwise.session import cut_lineage

DEFAULT_CHUNK = 4096
#: Chunks of a series whose states are passed on together.
SCAN_ROWS = 4096
POS = "_pos"
CHUNK = "_chunk"
OWN = "_own_chunk"


def _cols(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def order_key(df: DataFrame, order_col: str) -> Column:
    """Numeric image of the order column used for bucketing: epoch hours for timestamps, days for dates."""
    dt = df.schema[order_col].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return tf.epoch_micros(order_col) / F.lit(tf.MICROS_PER_HOUR)
    if isinstance(dt, T.DateType):
        return F.datediff(F.col(order_col), F.lit("1970-01-01").cast("date")).cast("double")
    return F.col(order_col).cast("double")


#: A bucket that is too full is cut into so many; spans halve from 2^12 hours (or key units) to below a microsecond, then
#: rows of one instant are told apart by the bits of a hash.
_SPLIT_BITS, _TIME_LEVELS, _HASH_LEVELS = 6, 8, 10
_FIRST_HASH = -(1 << 63)


def tie_order(df: DataFrame, known: Sequence[str]) -> Column:
    """Order of rows with equal ``known`` columns: a hash of all others, so rows that share it are interchangeable."""
    rest = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in known and f.dataType.typeName() not in ("map", "variant")]
    return F.xxhash64(*rest) if rest else F.lit(0).cast("bigint")


def seq_index(
    df: DataFrame,
    partition_cols: Sequence[str] = ("series_id",),
    order_col: str = "ds",
    out: str = "seq",
    mode: str = "chunked",
    bucket_rows: int = DEFAULT_CHUNK,
    bucket_width: float = DEFAULT_CHUNK,
    weight: str | None = None,
) -> DataFrame:
    """0-based row position per series (``np.arange(len)`` of the ordered series).

    Rows without a time come last; rows of equal time are in the order of ``tie_order``, so the rows alone decide. A NULL
    series is a series.

    ``weight``: a column of numbers of rows that each row stands for (0 too); the position is then their sum over the rows
    before.

    ``mode="plain"``: ``row_number`` over one window per series.
    ``mode="chunked"``: a tree of buckets. Rows are counted per series and ``bucket_width`` hours (or key units); only
    buckets of more than ``bucket_rows`` rows are cut, and counted, again: to 64 times shorter spans, and inside one
    instant by the tie's hash. Running offsets over the small count table are joined back, and ``row_number`` inside a
    bucket finishes the position: no window holds more than ``bucket_rows`` rows that differ, whatever the bursts.
    """
    pc = _cols(partition_cols)
    keyed = df.withColumns({"_bucket_k": order_key(df, order_col), "_bucket_tie": tie_order(df, [*pc, order_col])})
    order = [F.col(order_col).asc_nulls_last(), F.col("_bucket_tie")]
    stands = F.lit(1).cast("bigint") if weight is None else F.col(f"`{weight}`").cast("bigint")
    earlier = (Window.unboundedPreceding, -1)
    before = lambda w: (F.row_number().over(w) - 1).cast("bigint") if weight is None else F.coalesce(F.sum(stands).over(w.rowsBetween(*earlier)), F.lit(0))
    if mode == "plain":
        w = Window.partitionBy(*pc).orderBy(*order)
        return keyed.withColumn(out, before(w)).drop("_bucket_k", "_bucket_tie")
    start = lambda width: F.col("_bucket_k") - F.pmod(F.col("_bucket_k"), F.lit(float(width)))
    node = [*pc, "_bucket_t", "_bucket_h"]
    size = (F.count(F.lit(1)).alias("_bucket_n"), F.sum(stands).alias("_bucket_w"))
    keyed = keyed.withColumns({"_bucket_t": start(bucket_width), "_bucket_h": F.lit(_FIRST_HASH).cast("bigint")})
    counts = cut_lineage(keyed.groupBy(*node).agg(*size), "buckets")
    for level in range(1, _TIME_LEVELS + _HASH_LEVELS + 1):
        if (counts.agg(F.max("_bucket_n")).first()[0] or 0) <= bucket_rows:
            break
        full = counts.filter(F.col("_bucket_n") > bucket_rows).select(*node, F.lit(True).alias("_bucket_full"))
        keyed = null_safe_join(keyed, full, node)
        if level <= _TIME_LEVELS:
            finer = {"_bucket_t": F.when(F.col("_bucket_full"), start(bucket_width / 2.0 ** (_SPLIT_BITS * level))).otherwise(F.col("_bucket_t"))}
        else:
            low = 64 - _SPLIT_BITS * (level - _TIME_LEVELS)
            finer = {"_bucket_h": F.when(F.col("_bucket_full"), F.shiftleft(F.shiftright("_bucket_tie", low), low)).otherwise(F.col("_bucket_h"))}
        keyed = keyed.withColumns(finer)
        cut = keyed.filter("_bucket_full").groupBy(*node).agg(*size)
        counts = cut_lineage(counts.filter(F.col("_bucket_n") <= bucket_rows).unionByName(cut), "buckets")
        keyed = keyed.drop("_bucket_full")
    run = Window.partitionBy(*pc).orderBy(F.col("_bucket_t").asc_nulls_last(), "_bucket_h").rowsBetween(*earlier)
    offsets = counts.select(*node, F.coalesce(F.sum("_bucket_w").over(run), F.lit(0)).alias("_bucket_off"))
    w = Window.partitionBy(*node).orderBy(*order)
    res = null_safe_join(keyed, offsets, node).withColumn(out, (F.col("_bucket_off") + before(w)).cast("bigint"))
    return res.drop("_bucket_t", "_bucket_h", "_bucket_off", "_bucket_k", "_bucket_tie")


def ensure_pos(df: DataFrame, pc: list[str], order_col: str, pos_col: str | None = None) -> tuple[DataFrame, str, bool]:
    """Use ``pos_col`` when given and present, else add ``_pos``.  Returns (df, name, created)."""
    if pos_col and pos_col in df.columns:
        return df, pos_col, False
    return seq_index(df, pc, order_col, out=POS, mode="chunked"), POS, True


def with_halo(df: DataFrame, pos: str, lookback: int, chunk: int) -> DataFrame:
    """Assign ``_own_chunk`` and explode each row into its own chunk plus the chunks whose first
    ``lookback`` rows it precedes."""
    own = F.floor(F.col(pos) / F.lit(chunk)).cast("bigint")
    last = F.floor((F.col(pos) + F.lit(lookback)) / F.lit(chunk)).cast("bigint")
    df = df.withColumn(OWN, own)
    if lookback <= 0:
        return df.withColumn(CHUNK, F.col(OWN))
    return df.withColumn(CHUNK, F.explode(F.sequence(F.col(OWN), last)))


def windowed(
    df: DataFrame,
    build: Callable[[Window], list[Column]],
    partition_cols: Sequence[str] = ("series_id",),
    order_col: str = "ds",
    lookback: int = 0,
    mode: str = "chunked",
    chunk: int = DEFAULT_CHUNK,
    pos_col: str | None = None,
) -> DataFrame:
    """Add the columns ``build(w)`` returns, where ``w`` is the ordered window of one series.

    Every frame built on ``w`` must look back at most ``lookback`` rows and never forward.
    """
    pc = _cols(partition_cols)
    if mode == "plain":
        w = Window.partitionBy(*pc).orderBy(*([F.col(pos_col)] if pos_col and pos_col in df.columns else [F.col(order_col).asc_nulls_last(), tie_order(df, [*pc, order_col])]))
        return df.select("*", *build(w))
    base_cols = df.columns
    df, pos, created = ensure_pos(df, pc, order_col, pos_col)
    chunk = max(int(chunk), int(lookback), 1)
    halo = with_halo(df, pos, lookback, chunk)
    w = Window.partitionBy(*pc, CHUNK).orderBy(pos)
    out = halo.select("*", *build(w)).filter(F.col(CHUNK) == F.col(OWN)).drop(CHUNK, OWN)
    new = [c for c in out.columns if c not in base_cols and not (created and c == pos)]
    return out.select(*[F.col(f"`{c}`") for c in base_cols + new])


# ---------------------------------------------------------------- lags and rolling statistics


def _lag_cols(w: Window, cols: list[str], lags: Sequence[int], single_name: bool) -> list[Column]:
    return [F.lag(F.col(c), int(k)).over(w).alias(lag_name(None if single_name else c, k)) for c in cols for k in lags]


def _rolling_cols(w: Window, cols, windows, single_name: bool, stats=("mean", "std")) -> list[Column]:
    out = []
    for c in cols:
        for n in windows:
            n = int(n)
            f = w.rowsBetween(-(n - 1), 0)
            full = F.count(F.col(c)).over(f) == F.lit(n)
            if "mean" in stats:
                out.append(F.when(full, F.avg(F.col(c)).over(f)).alias(rolling_mean_name(None if single_name else c, n)))
            if "std" in stats:
                out.append(F.when(full, F.stddev_samp(F.col(c)).over(f)).alias(rolling_std_name(None if single_name else c, n)))
    return out


def add_lags(df: DataFrame, cols, lags: Sequence[int], partition_cols=("series_id",), order_col="ds",
             mode="chunked", chunk=DEFAULT_CHUNK, pos_col=None, prefix_names: bool | None = None) -> DataFrame:
    """``shift(k)`` per series.  One column -> ``lag_{k}``; several -> ``{col}_lag_{k}``."""
    cols = _cols(cols)
    single = (len(cols) == 1) if prefix_names is None else not prefix_names
    return windowed(df, lambda w: _lag_cols(w, cols, lags, single), partition_cols, order_col,
                    max(lags), mode, chunk, pos_col)


def add_rolling(df: DataFrame, cols, windows: Sequence[int], partition_cols=("series_id",), order_col="ds",
                mode="chunked", chunk=DEFAULT_CHUNK, pos_col=None, stats=("mean", "std"),
                prefix_names: bool | None = None) -> DataFrame:
    """Trailing ``n``-row mean / sample std including the current row; NULL unless all ``n`` rows
    are present and non-missing (pandas ``rolling(n)`` default).  ``n = 1`` std is NULL."""
    cols = _cols(cols)
    single = (len(cols) == 1) if prefix_names is None else not prefix_names
    return windowed(df, lambda w: _rolling_cols(w, cols, windows, single, stats), partition_cols, order_col,
                    max(windows) - 1, mode, chunk, pos_col)


def add_history_features(df: DataFrame, cols, lags: Sequence[int] = (), windows: Sequence[int] = (),
                         partition_cols=("series_id",), order_col="ds", mode="chunked", chunk=DEFAULT_CHUNK,
                         pos_col=None, prefix_names: bool | None = None, exclude_current: bool = False) -> DataFrame:
    """Lags and rolling statistics of several columns in **one** window pass (one sort, one halo).

    ``exclude_current`` shifts rolling frames back by one row (no target leakage, D11)."""
    cols = _cols(cols)
    single = (len(cols) == 1) if prefix_names is None else not prefix_names

    def build(w):
        out = _lag_cols(w, cols, lags, single)
        if exclude_current:
            for c in cols:
                for n in windows:
                    f = w.rowsBetween(-int(n), -1)
                    full = F.count(F.col(c)).over(f) == F.lit(int(n))
                    out.append(F.when(full, F.avg(c).over(f)).alias(rolling_mean_name(None if single else c, n)))
                    out.append(F.when(full, F.stddev_samp(c).over(f)).alias(rolling_std_name(None if single else c, n)))
        else:
            out += _rolling_cols(w, cols, windows, single)
        return out

    look = max([0, *lags, *[int(n) - (0 if exclude_current else 1) for n in windows]])
    return windowed(df, build, partition_cols, order_col, look, mode, chunk, pos_col)


# ---------------------------------------------------------------- fills with unbounded look-back


def fill_multi(df: DataFrame, specs: Sequence[tuple[str, str, str, bool]], partition_cols=("series_id",),
               order_col="ds", mode="chunked", chunk=DEFAULT_CHUNK, pos_col=None) -> DataFrame:
    """Several fills in one pass.  ``specs`` = (source column, "forward" | "backward", output name, exclusive).

    chunked: local fill inside (series, chunk); one per-chunk summary aggregate holds the last (forward) /
    first (backward) non-NULL value of every source; a scan over the small chunk table carries them;
    one join on (series, chunk) brings the carries back.  Output columns replace same-named inputs.
    """
    pc = _cols(partition_cols)

    def frame(direction, exclusive):
        if direction == "forward":
            return Window.unboundedPreceding, -1 if exclusive else 0
        return 1 if exclusive else 0, Window.unboundedFollowing

    def local(w):
        out = []
        for src, direction, _, excl in specs:
            f = w.rowsBetween(*frame(direction, excl))
            agg = F.last if direction == "forward" else F.first
            out.append(agg(F.col(src), ignorenulls=True).over(f))
        return out

    outs = [o for _, _, o, _ in specs]
    if mode == "plain":
        w = Window.partitionBy(*pc).orderBy(*([F.col(pos_col)] if pos_col and pos_col in df.columns else [F.col(order_col).asc_nulls_last(), tie_order(df, [*pc, order_col])]))
        return _replace(df, outs, local(w))

    base_cols = df.columns
    df, pos, created = ensure_pos(df, pc, order_col, pos_col)
    chunked = df.withColumn(CHUNK, F.floor(F.col(pos) / F.lit(int(chunk))).cast("bigint"))
    w = Window.partitionBy(*pc, CHUNK).orderBy(pos)
    tmp = [f"_loc_{i}" for i in range(len(specs))]
    loc = chunked.select("*", *[v.alias(t) for v, t in zip(local(w), tmp)])
    srcs = list(dict.fromkeys((src, direction) for src, direction, _, _ in specs))
    summary = chunked.groupBy(*pc, CHUNK).agg(*[
        (F.max_by if d == "forward" else F.min_by)(F.col(c), F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"_s{i}")
        for i, (c, d) in enumerate(srcs)])
    carry = _carried(summary, pc, [d for _, d in srcs])
    joined = null_safe_join(loc, carry, [*pc, CHUNK])
    vals = [F.coalesce(F.col(t), F.col(f"_carry_{srcs.index((src, direction))}"))
            for t, (src, direction, _, _) in zip(tmp, specs)]
    res = _replace(joined, outs, vals, base_cols)
    drop = [CHUNK, *tmp, *[f"_carry_{i}" for i in range(len(srcs))]] + ([POS] if created else [])
    return res.drop(*drop)


def _carried(summary: DataFrame, pc: list[str], directions: list[str]) -> DataFrame:
    """(keys, ``CHUNK``, ``_carry_i``): the nearest non-NULL ``_s{i}`` of a chunk before (forward) or after it. A scan of two
    levels: inside blocks of ``SCAN_ROWS`` chunks, and over the blocks, so no window holds more rows than that for
    series of up to ``SCAN_ROWS`` blocks."""

    def scan(table: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
        back = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        ahead = Window.partitionBy(*keys).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
        return table.select(*dict.fromkeys([*keys, at]), *[
            (F.last(f"_s{i}", ignorenulls=True).over(back) if d == "forward" else F.first(f"_s{i}", ignorenulls=True).over(ahead)).alias(f"{name}{i}")
            for i, d in enumerate(directions)])

    block = [*pc, "_block"]
    inside = summary.withColumn("_block", F.floor(F.col(CHUNK) / F.lit(SCAN_ROWS)))
    ends = inside.groupBy(*block).agg(*[
        (F.max_by if d == "forward" else F.min_by)(F.col(f"_s{i}"), F.when(F.col(f"_s{i}").isNotNull(), F.col(CHUNK))).alias(f"_s{i}") for i, d in enumerate(directions)])
    both = null_safe_join(scan(inside, block, CHUNK, "_in"), scan(ends, pc, "_block", "_out"), block)
    return both.select(*pc, CHUNK, *[F.coalesce(f"_in{i}", f"_out{i}").alias(f"_carry_{i}") for i in range(len(directions))])


def fill(df: DataFrame, cols, direction: str = "forward", partition_cols=("series_id",), order_col="ds",
         mode="chunked", chunk=DEFAULT_CHUNK, pos_col=None, exclusive: bool = False,
         out_names: Sequence[str] | None = None) -> DataFrame:
    """Nearest previous (forward) / next (backward) non-NULL value of each column.

    ``exclusive`` looks strictly before / after the row.  Results go to ``out_names`` (default: in place).
    """
    cols = _cols(cols)
    outs = list(out_names) if out_names else cols
    specs = [(c, direction, o, exclusive) for c, o in zip(cols, outs)]
    return fill_multi(df, specs, partition_cols, order_col, mode, chunk, pos_col)


def _replace(df: DataFrame, outs: list[str], vals: list[Column], base_cols: list[str] | None = None) -> DataFrame:
    cols = base_cols or df.columns
    extra = [c for c in df.columns if c not in cols]
    repl = dict(zip(outs, vals))
    sel = [repl.pop(c).alias(c) if c in repl else F.col(f"`{c}`") for c in cols]
    sel += [F.col(f"`{c}`") for c in extra]
    sel += [v.alias(n) for n, v in repl.items()]
    return df.select(*sel)


def ffill(df, cols, **kw) -> DataFrame:
    """M1: forward fill."""
    return fill(df, cols, "forward", **kw)


def bfill(df, cols, **kw) -> DataFrame:
    """M2: backward fill."""
    return fill(df, cols, "backward", **kw)


def _two_way(df: DataFrame, cols, forward_first: bool, partition_cols=("series_id",), order_col="ds",
             mode="chunked", chunk=DEFAULT_CHUNK, pos_col=None) -> DataFrame:
    cols = _cols(cols)
    base_cols = df.columns
    f = [f"_ff_{i}" for i in range(len(cols))]
    b = [f"_bf_{i}" for i in range(len(cols))]
    specs = [(c, "forward", o, False) for c, o in zip(cols, f)] + [(c, "backward", o, False) for c, o in zip(cols, b)]
    df = fill_multi(df, specs, partition_cols, order_col, mode, chunk, pos_col)
    pairs = zip(f, b) if forward_first else zip(b, f)
    out = _replace(df, cols, [F.coalesce(F.col(x), F.col(y)) for x, y in pairs])
    return out.select(*[F.col(f"`{c}`") for c in base_cols])


def ffill_bfill(df: DataFrame, cols, **kw) -> DataFrame:
    """M3: forward fill, then backward fill what is still missing (leading gaps)."""
    return _two_way(df, cols, True, **kw)


def bfill_ffill(df: DataFrame, cols, **kw) -> DataFrame:
    """M3 (other order): backward fill, then forward fill trailing gaps."""
    return _two_way(df, cols, False, **kw)


def fill_zero(df: DataFrame, cols=None) -> DataFrame:
    """M4: remaining gaps -> 0."""
    return df.na.fill(0.0, subset=_cols(cols) or None) if cols else df.na.fill(0.0)


def interpolate_linear(df: DataFrame, cols, partition_cols=("series_id",), order_col="ds", mode="chunked",
                       chunk=DEFAULT_CHUNK, pos_col=None) -> DataFrame:
    """M5: linear in row position between the previous and next known values; a leading gap stays NULL,
    a trailing gap carries the last known value (pandas ``interpolate(method='linear')``)."""
    cols = _cols(cols)
    pc = _cols(partition_cols)
    base_cols = df.columns
    if pos_col and pos_col in df.columns:
        pos = pos_col
    elif mode == "plain":
        df, pos = seq_index(df, pc, order_col, out=POS, mode="plain"), POS
    else:
        df, pos, _ = ensure_pos(df, pc, order_col, None)
    known = [F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(c).alias("v"))) for c in cols]
    pn = [f"_prev_{i}" for i in range(len(cols))]
    nn = [f"_next_{i}" for i in range(len(cols))]
    kn = [f"_known_{i}" for i in range(len(cols))]
    df = df.select("*", *[k.alias(n) for k, n in zip(known, kn)])
    specs = [(k, "forward", p, False) for k, p in zip(kn, pn)] + [(k, "backward", n, False) for k, n in zip(kn, nn)]
    df = fill_multi(df, specs, pc, order_col, mode, chunk, pos)
    vals = []
    for c, p, n in zip(cols, pn, nn):
        frac = (F.col(pos) - F.col(f"{p}.p")) / (F.col(f"{n}.p") - F.col(f"{p}.p"))
        v = (F.when(F.col(c).isNotNull(), F.col(c))
             .when(F.col(p).isNull(), F.lit(None))
             .when(F.col(n).isNull(), F.col(f"{p}.v"))
             .otherwise(F.col(f"{p}.v") + (F.col(f"{n}.v") - F.col(f"{p}.v")) * frac))
        vals.append(v.cast("double"))
    return _replace(df, cols, vals, base_cols).select(*base_cols)


def interpolate_quadratic(df: DataFrame, cols, partition_cols=("series_id",), order_col="ds", mode="chunked",
                          chunk=DEFAULT_CHUNK, pos_col=None) -> DataFrame:
    """M6 (re-aimed): a gap value lies on the parabola through the two known points before it and the one
    after it (or one before and two after near the start); with fewer known points it falls back to M5."""
    cols = _cols(cols)
    pc = _cols(partition_cols)
    base_cols = df.columns
    if pos_col and pos_col in df.columns:
        pos = pos_col
    elif mode == "plain":
        df, pos = seq_index(df, pc, order_col, out=POS, mode="plain"), POS
    else:
        df, pos, _ = ensure_pos(df, pc, order_col, None)
    kw = dict(partition_cols=pc, order_col=order_col, mode=mode, chunk=chunk, pos_col=pos)
    kn = [f"_k_{i}" for i in range(len(cols))]
    df = df.select("*", *[F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(c).cast("double").alias("v"))).alias(k)
                         for c, k in zip(cols, kn)])
    # known point before each known point / after each known point
    pk = [f"_pk_{i}" for i in range(len(cols))]
    nk = [f"_nk_{i}" for i in range(len(cols))]
    df = fill_multi(df, [(k, "forward", o, True) for k, o in zip(kn, pk)] + [(k, "backward", o, True) for k, o in zip(kn, nk)],
                    pc, order_col, mode, chunk, pos)
    k2 = [f"_k2_{i}" for i in range(len(cols))]
    df = df.select("*", *[F.when(F.col(k).isNotNull(), F.struct(F.col(k).alias("a"), F.col(p).alias("b"), F.col(n).alias("c"))).alias(t)
                         for k, p, n, t in zip(kn, pk, nk, k2)])
    pv = [f"_pv_{i}" for i in range(len(cols))]
    nv = [f"_nv_{i}" for i in range(len(cols))]
    df = fill_multi(df, [(k, "forward", o, False) for k, o in zip(k2, pv)] + [(k, "backward", o, False) for k, o in zip(k2, nv)],
                    pc, order_col, mode, chunk, pos)
    x = F.col(pos).cast("double")

    def lagrange(p0, p1, p2):
        x0, y0, x1, y1, x2, y2 = (F.col(f"{p0}.p"), F.col(f"{p0}.v"), F.col(f"{p1}.p"), F.col(f"{p1}.v"),
                                  F.col(f"{p2}.p"), F.col(f"{p2}.v"))
        return (y0 * (x - x1) * (x - x2) / ((x0 - x1) * (x0 - x2))
                + y1 * (x - x0) * (x - x2) / ((x1 - x0) * (x1 - x2))
                + y2 * (x - x0) * (x - x1) / ((x2 - x0) * (x2 - x1)))

    vals = []
    for c, a, b in zip(cols, pv, nv):
        prev, prev2 = f"{a}.a", f"{a}.b"
        nxt, nxt2 = f"{b}.a", f"{b}.c"
        linear = F.col(f"{prev}.v") + (F.col(f"{nxt}.v") - F.col(f"{prev}.v")) * (x - F.col(f"{prev}.p")) / (F.col(f"{nxt}.p") - F.col(f"{prev}.p"))
        v = (F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
             .when(F.col(a).isNull(), F.lit(None))
             .when(F.col(b).isNull(), F.col(f"{prev}.v"))
             .when(F.col(prev2).isNotNull(), lagrange(prev2, prev, nxt))
             .when(F.col(nxt2).isNotNull(), lagrange(prev, nxt, nxt2))
             .otherwise(linear))
        vals.append(v)
    return _replace(df, cols, vals, base_cols).select(*base_cols)


def features_between(df: DataFrame, lo, hi, build: Callable[[DataFrame], DataFrame], lookback_hours: int,
                     ts: str = "ds") -> DataFrame:
    """Predicate through a window, done in the API (Catalyst keeps order-key filters above a Window).

    Rows of ``[lo - lookback_hours, hi]`` go into ``build`` (lags / rolling / EMA ...), so the range filter is a
    plain comparison that reaches the scan; afterwards only ``[lo, hi]`` is kept.  Exact when the frame is on a
    regular hourly grid (``regularize`` first) and ``lookback_hours`` covers the largest look-back of ``build``
    (an EMA never forgets: its caller chooses how small a weight may be left out).
    """
    from hourwise.functions import time as tf

    lo_c, hi_c = tf.ts_bound(lo), tf.ts_bound(hi)
    margin = F.timestamp_add("HOUR", F.lit(-int(lookback_hours)), lo_c)
    src = df.filter((F.col(ts) >= margin) & (F.col(ts) <= hi_c))
    return build(src).filter((F.col(ts) >= lo_c) & (F.col(ts) <= hi_c))
