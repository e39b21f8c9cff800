"""Stable keys dealt to shards by jump consistent hashing (operator 11, native: DataFrame functions only).

A key's 64-bit state runs through the multiplier of the published algorithm; each state gives the next shard count at
which the key would move, until that count lies beyond the shards there are. No ring and no table is kept: the key and
the number of shards decide, and the same run tells at which shard count the key moves next. Going from n to n + 1
shards takes 1 / (n + 1) of the keys, all of them into the new shard.

Products modulo 2^64 are made of 16- and 32-bit limbs, as Spark's long arithmetic raises an error on overflow.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwise.llm.store import handed

#: The algorithm's multiplier, in halves of 32 bits.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_M16, _M32 = 0xFFFF, 0xFFFFFFFF
#: Rows of a shard that are numbered together, about.
BUCKET_ROWS = 1024
#: Equal rows that are written out together.
RUN_ROWS = 1 << 16
#: Bytes that count for each row besides its text.
ROW_BYTES = 16


def key_bits(df: DataFrame, key_col: str) -> Column:
    """The key as a long: integers as they are, other kinds by xxhash64, NULL as 0."""
    key = F.col(f"`{key_col}`")
    whole = df.select(key).schema[0].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.when(key.isNull(), F.lit(0).cast("long")).otherwise(key.cast("long") if whole else F.xxhash64(key))


def _next(acc: Column) -> Column:
    """The state after one more jump."""
    high, low = acc["high"], acc["low"]
    l0, l1 = low.bitwiseAND(F.lit(_M16)), F.shiftright(low, 16)
    h0, h1 = high.bitwiseAND(F.lit(_M16)), F.shiftright(high, 16)
    upper = lambda x: F.shiftleft(x.bitwiseAND(F.lit(_M16)), 16)
    rest = l0 * F.lit(_LOW) + F.lit(1) + upper(l1 * F.lit(_LOW))
    carry = F.shiftright(rest, 32) + F.shiftright(l1 * F.lit(_LOW), 16)
    top = (carry + l0 * F.lit(_HIGH) + upper(l1 * F.lit(_HIGH)) + h0 * F.lit(_LOW) + upper(h1 * F.lit(_LOW))).bitwiseAND(F.lit(_M32))
    return F.struct(top.alias("high"), rest.bitwiseAND(F.lit(_M32)).alias("low"), acc["jump"].alias("shard"), acc["jump"].alias("jump"))


def _landed(acc: Column) -> Column:
    """The state with the count at which its key moves next, from the upper 31 bits."""
    far = F.floor((acc["shard"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(acc["high"], 1) + F.lit(1)).cast("double")))
    return F.struct(acc["high"].alias("high"), acc["low"].alias("low"), acc["shard"].alias("shard"), far.alias("jump"))


def jump(bits: Column, shards: int) -> Column:
    """struct(shard long, jump long): the shard of a 64-bit key among ``shards``, and the shard count beyond which it
    moves (to shard number ``jump``)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    n = F.lit(shards).cast("long")
    start = F.struct(F.shiftrightunsigned(bits, 32).alias("high"), bits.bitwiseAND(F.lit(_M32)).alias("low"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("jump"))
    step = lambda acc, _: F.when(acc["jump"] < n, _landed(_next(acc))).otherwise(acc)
    # a key jumps about ln(n) times, and n times at most: the few keys that jump more often go on to the end
    usual = min(shards, 12 + 2 * ceil(log(shards + 1)))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(usual)), start, step)
    if usual < shards:
        state = F.transform(F.array(state), lambda s: F.when(s["jump"] < n, F.aggregate(F.sequence(F.lit(usual), F.lit(shards)), s, step)).otherwise(s))[0]
    return state


def assign_shards(docs: DataFrame, shards: int, key_col: str = "doc_id", shard_col: str = "shard", moves_col: str = "moves_at") -> DataFrame:
    """``docs`` with ``shard_col`` (int, from 0) and ``moves_col`` (long): with up to ``moves_at`` shards the row stays,
    with ``moves_at`` + 1 it lies in shard number ``moves_at``. A narrow step: no row is moved for it.

    Rows with equal keys share a shard; a NULL key is dealt as 0; columns that have the two names already are replaced;
    an empty table gives an empty one.
    """
    at = "_jump_state"
    keyed = docs.withColumn(at, jump(key_bits(docs, key_col), shards))
    return keyed.withColumns({shard_col: F.col(f"{at}.shard").cast("int"), moves_col: F.col(f"{at}.jump")}).drop(at)


def write_shards(docs: DataFrame, path: str, shards: int, key_col: str = "doc_id", tasks_a_shard: int = 1) -> None:
    """The rows as Parquet folders ``path/shard=N``. Rows are dealt to tasks by shard and, for ``tasks_a_shard`` above
    1, by a hash of all their columns, so that one hot key doesn't make one file; other columns stay as they are."""
    spread = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)), F.lit(tasks_a_shard))
    assigned = assign_shards(docs, shards, key_col).drop("moves_at")
    assigned.repartition(shards * tasks_a_shard, F.col("shard"), spread).write.partitionBy("shard").parquet(path)


def shard_slots(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size (UTF-8 bytes of the text plus 16), text_crc32, shard, moves_at, and slot,
    the row's number in its shard, from 0 without gaps.

    Slots follow (crc32 of "id:text_crc32", id, text_crc32, size), so the rows alone decide and reruns agree. Shards are
    numbered in buckets of that crc32 whose number grows with the rows; equal rows, however many, are one counted row
    until the end, and texts aren't shuffled. A NULL text has size 16 and crc32 0, a NULL id comes first among equals;
    rows that agree in all of it are numbered one after the other; other columns are ignored; an empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = read.groupBy("id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    place = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("text_crc32")).cast("binary"))
    rows = handed(assign_shards(rows, shards, "id").withColumn("place", place), "shard-rows")
    buckets = max(1, rows.count() // (shards * BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.shiftright(F.col("place") * F.lit(buckets), 32))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("m"))
    first = counts.select("shard", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("place", "id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(first, ["shard", "bucket"])
    numbered = handed(numbered.select("id", "size", "text_crc32", "shard", "moves_at", (F.col("first") + F.col("inside")).alias("slot"), "n"), "shard-slots")
    run = F.lit(RUN_ROWS)
    runs = numbered.filter(F.col("n") > run).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / run))))
    runs = runs.select("id", "size", "text_crc32", "shard", "moves_at", (F.col("slot") + F.col("k") * run).alias("slot"), F.least(run, F.col("n") - F.col("k") * run).alias("n"))
    runs = runs.repartition(F.col("slot"), F.col("shard"))  # a hot row's runs go to all tasks
    every = numbered.filter(F.col("n") <= run).unionByName(runs)
    every = every.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return every.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "moves_at", (F.col("slot") + F.col("i")).alias("slot"))
