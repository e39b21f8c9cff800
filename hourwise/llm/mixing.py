"""Mixing sources to target weights by blocks, shards and index permutations (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwise.llm.arrays import U64, lean, mix
from hourwise.llm.store import handed

#: Words of a block, slots of an output shard on average, rows of a bucket of documents on average.
BLOCK, SHARD_SLOTS, BUCKET_ROWS = 128, 4096, 4096
#: Shards that one draw deals to; more are dealt in two steps.
DEAL = 2048
MOST = 3
SOURCES_BROADCAST = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) for rows of (source, size).

    Sources in code point order, NULL last, weigh 1, 2, 3, repeating. Targets share the total size by weight, none
    above ``MOST`` times its source's size: with the sources ordered by that bound over their weight, the level (target
    by weight) is the largest of the levels that result if the sources before each one take their bounds."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = by.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    bound = F.col("source_size") * MOST
    order = Window.orderBy(bound / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(bound).over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return (named.withColumn("_level", level)
            .withColumn("target", F.least(bound.cast("double"), F.max("_level").over(everything) * F.col("weight")))
            .select("source", "source_size", "target"))


#: Slots that a task fills, about.
FILL_SLOTS = 1 << 16


def _permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 applied to ``index``: Feistel rounds on the next even number of bits,
    walked on until the value is below ``size``."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = U64((1 << half) - 1)
    out, todo = index.astype(U64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> U64(half), out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mix(right + U64((key + r * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) & mask)
        out[todo] = (left << U64(half)) | right
        todo = todo[out[todo] >= U64(size)]
    return out.astype(np.int64)


def _parts(n: int, quota: int, key: int, salt: int) -> np.ndarray:
    """Multinomial counts of ``quota`` slots over ``n`` equal parts, from a seed of their own."""
    return np.random.default_rng([key & 0xFFFFFFFF, (key >> 32) & 0xFFFFFFFF, salt]).multinomial(quota, np.full(n, 1 / n))


def slots(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 8) -> DataFrame:
    """(source_key, shard, slot, block, epoch): which block fills each slot of each output shard.

    ``sources`` has source_key, source_size, target. A source's slots (target over the mean words of its blocks) are
    drawn multinomially over the shards, so a shard's source counts vary as in a random draw while each source's total
    stays; rank r among a source's slots takes block permutation(r mod blocks), so blocks are reused evenly and none
    more than ``MOST`` times.
    """
    quotas = sources.filter("source_size > 0").select(
        "source_key", F.ceil(F.col("source_size") / block).alias("blocks"),
        F.round(F.col("target") * F.ceil(F.col("source_size") / block) / F.col("source_size")).cast("long").alias("quota"))
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-total // shard_slots))
    groups = -(-shards // DEAL)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, blocks, quota in pdf.itertuples(index=False):
                n = _parts(groups, quota, key ^ seed, 0)
                yield pd.DataFrame({"source_key": key, "blocks": blocks, "part": np.arange(groups), "n": n, "rank": np.cumsum(n) - n})

    def deal_group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, blocks, part, n, rank in pdf.itertuples(index=False):
                own = min(DEAL, shards - part * DEAL)
                k = _parts(own, n, key ^ seed, part + 1)
                out = pd.DataFrame({"source_key": key, "blocks": blocks, "part": part * DEAL + np.arange(own), "n": k, "rank": rank + np.cumsum(k) - k})
                yield out[out["n"] > 0]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, blocks, shard, n, rank in pdf.itertuples(index=False):
                for lo in range(0, n, 1 << 16):
                    r = rank + np.arange(lo, min(n, lo + (1 << 16)))
                    yield pd.DataFrame({"source_key": key, "shard": shard, "slot": r - rank, "block": _permuted(r % blocks, blocks, (key ^ seed) & 0xFFFFFFFFFFFFFFFF), "epoch": r // blocks})

    parts = "source_key long, blocks long, part long, n long, rank long"
    dealt = quotas.mapInPandas(lean(deal), parts).repartition("source_key", "part").mapInPandas(lean(deal_group), parts)
    # a few rows become many slots, so their number, not their bytes, decides the number of tasks
    tasks = max(1, -(-total // FILL_SLOTS))
    return dealt.repartition(tasks, "source_key", "part").mapInPandas(lean(fill), "source_key long, shard long, slot long, block long, epoch long")


def _positions(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``_off``: the words before each document in its source's stream (documents in hash order).

    Sums by (source, bucket of the hash) are added up first, so even a source with a third of all rows is a sort of
    buckets of about ``BUCKET_ROWS`` rows."""
    buckets = max(1, sizes.count() // BUCKET_ROWS)
    rows = sizes.withColumn("_h", F.xxhash64(F.lit(8), "doc_id", "size"))
    rows = rows.withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    upto = Window.partitionBy("source_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("source_key", "_b").agg(F.sum("size").alias("_s")).select(
        "source_key", "_b", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source_key", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(base, ["source_key", "_b"]).withColumn("_off", F.col("_base") + F.col("_in")).drop("_h", "_b", "_base", "_in")


def mix_sources(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 8, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of all sources at their target weights: (documents, pieces, slots).

    documents: one row per row of ``docs``: doc_id, source, size (words), source_size, target, taken (words that the
    mix takes, repeats counted). pieces: (source_key, block, doc_id, word_start, word_end), the words of each block.
    slots: which block fills each slot of each output shard (see ``slots``). A source's stream of words is cut into
    blocks of ``block`` words; blocks and slots meet by (source, block index). Everything is drawn from ``seed`` and
    the rows' values, so reruns agree, whatever the partitions.

    NULL texts have size 0 and are never taken; a NULL source is a source of its own, the last; repeated rows are
    mixed each; an empty table gives empty results; other columns are ignored.
    """
    sizes = handed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    key = F.xxhash64(F.lit(seed), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    targets = handed(source_targets(sizes).withColumn("source_key", key), "mix-targets")
    placed = handed(_positions(sizes.withColumn("source_key", key)), "mix-positions")
    filled = slots(targets, block, shard_slots, seed)
    last = F.floor((F.col("_off") + F.col("size") - 1) / block)
    spread = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("_off") / block), last)))
    start, end = F.greatest(F.col("_off"), F.col("block") * block), F.least(F.col("_off") + F.col("size"), (F.col("block") + 1) * block)
    piece = spread.select("source_key", "block", "doc_id", "_off", (start - F.col("_off")).alias("word_start"), (end - F.col("_off")).alias("word_end"))
    uses = filled.groupBy("source_key", "block").agg(F.count(F.lit(1)).alias("_uses"))
    # both sides grow with the corpus: the planner, which can't know how many slots are filled, must not broadcast one
    taken = piece.join(uses.hint("merge"), ["source_key", "block"]).groupBy("source_key", "_off").agg(
        F.sum((F.col("word_end") - F.col("word_start")) * F.col("_uses")).alias("taken"))
    # a row with words is alone at its offset; rows without words take nothing
    rows = placed.withColumn("_at", F.when(F.col("size") > 0, F.col("_off"))).join(
        taken.withColumnRenamed("_off", "_at").hint("merge"), ["source_key", "_at"], "left")
    about = targets.select("source_key", "source_size", "target")
    about = F.broadcast(about) if about.count() <= SOURCES_BROADCAST else about
    documents = rows.join(about, "source_key").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return documents, piece.drop("_off"), filled
