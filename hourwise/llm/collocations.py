"""Phrase collocations by dynamic itemset counting (operator 13).

The documents are dealt to shards that are scanned in a cycle. Words are counted from the first scan on; a longer phrase
becomes active as soon as both of its subphrases (without its last, without its first word) have reached the threshold
in the scans so far, and is counted in that many scans from there as there are shards, so in each shard once: counts of
different lengths come from the same scans, and a count is exact when its cycle ends. Scanning ends when no phrase is
open any more.

Tasks know by a table of fixed size, ``SLOTS`` bytes for each length, after which scan a phrase with a given hash
reached the threshold. Phrases that share a slot become active together, which costs counting but changes no count:
the scan after which a slot is set never changes, so each phrase still has one full cycle.

Inside the scans a phrase is its 64-bit hash (language and words); texts are fetched at the end, for phrases over the
threshold only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.llm.arrays import FOLD, FOLDED_BYTE, U64, lean, mix, pieces, runs, span_hashes
from hourwise.llm.ranking import first_rows
from hourwise.llm.store import handed
from hourwise.session import scratch_path

#: Scans of a cycle.
SHARDS = 3
#: Slots of the table of reached phrases for each length, a byte each: what a broadcast holds at most.
SLOTS = 1 << 24
UNREACHED = 255
#: Words whose phrases are looked at together.
WORDS_AT_ONCE = 1 << 18
PIECE_BYTES = 2 << 20
#: Of this many documents one is searched for the phrases' texts first; the whole table only for what isn't there.
NAME_SAMPLE = 16

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _SEPARATOR.copy()
_BETWEEN[[0x20, 0x09]] = True
_NEXT = U64(0x9E3779B97F4A7C15)


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> U64(64 - slots.bit_length() + 1)).astype(np.int64)


def _language_hashes(names: list[str]) -> np.ndarray:
    data = [x.encode() for x in names]
    end = np.cumsum([len(x) for x in data])
    h = span_hashes(np.frombuffer(b"".join(data), np.uint8), end - [len(x) for x in data], end) if data else np.zeros(0, U64)
    return mix(h + _NEXT)  # a word may read like a language's name


def _word_chunks(batch: pa.RecordBatch, longest: int):
    """(language number, hash, segment, start and end byte, bytes, words that begin phrases) of runs of words of a batch
    (lang, text), and its languages. A chunk also holds the ``longest`` - 1 words after those that begin phrases; a
    phrase lies inside one segment."""
    kinds = batch.column(0).dictionary_encode()
    code, names = kinds.indices.to_numpy(zero_copy_only=False), kinds.dictionary.to_pylist()
    own = _language_hashes(names)

    def chunks():
        for p in pieces(batch.column(1), PIECE_BYTES):
            w = runs(_BETWEEN[p.buf], p.off)
            row = w.row
            cut = np.searchsorted(np.flatnonzero(_SEPARATOR[p.buf]), w.start)
            segment = np.cumsum((np.diff(cut, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
            for lo in range(0, len(row), WORDS_AT_ONCE):
                hi = min(len(row), lo + WORDS_AT_ONCE)
                at = slice(lo, min(len(row), hi + longest - 1))
                start, end = w.start[at], w.end[at]
                base, lang = int(start[0]), code[p.lo + row[at]]
                buf = p.buf[base: int(end[-1])]
                h = mix(span_hashes(buf, start - base, end - base, FOLDED_BYTE) ^ own[lang])
                yield lang, h, segment[at], start - base, end - base, buf, hi - lo

    return names, own, chunks()


def _phrases(h: np.ndarray, segment: np.ndarray, begins: int, longest: int):
    """(length, hash of the phrase from each word, whether it is one, the hashes of the length before) by length."""
    yield 1, h[:begins], np.ones(begins, dtype=bool), None
    before = h
    for k in range(2, longest + 1):
        n = len(h) - k + 1
        if n <= 0:
            return
        now = mix(before[:n] * _NEXT + h[k - 1:] + U64(k))
        yield k, now[:begins], (segment[:n] == segment[k - 1:])[:begins], before
        before = now


def _counted(batch: pa.RecordBatch, reach: dict[int, np.ndarray], step: int, shards: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Counts (length, first scan, hash, occurrences) of the phrases of a batch that are active in scan ``step``;
    length 0 stands for all words of a language."""
    names, own, chunks = _word_chunks(batch, longest)
    words = np.zeros(len(names), dtype=np.int64)
    row = lambda k, since, h, c: pa.RecordBatch.from_arrays([
        pa.array(np.full(len(h), k, np.int8)), pa.array(since.astype(np.int16)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["k", "since", "h", "c"])
    for lang, h, segment, _, _, _, begins in chunks:
        words += np.bincount(lang[:begins], minlength=len(names))
        for k, now, whole, before in _phrases(h, segment, begins, longest):
            if k == 1:
                if step >= shards:
                    continue
                since = np.zeros(len(now), dtype=np.uint8)
            else:
                done = reach[k - 1][_slot(before[:len(now) + 1], len(reach[k - 1]))]
                since = np.maximum(done[:-1], done[1:])[:len(now)]
                whole = whole & (since <= step) & (since.astype(np.int16) + shards > step)
            found, first, count = np.unique(now[whole], return_index=True, return_counts=True)
            if len(found):
                yield row(k, since[whole][first], found, count)
    if step < shards and words.any():
        yield row(0, np.zeros(len(words)), own, words)


def _texts_of(batch: pa.RecordBatch, wanted: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """(length, hash, language, phrase) of the batch's phrases whose slot is ``wanted``, once for each chunk."""
    names, own, chunks = _word_chunks(batch, longest)
    yield pa.RecordBatch.from_pydict({"k": pa.array([0] * len(names), pa.int8()), "h": pa.array(own.view(np.int64)), "lang": pa.array(names, pa.string()), "phrase": pa.array([""] * len(names), pa.string())})
    for lang, h, segment, start, end, buf, begins in chunks:
        low = FOLD[buf].tobytes()
        for k, now, whole, _ in _phrases(h, segment, begins, longest):
            whole = np.flatnonzero(whole & wanted[_slot(now, len(wanted))])
            found, first = np.unique(now[whole], return_index=True)
            at = whole[first]
            text = [b" ".join(low[a:b].split()) for a, b in zip(start[at].tolist(), end[at + k - 1].tolist(), strict=True)]
            if text:
                yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(at), k, np.int8)), "h": pa.array(found.view(np.int64)), "lang": pa.array([names[x] for x in lang[at]], pa.string()), "phrase": pa.array(text, pa.binary()).cast(pa.string())})


def _slots_of(found: DataFrame, slots: int) -> np.ndarray:
    """Distinct slots of column h: ``slots`` numbers at most."""
    bits = slots.bit_length() - 1
    return found.select(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("slot")).distinct().toArrow().column("slot").to_numpy()


class PhraseCounts:
    """Phrases of 1 to ``longest`` words with at least ``least`` occurrences: ``table`` (k, h, f), and under k = 0 the
    words of each language. ``docs`` has columns lang and text, and is read once for each scan of its shard.

    ``steps`` tells what each scan did: (scan, shard, phrases that reached the threshold by length)."""

    def __init__(self, docs: DataFrame, least: int, longest: int, shards: int = SHARDS, slots: int = SLOTS):
        spark = docs.sparkSession
        if not 1 <= shards <= 254 // longest:
            raise ValueError("too many shards for one byte")
        path = scratch_path(spark, "phrase-shards")
        # consecutive rows go to different shards, so equal documents don't share one
        docs.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")).write.partitionBy("shard").option("compression", "zstd").parquet(path)
        self.docs = spark.read.schema("lang string, text string, shard int").parquet(path)
        self.longest, self.slots, self.steps = longest, slots, []
        reach = {k: np.full(slots, UNREACHED, dtype=np.uint8) for k in range(1, longest)}
        running, parts, last, step = None, [], shards - 1, 0
        while step <= last:
            running, sent = self._scan(running, reach, step, shards)
            ended = F.col("since") == step - shards + 1
            parts.append(running.filter(ended & ((F.col("c") >= least) | (F.col("k") == 0))).select("k", "h", F.col("c").alias("f")))
            crossed = running.filter((F.col("c") >= least) & (F.col("c") - F.col("fresh") < least))
            news = {}
            for k in reach:
                at = _slots_of(crossed.filter(F.col("k") == k), slots)
                news[k] = len(at)
                at = at[reach[k][at] == UNREACHED]
                reach[k][at] = step + 1
            self.steps.append((step, step % shards, news))
            if any(news.values()):
                last = max(last, step + shards)
            running = running.filter(~ended & (F.col("k") <= longest)).select("k", "since", "h", "c", F.lit(0).cast("long").alias("fresh"))
            sent.destroy()
            step += 1
        table = parts[0]
        for p in parts[1:]:
            table = table.unionByName(p)
        self.table = handed(table, "phrase-counts")

    def _scan(self, running, reach, step, shards):
        longest = self.longest
        sent = self.docs.sparkSession.sparkContext.broadcast({k: zlib.compress(v, 1) for k, v in reach.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {k: np.frombuffer(zlib.decompress(v), np.uint8) for k, v in sent.value.items()}
            for b in batches:
                yield from _counted(b, known, step, shards, longest)

        shard = self.docs.filter(F.col("shard") == step % shards).select("lang", "text")
        now = shard.mapInArrow(lean(run), "k byte, since short, h long, c long").withColumn("fresh", F.col("c"))
        both = now if running is None else running.unionByName(now)
        return handed(both.groupBy("k", "since", "h").agg(F.sum("c").alias("c"), F.sum("fresh").alias("fresh")), f"phrases-{step}"), sent

    def named(self) -> DataFrame:
        """(k, lang, phrase, f): the table with texts; phrase is empty for k = 0."""
        one = F.pmod(F.xxhash64("text"), F.lit(NAME_SAMPLE)) == 0
        some = handed(self._texts(self.docs.filter(one), self.table), "phrase-texts")
        rest = handed(self.table.join(some, ["k", "h"], "left_anti"), "phrase-unnamed")
        names = some.unionByName(self._texts(self.docs.filter(~one), rest)) if rest.limit(1).count() else some
        return handed(self.table.join(names, ["k", "h"]).select("k", "lang", "phrase", "f"), "phrases-named")

    def _texts(self, docs: DataFrame, wanted: DataFrame) -> DataFrame:
        slots, longest = self.slots, self.longest
        bits = np.zeros(slots, dtype=bool)
        bits[_slots_of(wanted, slots)] = True
        sent = docs.sparkSession.sparkContext.broadcast(zlib.compress(np.packbits(bits), 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = np.unpackbits(np.frombuffer(zlib.decompress(sent.value), np.uint8)).astype(bool)
            for b in batches:
                yield from _texts_of(b, at, longest)

        found = docs.select("lang", "text").mapInArrow(lean(run), "k byte, h long, lang string, phrase string")
        return found.join(wanted.select("k", "h"), ["k", "h"], "left_semi").groupBy("k", "h").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, covered: int = 50,
                 lang_col: str = "lang", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The ``top`` best phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs. A
    phrase with a >= ``least`` occurrences is cut into two parts with l and r occurrences where floor(1000000 a a / (l r))
    is lowest (ties: after the fewest words); phrases inside a longer one with at least ``covered`` percent of their
    occurrences are left out. Order: score and a descending, phrase by its bytes.

    A NULL language is ``und``; NULL and empty texts hold nothing; texts are taken whole, however long; repeated rows
    count each; other columns are ignored; an empty table gives an empty result.
    """
    src = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    named = PhraseCounts(src, least, longest, shards, slots).named()
    known = named.filter("k > 0").select("lang", "phrase", "f")
    totals = named.filter("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    words = F.split("phrase", " ")
    size = F.size("words")
    found = named.filter("k > 1").select("lang", "phrase", F.col("f").alias("a"), words.alias("words"))
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("words", F.col("k") + 1, size - F.col("k")), " ").alias("tail"))
    side = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cut = cut.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    score = F.expr("cast((cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as bigint)")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = found.filter(size > 2).select("lang", "a", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    best = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))
    scored = handed(best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")), "collocations")
    ranked = first_rows(scored, "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], top, ["phrase"], scored.count())
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
