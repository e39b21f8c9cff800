"""Repeated lines dropped by probing a sharded minimal perfect hash (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.llm.arrays import U64, lean, mix
from hourwise.llm.store import handed

BLANKS = " \t\n\x0b\x0c\r"
#: Lines of one shard at most on average; a shard's arrays are built in one task.
SHARD_KEYS = 1 << 17
#: Bytes of arrays that are broadcast at once; more shards are probed in further rounds.
ROUND_BYTES = 64 << 20
#: Bytes of arrays for each key: 8 fingerprint, 4 count, 8 last document, and about 1 of hash levels.
KEY_BYTES = 21
#: Stands for a NULL document id.
ABSENT = -(1 << 63)


def line_key(line: str) -> str:
    """The line with ASCII white space stripped at both ends and A-Z in lower case."""
    return line.strip(BLANKS).encode().lower().decode()


def _hashes(text: str, least: int) -> tuple[list[int], list[int], list[int]]:
    """(line number, slot hash, fingerprint) of the lines whose key has ``least`` code points or more."""
    at, slot, mark = [], [], []
    for i, line in enumerate(text.split("\n")):
        if len(line) >= least and len(key := line.strip(BLANKS)) >= least:
            h = xxhash.xxh3_128_intdigest(key.encode().lower())
            at.append(i)
            slot.append(h & 0xFFFFFFFFFFFFFFFF)
            mark.append(h >> 64)
    return at, slot, mark


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=U64).view(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits, each holding the keys that met no other key
    in it; a key's place is the number of bits set before its own."""

    SPARE = 2  # bits of a level for each key that it is offered
    MAX_LEVELS = 64

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(base + np.cumsum(ones) - ones)
            base += int(ones.sum())
        self.size = base

    @staticmethod
    def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(keys ^ mix(np.array([level + 1], dtype=U64))) % U64(bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        levels, left = [], keys
        while len(left):
            if len(levels) == cls.MAX_LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            n = -(-cls.SPARE * len(left) // 64) * 64
            slot = cls._slot(left, len(levels), n)
            alone = np.bincount(slot, minlength=n) == 1
            levels.append(np.packbits(alone.reshape(-1, 8), axis=1, bitorder="little").ravel().view(U64))
            left = left[~alone[slot]]
        return cls(levels)

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; a key that wasn't in the set gets the place of another one, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            slot = self._slot(keys[open_], level, 64 * len(bits))
            word, bit = bits[slot >> 6], (slot & 63).astype(U64)
            hit = (word >> bit) & U64(1) != 0
            below = np.bitwise_count(word & ((U64(1) << bit) - U64(1)))
            out[open_[hit]] = (ranks[slot >> 6] + below)[hit]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(x) for x in self.levels], dtype=np.int64).tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, n_levels: int, data: bytes) -> "PerfectHash":
        sizes = np.frombuffer(data, np.int64, n_levels)
        words = np.frombuffer(data, U64, offset=8 * n_levels)
        return cls(np.split(words, np.cumsum(sizes)[:-1]) if n_levels else [])


class Shard:
    """A perfect hash with the arrays that it indexes: fingerprints, document counts, last documents."""

    def __init__(self, row):
        self.hash = PerfectHash.from_bytes(row["n_levels"], row["levels"])
        self.mark = np.frombuffer(row["marks"], U64)
        self.count = np.frombuffer(row["counts"], np.int32)
        self.last = np.frombuffer(row["lasts"], np.int64)

    def probe(self, slot: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, last document) of each line; 0 documents where the line isn't in the shard."""
        at = self.hash.place(slot)
        found = at >= 0
        found[found] = self.mark[at[found]] == mark[found]
        at = np.where(found, at, 0)
        return np.where(found, self.count[at], 0), np.where(found, self.last[at], 0)


SHARD_SCHEMA = "shard int, n_keys long, n_levels int, levels binary, marks binary, counts binary, lasts binary"


def _build(group: pd.DataFrame) -> pd.DataFrame:
    slot = group["slot"].to_numpy().view(U64)
    order = np.argsort(slot, kind="stable")
    # two keys with one slot hash (about never): the later goes to a shard row of its own
    first = np.ones(len(slot), dtype=bool)
    first[order[1:]] = slot[order[1:]] != slot[order[:-1]]
    out = []
    for part in (first, ~first):
        if not part.any():
            continue
        h, at = PerfectHash.build(slot[part]), slice(None)
        at = h.place(slot[part])
        marks, counts, lasts = np.zeros(h.size, U64), np.zeros(h.size, np.int32), np.zeros(h.size, np.int64)
        marks[at] = group["mark"].to_numpy().view(U64)[part]
        counts[at] = np.minimum(group["n_docs"].to_numpy()[part], np.iinfo(np.int32).max)
        lasts[at] = group["last_doc"].to_numpy()[part]
        out.append((int(group["shard"].iloc[0]), h.size, len(h.levels), h.to_bytes(), marks.tobytes(), counts.tobytes(), lasts.tobytes()))
    return pd.DataFrame(out, columns=["shard", "n_keys", "n_levels", "levels", "marks", "counts", "lasts"])


def line_counts(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(slot, mark, n_docs, last_doc) of every distinct line key of ``least`` code points or more."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, docs_, slots, marks = b.column(0).to_pylist(), [], [], []
            for doc, text in zip(ids, b.column(1).to_pylist(), strict=True):
                if not text or len(text) < least:
                    continue
                _, slot, mark = _hashes(text, least)
                once = dict.fromkeys(zip(slot, mark, strict=True))
                docs_ += [doc] * len(once)
                slots += [x[0] for x in once]
                marks += [x[1] for x in once]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(slots)), pa.array(_signed(marks)), pa.array(docs_, pa.int64())], names=["slot", "mark", "doc"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(ABSENT)), F.col(text_col)).mapInArrow(lean(keys), "slot long, mark long, doc long")
    return rows.groupBy("slot", "mark").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))


def line_index(docs: DataFrame, min_chars: int, min_docs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards (``SHARD_SCHEMA``) over the line keys of at least ``min_docs`` documents, written to the shared folder.

    Keys that occur in fewer documents can't drop a line, so they are counted but not indexed. A shard is one
    task's work and has ``SHARD_KEYS`` keys on average, at any size of the corpus."""
    frequent = handed(line_counts(docs, min_chars, id_col, text_col).filter(F.col("n_docs") >= min_docs), "line-counts")
    shards = max(1, -(-frequent.count() // SHARD_KEYS))
    rows = frequent.withColumn("shard", F.pmod(F.col("slot"), F.lit(shards)).cast("int"))
    return handed(rows.groupBy("shard").applyInPandas(_build, SHARD_SCHEMA), "line-shards")


def probe_lines(docs: DataFrame, index: DataFrame, min_chars: int, min_docs: int, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that ``index`` marks, plus n_lines (before) and n_dropped.

    The arrays go out in broadcasts of at most ``ROUND_BYTES``; a larger index is probed in several rounds over the
    same rows, each adding its dropped line numbers, so no task ever holds more than one round's arrays.
    """
    spark = docs.sparkSession
    n_shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    step = max(1, ROUND_BYTES // (SHARD_KEYS * KEY_BYTES))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text_at, id_at = own.index(text_col), own.index(id_col)
    rounds = list(range(0, n_shards, step))
    src = docs.select(*(F.col(f"`{c}`") for c in own), F.array().cast("array<int>").alias("n_dropped"))

    def one_round(df: DataFrame, at: int, last: bool) -> DataFrame:
        rows = index.filter(F.col("shard").between(at, at + step - 1)).collect()
        sent = spark.sparkContext.broadcast([r.asDict() for r in rows])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards: dict[int, list[Shard]] = {}
            for r in sent.value:
                shards.setdefault(r["shard"], []).append(Shard(r))
            for b in batches:
                texts = b.column(text_at).to_pylist()
                ids = np.array([ABSENT if x is None else x for x in b.column(id_at).to_pylist()], dtype=np.int64)
                rows_, lines, slots, marks = [], [], [], []
                for r, text in enumerate(texts):
                    if text and len(text) >= min_chars:
                        at_, slot, mark = _hashes(text, min_chars)
                        rows_ += [r] * len(at_)
                        lines += at_
                        slots += slot
                        marks += mark
                slot, mark, row = np.array(slots, dtype=U64), np.array(marks, dtype=U64), np.array(rows_, dtype=np.int64)
                which = np.mod(slot.view(np.int64), n_shards)
                drop = [set(x) for x in b.column(len(own)).to_pylist()]
                hit = np.zeros(len(slot), dtype=bool)
                for k in np.unique(which):
                    at_ = np.flatnonzero(which == k)
                    for shard in shards.get(int(k), ()):
                        n, newest = shard.probe(slot[at_], mark[at_])
                        hit[at_] |= (n >= min_docs) & (newest != ids[row[at_]])
                for i in np.flatnonzero(hit):
                    drop[row[i]].add(lines[i])
                columns = [b.column(i) for i in range(len(own))]
                if not last:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([sorted(x) for x in drop], pa.list_(pa.int32()))], names=[*own, "n_dropped"])
                    continue
                n_lines = [(t or "").count("\n") + 1 for t in texts]
                columns[text_at] = pa.array(["\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) if gone else t or ""
                                             for t, gone in zip(texts, drop, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array([len(x) for x in drop], pa.int64())],
                                                 names=[*own, "n_lines", "n_dropped"])

        schema = ", ".join(f"`{c}` {'string' if c == text_col else docs.schema[c].dataType.simpleString()}" for c in own)
        return df.mapInArrow(lean(run), schema + (", n_lines long, n_dropped long" if last else ", n_dropped array<int>"))

    for at in rounds:
        src = one_round(src, at, at == rounds[-1])
    return src


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """``docs`` with each repeated line kept only in the largest ``id_col`` that holds it; adds n_lines, n_dropped.

    A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased. Lines whose key has
    ``min_chars`` code points or more and stands in ``min_docs`` rows or more are dropped elsewhere. NULL and empty
    texts are one empty line and come back as the empty text; a NULL id is smaller than every other; rows that
    repeat the largest id all keep the line; columns named n_lines or n_dropped are replaced, all others stay.
    """
    index = line_index(docs, min_chars, min_docs, id_col, text_col)
    return probe_lines(docs, index, min_chars, min_docs, id_col, text_col)
