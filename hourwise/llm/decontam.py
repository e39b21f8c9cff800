"""Benchmark decontamination by SimHash of item-sized windows (operator 2).

Every window of a document that is as long as some benchmark item is a candidate copy of an item of that length.
A window can only reach the similarity if enough of its shingles occur in the benchmark at all; running counts of
these drop all others before anything else is computed, without loss. The windows left get a 128-bit SimHash, each
occurrence of a shingle counting once. Two fingerprints within ``RADIUS`` differ by at most ``BLOCK_BITS_OFF`` bits
in one of eight 16-bit blocks at least, so comparing blocks, one index column at a time, finds all pairs within the
radius; these are verified by the exact weighted Jaccard similarity of the two shingle multisets.

At a similarity of 0.75 fingerprints of windows without a repeated shingle differ by 22 bits on average (standard
deviation 4.3), so the radius lies four deviations above, and a passage is met by several windows. A window that repeats
a shingle is verified without its fingerprint, if the occurrences that an item can share are enough. Blocks are compared
with all items of the window's size (a few each), not looked up in tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hourwise.llm.arrays import FOLDED_BYTE, U64, lean, mix, pieces, span_hashes, windows, words

GRAM = 5
#: Weighted Jaccard similarity from which on a window is a copy of an item.
SIMILARITY = 0.75
BLOCKS, BLOCK_BITS_OFF = 8, 4
#: All pairs within this distance agree in some block up to BLOCK_BITS_OFF bits.
RADIUS = BLOCKS * (BLOCK_BITS_OFF + 1) - 1
#: Benchmark words that are held (broadcast) at once; a longer benchmark is searched in several parts.
PART_WORDS = 1_000_000
#: Windows that are fingerprinted at once.
STRIP = 20_000


def _shingles(p) -> tuple[np.ndarray, np.ndarray]:
    w = words(p)
    return windows(span_hashes(p.buf, w.start, w.end, FOLDED_BYTE), w.first, GRAM, whole=False)


def _bit_sums(h: np.ndarray) -> np.ndarray:
    """Running sums of the 128 signs of each shingle."""
    both = np.column_stack([h, mix(h + U64(0x9E3779B97F4A7C15))]).view(np.uint8)
    total = np.zeros((len(h) + 1, 128), dtype=np.int32)
    np.cumsum(np.unpackbits(both, axis=1).astype(np.int8) * 2 - 1, axis=0, out=total[1:])
    return total


def _fingerprints(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Eight 16-bit blocks of the SimHash of each window."""
    return np.packbits(total[end] - total[start] > 0, axis=1).view(np.uint16)


def near_fingerprints(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (of rows of a, of b) within ``RADIUS``: those close in some block, then by their whole distance."""
    close = np.zeros((len(a), len(b)), dtype=bool)
    for k in range(BLOCKS):
        close |= np.bitwise_count(a[:, k, None] ^ b[None, :, k]) <= BLOCK_BITS_OFF
    x, y = np.nonzero(close)
    near = np.bitwise_count(a[x] ^ b[y]).sum(1) <= RADIUS
    return x[near], y[near]


class Items:
    """Shingles and fingerprints of benchmark items, by their number of shingles."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.by_size, all_ = ids, {}, []
        for p in pieces(pa.array(texts, pa.large_string())):
            h, first = _shingles(p)
            all_.append(h)
            total = _bit_sums(h)
            for r in np.flatnonzero(np.diff(first)):
                own = h[first[r]: first[r + 1]]
                self.by_size.setdefault(len(own), []).append((p.lo + int(r), np.unique(own, return_counts=True), _fingerprints(total, first[r: r + 1], first[r + 1: r + 2])[0]))
        self.known = np.unique(np.concatenate(all_)) if all_ else np.zeros(0, U64)
        # the most often that an item holds each shingle
        self.most = np.zeros(len(self.known), dtype=np.int64)
        for group in self.by_size.values():
            for _, (own, n), _ in group:
                at = np.searchsorted(self.known, own)
                self.most[at] = np.maximum(self.most[at], n)
        bits = max(16, int(32 * max(1, len(self.known)) - 1).bit_length())
        self.mask = U64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, dtype=bool)
        self.maybe[(self.known & self.mask).astype(np.int64)] = True
        self.blocks = {s: np.array([x[2] for x in v]) for s, v in self.by_size.items()}
        self.sizes = sorted(self.by_size)

    def occurs(self, h: np.ndarray) -> np.ndarray:
        out = self.maybe[(h & self.mask).astype(np.int64)]
        at = np.flatnonzero(out)
        k = np.searchsorted(self.known, h[at])
        out[at] = self.known[np.minimum(k, len(self.known) - 1)] == h[at] if len(self.known) else False
        return out


def _similarity(window: np.ndarray, item: tuple[np.ndarray, np.ndarray], size: int) -> float:
    """Weighted Jaccard similarity; a shingle weighs as often as it occurs."""
    h, n = np.unique(window, return_counts=True)
    known, m = item
    k = np.minimum(np.searchsorted(known, h), len(known) - 1)
    common = int(np.where(known[k] == h, np.minimum(n, m[k]), 0).sum())
    return common / (len(window) + size - common)


def _repeats(h: np.ndarray, occurs: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(last place before which a shingle up to here was already, place of the occurrence that makes each known shingle one
    too many for any item)."""
    order = np.argsort(h, kind="stable")
    own = h[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    rank = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    before, spare = np.full(len(h), -1), np.full(len(h), -1)
    again = np.flatnonzero(rank > 0)
    before[order[again]] = order[again - 1]
    most = np.ones(len(h), dtype=np.int64)
    most[occurs] = items.most[np.searchsorted(items.known, h[occurs])]
    most = np.maximum(most[order], 1)
    over = np.flatnonzero(rank >= most)
    spare[order[over]] = order[over - most[over]]
    return np.maximum.accumulate(before), spare


def _capped(occurs: np.ndarray, spare: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` shingles how many it may share with an item at most."""
    at = np.flatnonzero(occurs)
    low, high = np.maximum(np.maximum(spare[at] + 1, at - width + 1), 0), np.minimum(at, len(occurs) - width)
    some = low <= high
    steps = np.bincount(low[some], minlength=len(occurs) + 1) - np.bincount(high[some] + 1, minlength=len(occurs) + 1)
    return np.cumsum(steps)[:len(occurs) - width + 1]


def leaks(h: np.ndarray, occurs: np.ndarray, items: Items, similarity: float) -> dict[int, tuple[float, int, int]]:
    """{item: (similarity, first shingle, shingles)} of one document; the most similar, then earliest window."""
    out: dict[int, tuple[float, int, int]] = {}
    n, count, total, repeats = len(h), np.concatenate([[0], np.cumsum(occurs)]), None, None
    for size in items.sizes:
        width = min(size, n)
        least = int(np.ceil(similarity * (size + width) / (1 + similarity) - 1e-9))
        if least > width or count[-1] < least:
            continue
        start = np.flatnonzero(count[width:] - count[:n - width + 1] >= least)
        for lo in range(0, len(start), STRIP):
            at = start[lo: lo + STRIP]
            total = _bit_sums(h) if total is None else total
            x, y = near_fingerprints(_fingerprints(total, at, at + width), items.blocks[size])
            if repeats is None:
                repeats = _repeats(h, occurs, items)
            # a shingle that stands in a window again and again pulls its fingerprint: such windows are compared as they are
            twice = np.flatnonzero((repeats[0][at + width - 1] >= at) & (_capped(occurs, repeats[1], width)[at] >= least))
            if len(twice):
                m = len(items.blocks[size])
                both = np.unique(np.concatenate([x * m + y, np.repeat(twice * m, m) + np.tile(np.arange(m), len(twice))]))
                x, y = both // m, both % m
            for a, b in zip(at[x], y, strict=True):
                number, own, _ = items.by_size[size][b]
                s = _similarity(h[a: a + width], own, size)
                if s >= similarity and s > out.get(number, (0.0,))[0]:
                    out[number] = (s, int(a), width)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, part_words: int = PART_WORDS,
               id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, word_start, word_end): documents that hold a copy of a benchmark item.

    A window of a document's words, as long as the item (or the whole document, where that is shorter), is a copy if
    the weighted Jaccard similarity of both multisets of 5-word shingles (A-Z lower-cased, words between ASCII white
    space) reaches ``similarity``; each item found in a document is one row, with its best window. Items and texts of
    fewer than five words (NULL and empty ones too) match nothing; repeated rows are searched each; whole texts are
    searched; an empty table gives an empty result; other columns are ignored. The benchmark is the query set: it is
    sent out in parts of about ``part_words`` words, each searched against all documents.
    """
    asked = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("words")).filter("length(words) > 0")
    size = asked.agg(F.sum(F.length("words") / 4)).first()[0] or 0
    parts = int(size // part_words) + 1
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, word_start long, word_end long"
    ids_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for k in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k).orderBy("item", "words").collect()
        sent = docs.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(*sent.value)
            smallest = items.sizes[0] if items.sizes else 0
            for b in batches:
                at, found = [], []
                for p in pieces(b.column(1)):
                    h, first = _shingles(p)
                    occurs = items.occurs(h)
                    total = np.concatenate([[0], np.cumsum(occurs)])
                    held = total[first[1:]] - total[first[:-1]]
                    for r in np.flatnonzero(held >= max(1, similarity * smallest)):
                        best = leaks(h[first[r]: first[r + 1]], occurs[first[r]: first[r + 1]], items, similarity)
                        at += [p.lo + int(r)] * len(best)
                        found += [(items.ids[i], s, a, a + n + GRAM - 1) for i, (s, a, n) in sorted(best.items())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), pa.array([x[0] for x in found], ids_type), pa.array([x[1] for x in found], pa.float64()),
                     pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.int64())],
                    names=["doc_id", "item_id", "similarity", "word_start", "word_end"])

        part = docs.select(id_col, text_col).mapInArrow(lean(run), schema)
        out = part if out is None else out.unionByName(part)
    return out
