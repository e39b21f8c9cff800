"""Quality rules and a hashed n-gram classifier (operator 10)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.llm.arrays import U64, Piece, mix, pieces, span_hashes, sums, windows, words
from hourwise.llm.hashed import byte_grams, platt, range_sums, sigmoid, word_grams
from hourwise.llm.samples import fitted, share

WINDOW = 8
#: Fixed values of the task: characters that count as symbols, and the limits of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A text is kept from this calibrated probability of quality 1 on.
THRESHOLD = 0.5
#: Labelled rows that the classifier is fitted on, about, for each label.
SAMPLE_ROWS = 3000
BITS = 16
GRAMS = ((byte_grams, 3), (byte_grams, 4), (word_grams, 1), (word_grams, 2))

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_LEAD = np.array([(x & 0xC0) != 0x80 for x in range(256)])


def base_counts(p: Piece) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    w = words(p)
    n, row = w.count, w.row
    lead = np.zeros(len(p.buf) + 1, dtype=np.int64)
    np.cumsum(_LEAD[p.buf], out=lead[1:])
    h = span_hashes(p.buf, w.start, w.end)
    g, first = windows(h, w.first, WINDOW, whole=False)
    key = mix(g ^ np.repeat(np.arange(p.rows), np.diff(first)).astype(U64) * U64(0xD1342543DE82EF95))
    again = _repeated(key)
    # each repeated window covers its words: +1 at its first word, -1 after its last
    at = (np.arange(len(g)) + np.repeat(w.first[:-1] - first[:-1], np.diff(first)))[again]
    change = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    covered = np.cumsum(change)[:-1] > 0
    return {"n_words": n, "word_chars": sums(lead[w.end] - lead[w.start], w.first), "n_symbols": sums(_SYMBOL[p.buf], p.off),
            "n_dup_lines": _dup_lines(p, w), "n_repeat_words": np.bincount(row[covered], minlength=p.rows)}


def _repeated(key: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, dtype=bool)
    same[1:-1] = k[1:] == k[:-1]
    out = np.empty(len(k), dtype=bool)
    out[order] = same[1:] | same[:-1]
    return out


def _dup_lines(p: Piece, w) -> np.ndarray:
    """Lines (between line feeds) with a word that equal an earlier line of their text."""
    n = len(p.buf)
    feed = np.flatnonzero(p.buf == 10)
    # a line begins where a text begins and after each line feed
    start = np.concatenate([p.off[:-1], feed + 1])
    row = np.concatenate([np.arange(p.rows), np.searchsorted(p.off, feed, "right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.empty(len(start), dtype=np.int64)
    end[:-1] = start[1:] - 1
    end[-1:] = n
    last = np.flatnonzero(np.diff(row, append=p.rows) != 0)  # the last line of a text ends with it
    end[last] = p.off[row[last] + 1]
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, row = start[worded], end[worded], row[worded]
    key = mix(span_hashes(p.buf, start, end) ^ row.astype(U64) * U64(0xD1342543DE82EF95))
    firsts = np.zeros(len(key), dtype=bool)
    firsts[np.unique(key, return_index=True)[1]] = True
    return np.bincount(row[~firsts], minlength=p.rows)


def _grams(p: Piece):
    """(buckets, first and end positions by row) for each kind of n-gram, every kind in buckets of its own."""
    for k, (grams, order) in enumerate(GRAMS):
        at, lo, hi = grams(p, order, BITS, False)
        yield at + np.int32(k << BITS), lo, hi


def _margin(p: Piece, weights: np.ndarray) -> np.ndarray:
    """Sum over the kinds of the mean weight of a text's n-grams."""
    out = np.zeros(p.rows)
    for at, lo, hi in _grams(p):
        out += range_sums(weights[at], lo, hi) / np.maximum(hi - lo, 1)
    return out


def fit(sample: pd.DataFrame | None, epochs: int = 6, rate: float = 2.0, l2: float = 1e-6) -> bytes:
    """Weights (AdaGrad, logistic loss, classes weighed equally) and their calibration on a fifth kept aside."""
    if sample is None or sample["label"].nunique() < 2:
        return pickle.dumps(None)
    x, y = [], sample["label"].to_numpy(float)
    for p in pieces(pa.array(sample["text"], pa.string())):
        parts = list(_grams(p))
        for r in range(p.rows):
            idx, val = [], []
            for at, lo, hi in parts:
                u, c = np.unique(at[lo[r]:hi[r]], return_counts=True)
                idx.append(u)
                val.append(c / max(hi[r] - lo[r], 1))
            x.append((np.concatenate(idx), np.concatenate(val).astype(np.float32)))
    rng = np.random.default_rng(11)
    aside = rng.permutation(len(y)) % 5 == 0
    if min(len(np.unique(y[aside])), len(np.unique(y[~aside]))) < 2:
        aside[:] = False
    size = len(GRAMS) << BITS
    w, seen, bias, bias_seen = np.zeros(size, np.float32), np.full(size, 1e-8, np.float32), 0.0, 1e-8
    learn = np.flatnonzero(~aside)
    weight = np.where(y == 1, 0.5 / y[learn].mean(), 0.5 / (1 - y[learn].mean()))
    for _ in range(epochs):
        for i in rng.permutation(learn):
            at, v = x[i]
            g = float(weight[i] * (sigmoid(w[at] @ v + bias) - y[i]))
            step = g * v + l2 * w[at]
            seen[at] += step * step
            w[at] -= rate * 0.1 * step / np.sqrt(seen[at])
            bias_seen += g * g
            bias -= 0.1 * g / np.sqrt(bias_seen)
    held = np.flatnonzero(aside) if aside.any() else learn
    a, b = platt(np.array([w[x[i][0]] @ x[i][1] + bias for i in held]), y[held])
    return pickle.dumps((w * np.float32(a), a * bias + b))


def quality_model(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """Classifier of ``labels.quality`` fitted on about ``rows`` labelled rows of each label (hash of the id decides)."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("quality").alias("label"))
    picked = share(known.filter("label = 0"), id_col, rows, 10).unionByName(share(known.filter("label = 1"), id_col, rows, 10))
    # at most 4 * rows pairs of numbers
    sample = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(picked), id_col).limit(8 * rows)
    return fitted(sample.select("text", "label"), fit)


def quality(docs: DataFrame, model: bytes, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the base counts, ``base_failed``, ``prob`` (calibrated probability of
    quality 1; 1 where nothing could be learned) and ``kept``.

    Words are runs of anything but ASCII white space. A NULL or empty text has no words and so fails the base rules;
    repeated rows are scored each; long texts are taken whole; all other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = pickle.loads(sent.value)
        for b in batches:
            for p in pieces(b.column(1)):
                c = base_counts(p)
                prob = sigmoid(_margin(p, learned[0]) + learned[1]) if learned else np.ones(p.rows)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(p.lo, p.rows), *(pa.array(c[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(prob), pa.array(~failed & (prob >= threshold))],
                    names=[id_col, *names, "base_failed", "prob", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, {', '.join(f'{k} long' for k in names)}, base_failed boolean, prob double, kept boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
