"""Language identification: sparse multinomial logistic regression on character n-grams (operator 7)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.llm.arrays import Piece, pieces
from hourwise.llm.hashed import byte_grams, range_sums
from hourwise.llm.samples import fitted, held_out, share

#: Character n-grams (of UTF-8 bytes, A-Z folded) of these lengths, hashed to 2^BITS buckets for each length.
ORDERS, BITS = (1, 2, 3, 4), 14
BUCKETS = len(ORDERS) << BITS
#: Labelled rows that the model is fitted on, about, for each language.
SAMPLE_ROWS = 1500
UNDETERMINED = "und"


def _grams(p: Piece):
    for k, order in enumerate(ORDERS):
        at, lo, hi = byte_grams(p, order, BITS, True)
        yield at + np.int32(k << BITS), lo, hi


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rows of ``docs`` that hold each bucket's n-grams (last: all rows), counted over every row in one pass.

    A task adds up one array of counts; the arrays meet in a sum by slice of buckets, so nothing grows with the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(BUCKETS + 1, dtype=np.int64), np.zeros(BUCKETS, dtype=bool)
        for b in batches:
            for p in pieces(b.column(0)):
                parts = list(_grams(p))
                total[-1] += p.rows
                for r in range(p.rows):
                    seen[:] = False
                    for at, lo, hi in parts:
                        seen[at[lo[r]:hi[r]]] = True
                    total[:-1] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    counts = docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    got = counts.toPandas()  # BUCKETS + 1 rows at most
    out[got["bucket"]] = got["n"]
    return out


def _features(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, share among the text's n-grams of that length times idf) of each text."""
    out = []
    for p in pieces(pa.array(texts, pa.string())):
        parts = list(_grams(p))
        for r in range(p.rows):
            at, val = [], []
            for k, lo, hi in parts:
                u, c = np.unique(k[lo[r]:hi[r]], return_counts=True)
                at.append(u)
                val.append(c / max(hi[r] - lo[r], 1) * idf[u])
            out.append((np.concatenate(at), np.concatenate(val)))
    return out


def ftrl(x: list, y: np.ndarray, classes: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 3):
    """Weights and biases of a multinomial logistic regression, by follow-the-regularised-leader (proximal, one
    learning rate for each weight) with elastic-net penalties; most weights stay exactly 0."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    rng = np.random.default_rng(seed)

    def weights(zz, nn):
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, v = np.append(x[i][0], BUCKETS), np.append(x[i][1], 1.0)
            zz, nn = z[at], n[at]
            w = weights(zz, nn)
            s = v @ w
            q = np.exp(s - s.max())
            q /= q.sum()
            q[y[i]] -= 1
            g = v[:, None] * q
            new = nn + g * g
            z[at] = zz + g - (np.sqrt(new) - np.sqrt(nn)) / alpha * w
            n[at] = new
    w = weights(z, n)
    return w[:-1], w[-1]


def _temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """Factor on the scores with the least log loss (golden section over its logarithm)."""
    def loss(t):
        s = scores * np.exp(t)
        m = s.max(1)
        return (m + np.log(np.exp(s - m[:, None]).sum(1)) - s[np.arange(len(y)), y]).mean()

    lo, hi, gold = -4.0, 4.0, (5 ** 0.5 - 1) / 2
    while hi - lo > 1e-4:
        a, b = hi - gold * (hi - lo), lo + gold * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _fit(frequencies: np.ndarray):
    idf = np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])) + 1

    def run(sample: pd.DataFrame | None) -> bytes:
        if sample is None or not len(sample):
            return pickle.dumps(([], None, None))
        names = sorted(sample["lang"].unique(), key=lambda s: s.encode())
        y = sample["lang"].map({x: i for i, x in enumerate(names)}).to_numpy()
        x = _features(sample["text"].tolist(), idf)
        aside = np.random.default_rng(4).permutation(len(y)) % 5 == 0
        learn = np.flatnonzero(~aside) if (~aside).any() else np.arange(len(y))
        w, bias = ftrl([x[i] for i in learn], y[learn], len(names))
        held = np.flatnonzero(aside) if aside.any() else learn
        scores = np.array([x[i][1] @ w[x[i][0]] for i in held]) + bias
        t = _temperature(scores, y[held])
        return pickle.dumps((names, (w * idf[:, None] * t).astype(np.float32), bias * t))

    return run


def language_model(docs: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> bytes:
    """Model of ``lang_col``, learned from rows that are not held out and have text and language: document
    frequencies from all of them, weights from about ``rows`` rows of each language (every language there is), temperature
    from a fifth of those."""
    known = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    frequencies = document_frequencies(known, text_col)
    sizes = known.groupBy(lang_col).agg(F.count(F.lit(1)).alias("_n"))
    pick = F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(1 << 24))
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("_n")) * F.lit(1 << 24)
    some = known.join(sizes, lang_col).filter(pick < share)
    sample = some.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).limit(2 * rows * max(1, sizes.count()))
    return fitted(sample, _fit(frequencies))


def identify(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, lang_pred, score (calibrated probability of the predicted language).

    lang_pred is ``und`` (score 0) if the text is NULL, empty or without a letter, or if nothing could be learned.
    Ties go to the first language by code point; repeated rows are scored each; long texts are taken whole; other
    columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w, bias = pickle.loads(sent.value)
        columns = [np.ascontiguousarray(w[:, c]) for c in range(len(names))]
        for b in batches:
            for p in pieces(b.column(1)):
                scores = np.zeros((p.rows, max(1, len(names))))
                if names:
                    scores += bias
                    for at, lo, hi in _grams(p):
                        for c, column in enumerate(columns):
                            scores[:, c] += range_sums(column[at], lo, hi) / np.maximum(hi - lo, 1)
                q = np.exp(scores - scores.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                best = q.argmax(1)
                known = b.column(2).slice(p.lo, p.rows).to_numpy(zero_copy_only=False) & bool(names)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(p.lo, p.rows), pa.array([names[c] if k else UNDETERMINED for c, k in zip(best, known, strict=True)], pa.string()),
                     pa.array(np.where(known, q[np.arange(p.rows), best], 0.0))], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(id_col), F.col(text_col), letters).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
