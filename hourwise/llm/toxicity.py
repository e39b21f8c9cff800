"""Toxicity by a subsequence-kernel support vector machine with Nyström landmarks (operator 5).

The kernel compares words by the letter triples that both hold in this order, with gaps: a triple that spans s letters
counts ``DECAY ** (s - 3)``, up to ``SPAN`` letters, and the sum is divided by both words' norms. So an insult keeps
most of its triples if a letter is inserted, doubled or dropped, or an ending added. Marks inside a word are skipped,
letter-like digits read as letters, and letters standing alone in a row are read as one word.

The machine is trained on words of labelled documents' sentences, found by the evidence of words and of word beginnings
(stems with many endings): Nyström features are the kernel's values with the
landmark words times the inverse root of the landmarks' own kernel matrix. Its decision function is a sum of kernel
values with the landmarks, and so of one weight for each triple: scoring adds up these weights, without a loop over
landmarks. A text is as toxic as its two worst words, and one that stands alone must be the worse; the margin is calibrated on
documents kept aside.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.llm.arrays import Piece, lean, mix, pieces, runs, span_hashes
from hourwise.llm.hashed import platt, sigmoid
from hourwise.llm.samples import fitted, held_out, share

SPAN, DECAY = 8, 0.5
LANDMARKS = 256
#: Labelled documents that the machine is trained on, about, for each label.
SAMPLE_ROWS = 3000
#: Words of clean documents that are negative examples: any, then those that a first machine scores highest.
NEGATIVES, HARD_NEGATIVES = 20_000, 1_500
#: Least log-likelihood ratio (about chance in a million) of a word's counts in toxic and clean documents.
SURPRISE = 28.0
#: Margin of a text without a word of three letters.
NO_WORD = -1.5
#: By so much a single word must be worse than two words.
ALONE = 1.5
#: Symbols of the shortest words that are looked at: a mark and three letters.
SHORTEST = 4
#: Letters of the word beginnings whose evidence is pooled, beside that of whole words.
STEMS = (4, 5, 6, 7)
#: Words whose features are held at once.
SLAB = 1024

_BLANK = 255
_LETTERLIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """For each code point: 1-26 a-z, 27-63 other letters, 0 skipped, 255 white space."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x10000):
        c = chr(cp)
        c = _LETTERLIKE.get(c, c).lower()[0]
        if "a" <= c <= "z":
            out[cp] = ord(c) - 96
        elif c.isalpha():
            out[cp] = 27 + ord(c) * 2654435761 % 37
    out[0x10000:] = 63
    out[[0x20, *range(0x09, 0x0E), 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _BLANK
    return out


def letter_words(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, start, end, first): symbols of all words, a word's mark and its letters, each word's span in them, first
    words by row."""
    sym = _symbols()[np.frombuffer(p.buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)]
    points = np.zeros(len(p.buf) + 1, dtype=np.int64)
    np.cumsum((p.buf & 0xC0) != 0x80, out=points[1:])
    used = np.zeros(len(sym) + 1, dtype=np.int64)
    np.cumsum(sym != 0, out=used[1:])
    sym = sym[sym != 0]
    w = runs(sym == _BLANK, used[points[p.off]])
    size = w.end - w.start
    letters = sym[sym != _BLANK]
    start, row = np.cumsum(size) - size, w.row
    single = np.zeros(len(size), dtype=bool)
    single[1:] = (size[1:] == 1) & (size[:-1] == 1) & (row[1:] == row[:-1])
    start, row = start[~single], row[~single]
    # each word begins with the symbol 0, so that triples tell its first letters from others
    marked = np.insert(letters, start, 0)
    start = start + np.arange(len(start))
    return marked, start, np.append(start[1:], len(marked)), np.searchsorted(row, np.arange(p.rows + 1))


@lru_cache(maxsize=1)
def _norms() -> np.ndarray:
    n = np.arange(4096)
    return np.sqrt(np.maximum(sum((s - 2) * np.maximum(n - s + 1, 0) * DECAY ** (2 * (s - 3)) for s in range(3, SPAN + 1)), 1e-9))


def _norm(size: np.ndarray) -> np.ndarray:
    """Norm of a word, from its length: the root of the sum of its triples' squared weights."""
    table = _norms()
    return np.where(size < len(table), table[np.minimum(size, len(table) - 1)], table[-1] * np.sqrt(size / (len(table) - 1)))


def _triples(letters: np.ndarray, word: np.ndarray):
    """(positions of the first letter, triple, weight) for each pair of steps inside words."""
    c = letters.astype(np.int32)
    for span in range(3, SPAN + 1):
        n = len(c) - span + 1
        if n <= 0:
            return
        at = np.flatnonzero(word[:n] == word[span - 1:])
        ends = (c[at] << 12) | c[at + span - 1]
        for j in range(1, span - 1):
            yield at, ends | (c[at + j] << 6), DECAY ** (span - 3)


def margins(letters: np.ndarray, start: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Decision value of each word, ``weights`` by triple."""
    size = end - start
    out = np.zeros(len(letters) + 1, dtype=np.float64)
    for at, triple, scale in _triples(letters, np.repeat(np.arange(len(start)), size)):
        out[at] += weights[triple] * np.float32(scale)
    total = np.concatenate([[0.0], np.cumsum(out)])
    return (total[end] - total[start]) / _norm(size)


def _gathered(letters: np.ndarray, start: np.ndarray, end: np.ndarray, which: np.ndarray):
    """The words ``which``, one after the other."""
    size = (end - start)[which]
    new = np.cumsum(size) - size
    return letters[np.arange(size.sum()) + np.repeat(start[which] - new, size)], new, new + size


def worst_words(p: Piece, weights: np.ndarray) -> np.ndarray:
    """The two largest decision values among the distinct words of each text; each distinct word of the piece is scored
    once."""
    letters, start, end, first = letter_words(p)
    out = np.full((p.rows, 2), NO_WORD)
    long = np.flatnonzero(end - start >= SHORTEST)
    if not len(long):
        return out
    _, one, back = np.unique(span_hashes(letters, start[long], end[long]), return_index=True, return_inverse=True)
    value = margins(*_gathered(letters, start, end, long[one]), weights)[back]
    begin = np.searchsorted(long, first)
    some = np.flatnonzero(np.diff(begin) > 0)
    out[some, 0] = np.maximum.reduceat(value, begin[some])
    rest = np.where(value == np.repeat(out[:, 0], np.diff(begin)), -np.inf, value)
    out[some, 1] = np.maximum(np.maximum.reduceat(rest, begin[some]), np.minimum(out[some, 0], NO_WORD))
    return out


def _margin(worst: np.ndarray, bias: float) -> np.ndarray:
    """Margin of each text: of its second worst word, or of the worst one less ``ALONE``."""
    return np.clip(np.maximum(worst[:, 1], worst[:, 0] - ALONE) + bias, -3, 3)


class Landmarks:
    """Landmark words as a list of (landmark, weight) for each triple that one of them holds."""

    def __init__(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.count = len(start)
        owner, parts = np.repeat(np.arange(self.count), end - start), []
        for at, triple, scale in _triples(letters, owner):
            parts.append((triple.astype(np.int64) * self.count + owner[at], np.full(len(at), scale)))
        key, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        self.owner = key % self.count
        self.value = np.bincount(back, np.concatenate([v for _, v in parts])) / _norm(end - start)[self.owner]
        self.triples, self.first = np.unique(key // self.count, return_index=True)
        self.first = np.append(self.first, len(key))
        self.place = np.full(1 << 18, -1, dtype=np.int32)
        self.place[self.triples] = np.arange(len(self.triples))

    def kernel(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Kernel of each word with each landmark."""
        out = np.zeros(len(start) * self.count)
        word = np.repeat(np.arange(len(start)), end - start)
        for at, triple, scale in _triples(letters, word):
            place = self.place[triple]
            at, place = at[place >= 0], place[place >= 0]
            n = self.first[place + 1] - self.first[place]
            entry = np.arange(n.sum()) + np.repeat(self.first[place] - (np.cumsum(n) - n), n)
            out += np.bincount(np.repeat(word[at], n) * self.count + self.owner[entry], self.value[entry] * scale, minlength=len(out))
        return out.reshape(len(start), self.count) / _norm(end - start)[:, None]

    def weights(self, theta: np.ndarray) -> np.ndarray:
        """Weight of each triple in the sum of the landmarks' kernels with factors ``theta``."""
        out = np.zeros(1 << 18, dtype=np.float32)
        out[self.triples] = np.add.reduceat(self.value * theta[self.owner], self.first[:-1])
        return out


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-6, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on its support vectors; the rows are folded
    into the normal equations ``SLAB`` at a time."""
    d = z.shape[1]
    theta = np.zeros(d + 1)
    penalty = np.full(d + 1, ridge * weight.sum())
    penalty[-1] = 1e-6
    for _ in range(rounds):
        gram, right = np.diag(penalty), np.zeros(d + 1)
        for lo in range(0, len(z), SLAB):
            x = np.column_stack([z[lo: lo + SLAB], np.ones(len(z[lo: lo + SLAB]))]).astype(np.float64)
            on = y[lo: lo + SLAB] * (x @ theta) < 1
            x, w = x[on], weight[lo: lo + SLAB][on]
            gram += (x * w[:, None]).T @ x
            right += x.T @ (w * y[lo: lo + SLAB][on])
        new = np.linalg.solve(gram, right)
        if np.abs(new - theta).max() < 1e-6:
            break
        theta = new
    return theta[:-1], float(theta[-1])


def _evidence(unit: np.ndarray, doc: np.ndarray, toxic: np.ndarray, n_units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units that speak for toxicity, most toxic documents first, and the numbers of toxic and clean documents of all):
    a unit's share among toxic documents is nine times that among clean ones at least, and more than chance."""
    is_toxic = toxic[doc] == 1
    n_toxic, n_clean = np.bincount(unit[is_toxic], minlength=n_units), np.bincount(unit[~is_toxic], minlength=n_units)
    share_toxic, share_clean = n_toxic / max(1, (toxic == 1).sum()), n_clean / max(1, (toxic == 0).sum())
    n_docs = np.bincount(toxic, minlength=2)
    prior = n_docs[1] / n_docs.sum()
    n = n_toxic + n_clean
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = 2 * (np.nan_to_num(n_toxic * np.log(n_toxic / (n * prior))) + np.nan_to_num(n_clean * np.log(n_clean / (n * (1 - prior)))))
    able = np.flatnonzero((share_toxic >= 9 * share_clean) & (surprise >= SURPRISE))
    return able[np.argsort(-n_toxic[able], kind="stable")], n_toxic, n_clean


def _witnesses(word: np.ndarray, doc: np.ndarray, toxic: np.ndarray, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, their weights, the evidence each stands for) that explain the toxic documents: of words and of beginnings
    of words, those that speak for toxicity, taken greedily while three toxic documents more are explained. For a
    beginning stand all its words that are in more toxic than clean documents."""
    n_words, size = len(start), end - start
    order, n_toxic, n_clean = _evidence(word, doc, toxic, n_words)
    units = [(n_toxic[w], 0, w, np.array([w])) for w in order.tolist()]
    for length in STEMS:
        long = np.flatnonzero(size > length + 1)
        _, stem = np.unique(span_hashes(letters, start[long], start[long] + length + 1), return_inverse=True)
        of = np.full(n_words, -1, dtype=np.int64)
        of[long] = stem
        there = of[word] >= 0
        count = int(stem.max()) + 1 if len(stem) else 1
        both = np.unique(doc[there].astype(np.int64) * count + of[word[there]])
        able, n, _ = _evidence(both % count, both // count, toxic, count)
        for u in able.tolist():
            own = long[stem == u]
            units.append((n[u], length, u, own[n_toxic[own] > n_clean[own]]))
    units.sort(key=lambda x: (-x[0], x[1], x[2]))
    is_toxic = toxic[doc] == 1
    by = np.argsort(word[is_toxic], kind="stable")
    docs, bounds = doc[is_toxic][by], np.concatenate([[0], np.cumsum(np.bincount(word[is_toxic], minlength=n_words))])
    held = lambda words: np.unique(np.concatenate([docs[bounds[w]: bounds[w + 1]] for w in words.tolist()] or [docs[:0]]))
    explained, taken, least = np.zeros(len(toxic), dtype=bool), {}, None
    for n, _, _, words in units:
        d = held(words)
        if (~explained[d]).sum() >= 3:
            explained[d] = True
            least = n
            for w in words.tolist():
                taken.setdefault(w, len(taken))
    # other words that stand in at least half as many documents as the rarest of these are witnesses as well
    for w in order.tolist():
        if least is not None and n_toxic[w] >= least // 2:
            taken.setdefault(w, len(taken))
    found = np.array(list(taken), dtype=np.int64)
    return found, n_toxic[found].astype(float), n_toxic


def _with_insertions(letters, start, end, found, gain, variants: int = 6):
    """Virtual examples: each witness of five letters or more also with a letter inserted at random inside it, as
    further words with a sixteenth of its weight in all."""
    rng = np.random.default_rng(55)
    new, owner = [], []
    for w, word in enumerate(found):
        own = letters[start[word]: end[word]]
        if len(own) >= 5:
            for _ in range(variants):
                new.append(np.insert(own, rng.integers(1, len(own)), rng.integers(1, 27)))
                owner.append(w)
    size = np.array([len(x) for x in new], dtype=np.int64)
    at = len(letters) + np.cumsum(size) - size
    ids = len(start) + np.arange(len(new))
    return (np.concatenate([letters, *new]), np.concatenate([start, at]), np.concatenate([end, at + size]),
            np.concatenate([found, ids]), np.concatenate([gain, gain[owner] / (16 * variants)]))


def _pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, distinct word) pairs, and the distinct words: hashes (ascending), letters, start, end."""
    docs, marks, words = [], [], []
    for p in pieces(texts):
        letters, start, end, first = letter_words(p)
        long = np.flatnonzero(end - start >= SHORTEST)
        h = span_hashes(letters, start[long], end[long])
        row = p.lo + np.repeat(np.arange(p.rows), np.diff(first))[long]
        order = np.lexsort((h, row))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(row[order]) != 0) | (h[order][1:] != h[order][:-1])
        docs.append(row[order][new].astype(np.int32))
        marks.append(h[order][new])
        own, one = np.unique(h, return_index=True)
        text, begin, stop = _gathered(letters, start, end, long[one])
        words.append((own, text, stop - begin))
    doc, mark = np.concatenate([*docs, np.zeros(0, np.int32)]), np.concatenate([*marks, np.zeros(0, np.uint64)])
    del docs, marks
    hashes, letters, size = (np.concatenate([x[k] for x in words]) for k in range(3))
    del words
    distinct, one = np.unique(hashes, return_index=True)
    begin = np.cumsum(size) - size
    letters, start, end = _gathered(letters, begin, begin + size, one)
    return doc, np.searchsorted(distinct, mark), distinct, letters, start, end


def _copies(doc: np.ndarray, word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Near copies of an earlier document: those whose two smallest hashes of words of 7 letters or more agree with its."""
    long = np.flatnonzero(size[word] >= SHORTEST + 4)  # pairs are in order of document and hash
    d, w = doc[long], word[long]
    first = np.flatnonzero(np.diff(d, prepend=-1))
    two = first[(first + 1 < len(d))]
    two = two[d[two + 1] == d[two]]
    _, kept = np.unique(w[two].astype(np.int64) * (len(size) + 1) + w[two + 1], return_index=True)
    return np.setdiff1d(d[two], d[two][kept])


def fit(sample: pd.DataFrame | None) -> bytes:
    """Weights by triple and the calibration of a text's two worst words, from texts labelled 0 or 1."""
    if sample is None or sample["label"].nunique() < 2:
        return pickle.dumps(None)
    kept = ~sample["text"].duplicated().to_numpy()
    toxic = sample["label"].to_numpy()[kept]
    texts = pa.array(sample["text"][kept], pa.large_string())
    sample.drop(columns="text", inplace=True)
    doc, word, distinct, letters, start, end = _pairs(texts)
    if not len(distinct):
        return pickle.dumps(None)
    aside = mix(np.arange(len(toxic)).astype(np.uint64)) % np.uint64(5) == 0
    learn = ~aside[doc] & ~np.isin(doc, _copies(doc, word, end - start))
    found, weight, _ = _witnesses(word[learn], doc[learn], toxic, letters, start, end)
    if not len(found):
        return pickle.dumps(None)
    clean = np.unique(word[learn & (toxic[doc] == 0)])
    del doc, word, learn
    clean = np.setdiff1d(clean, found)  # in hash order
    gain = weight / weight.sum()
    letters, start, end, found, gain = _with_insertions(letters, start, end, found, gain)
    share_ = LANDMARKS * 3 // 4
    spread = found[:: max(1, -(-len(found) // share_))][:share_]  # from the frequent to the rare ones
    marks = np.concatenate([spread, clean[: LANDMARKS - len(spread)]])
    weights, bias, hard = None, 0.0, clean[:0]
    for again in range(3):
        if again:
            value = np.concatenate([margins(*_gathered(letters, start, end, clean[lo: lo + 50 * SLAB]), weights) for lo in range(0, len(clean), 50 * SLAB)])
            worst = clean[np.argsort(-value, kind="stable")[:HARD_NEGATIVES]]
            hard = np.union1d(hard, worst)
            marks = np.union1d(marks, worst[:LANDMARKS // 8])
        negatives = np.concatenate([clean[:NEGATIVES], hard])
        cost = np.concatenate([np.full(min(len(clean), NEGATIVES), 1.0 / NEGATIVES), np.full(len(hard), 1.0 / HARD_NEGATIVES)])
        weights, bias = _train(letters, start, end, marks, found, gain, negatives, cost)
    score = _margin(np.concatenate([worst_words(p, weights) for p in pieces(texts)]), bias)
    held = np.flatnonzero(aside) if len(np.unique(toxic[aside])) == 2 else np.arange(len(toxic))
    return pickle.dumps((weights, bias, *platt(score[held], toxic[held])))


def _train(letters, start, end, marks, found, gain, negatives, cost) -> tuple[np.ndarray, float]:
    landmarks = Landmarks(*_gathered(letters, start, end, marks))
    rows = lambda which: landmarks.kernel(*_gathered(letters, start, end, which))
    values, vectors = np.linalg.eigh(rows(marks))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # landmarks to Nyström features
    used = np.concatenate([found, negatives])
    y = np.concatenate([np.ones(len(found)), -np.ones(len(negatives))])
    z = np.concatenate([(rows(used[lo: lo + SLAB]) @ root).astype(np.float32) for lo in range(0, len(used), SLAB)])
    weight = np.concatenate([gain, cost]) * len(y)
    theta, bias = _machine(z, y, weight)
    return landmarks.weights(root @ theta), bias


def toxicity_model(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """Machine trained on about ``rows`` documents of each label of ``labels.toxic`` that are not held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.max("toxic").alias("label"))
    picked = share(known.filter("label = 0"), id_col, 2 * rows, 5).unionByName(share(known.filter("label = 1"), id_col, rows, 5))
    # at most 6 * rows pairs of numbers
    sample = docs.select(id_col, F.col(text_col).alias("text")).filter("length(text) > 0").join(F.broadcast(picked), id_col).limit(8 * rows)
    return fitted(sample.select("text", "label"), fit)


def _scores(column: pa.Array, learned) -> np.ndarray:
    if learned is None:
        return np.zeros(len(column))
    weights, bias, slope, shift = learned
    parts = [worst_words(p, weights) for p in pieces(column)]
    return sigmoid(slope * _margin(np.concatenate(parts), bias) + shift) if parts else np.zeros(0)


def score_toxicity(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, score (calibrated probability of label 1) and predicted (1 from 0.5 on).

    Whole texts are scored, however long, and repeated rows each; NULL, empty and wordless texts get the score of the
    margin ``NO_WORD``; if nothing could be learned every score is 0; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = pickle.loads(sent.value)
        for b in batches:
            score = _scores(b.column(1), learned)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``score_toxicity`` does not predict as toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = pickle.loads(sent.value)
        for b in batches:
            yield b.filter(pa.array(_scores(b.column(at), learned) < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
