"""Ranked lexical search over posting lists in geometric blocks (operator 12).

Documents become vectors of integer impacts over the terms that the queries ask for. They are ordered by a signature, the
signs of their sums along random directions, so that similar documents lie side by side, and cut into cells. In a cell
each term's posting list is cut, in that order, into blocks of similar documents; a block stores the coordinatewise
maximum of its documents' impacts, rounded up, over the terms that a query with the list's term asks for.

A query visits the lists of its terms. The weighted sum of a block's maxima bounds the score of all its documents, so a
block is skipped if the bound is below the query's current 50th score; the documents of other blocks are scored exactly.
A document with a score above the threshold stands in no block with a lower bound: results are exact. Thresholds come
from a first round over one of ``SCOUTS`` cells, and rise inside each task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.llm.arrays import FOLDED_BYTE, U64, Piece, mix, pieces, runs, span_hashes
from hourwise.llm.ranking import first_rows
from hourwise.llm.store import handed

#: Terms of the queries that are searched together, repeats counted; more queries make further blocks of queries.
QUERY_TERMS = 1 << 16
#: Directions of the signature.
DIRECTIONS = 20
#: Postings in a block; a cell's documents times the vocabulary; postings in a cell, and in a partition of the index.
BLOCK_POSTINGS, CELL_ENTRIES, CELL_POSTINGS, PART_POSTINGS = 32, 1 << 22, 1 << 17, 1 << 19
#: Coordinates of a query that a block's summary tells apart, heaviest first; others count with the cell's maximum.
SUMMARY_WIDTH = 1024
#: One of so many cells is searched first, for thresholds.
SCOUTS = 16
#: Impacts are below a million; a summary's byte stands for so much.
STEP = 3922
WORDS_AT_ONCE = 1 << 19

_OTHER = np.ones(256, dtype=bool)
_OTHER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _term_hashes(p: Piece) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of the terms of a piece, some at a time."""
    w = runs(_OTHER[p.buf], p.off)
    row = w.row
    for lo in range(0, len(row), WORDS_AT_ONCE):
        start, end = w.start[lo: lo + WORDS_AT_ONCE], w.end[lo: lo + WORDS_AT_ONCE]
        buf = p.buf[start[0]: end[-1]]
        yield row[lo: lo + WORDS_AT_ONCE], span_hashes(buf, start - start[0], end - start[0], FOLDED_BYTE)


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query number, id, distinct term hashes) of each row of ``items``."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [[] for _ in range(b.num_rows)]
            for p in pieces(b.column(2)):
                for row, h in _term_hashes(p):
                    for r, x in zip((p.lo + row).tolist(), h.view(np.int64).tolist(), strict=True):
                        terms[r].append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sorted(set(t)) for t in terms], pa.list_(pa.int64()))], names=["query", "id", "terms"])

    numbered = items.select(F.monotonically_increasing_id().alias("query"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return handed(numbered.mapInArrow(run, f"query long, id {kind}, terms array<long>"), "queries")


def term_vectors(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, terms, counts) of each document that has a term: its number of terms, and how often it holds each
    term of the sorted ``vocabulary`` (by place)."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(sent.value, U64)
        size = max(1, len(known))
        for b in batches:
            n, keys = np.zeros(b.num_rows, dtype=np.int64), [np.zeros(0, np.int64)]
            for p in pieces(b.column(2)):
                for row, h in _term_hashes(p):
                    n[p.lo: p.hi] += np.bincount(row, minlength=p.rows)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        hit = known[at] == h
                        keys.append((p.lo + row[hit]) * size + at[hit])
            key, count = np.unique(np.concatenate(keys), return_counts=True)
            some = np.flatnonzero(n)
            off = np.searchsorted(key, np.append(some, b.num_rows) * size).astype(np.int32)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(off), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), b.column(1).take(pa.array(some)), pa.array(n[some]), lists(key % size), lists(count)], names=["row", "id", "n", "terms", "counts"])

    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return handed(src.mapInArrow(run, f"row long, id {kind}, n long, terms array<int>, counts array<int>"), "term-vectors")


class Queries:
    """A block of queries over its vocabulary (places 0 to ``size`` - 1), as tasks use it."""

    def __init__(self, numbers: list[int], terms: list[np.ndarray], weight: np.ndarray):
        self.numbers, self.weight, self.size = numbers, weight, len(weight)
        self.terms = [t[np.argsort(-weight[t], kind="stable")] for t in terms]  # heaviest first
        self.first = np.cumsum([0, *(len(t) for t in terms)])
        self.flat = np.concatenate([*self.terms, np.zeros(0, np.int64)]).astype(np.int64)
        # coordinates that each list's summaries have
        main = [t[:SUMMARY_WIDTH] for t in self.terms]
        near: dict[int, list[np.ndarray]] = {}
        for m in main:
            for t in m.tolist():
                near.setdefault(t, []).append(m)
        self.near = {t: np.unique(np.concatenate(x)) for t, x in near.items()}
        self.bare = np.zeros(0, dtype=np.int64)

    @lru_cache(maxsize=None)  # noqa: B019 - one for each broadcast
    def columns(self, query: int, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a query, at the list of one of its terms: the summary's columns, their weights, and the query's terms that
        the summary doesn't have."""
        near, own = self.near.get(term, self.bare), self.terms[query]
        if not len(near):
            return self.bare, self.bare, own
        at = np.minimum(np.searchsorted(near, own), len(near) - 1)
        there = near[at] == own
        return at[there], self.weight[own[there]], own[~there]

    def width(self, term: int) -> int:
        return len(self.near.get(term, self.bare))


def _impacts(n: np.ndarray, off: np.ndarray, count: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = np.array([50 + 50 * x * documents // length for x in n.tolist()], dtype=np.int64)
    c = count.astype(np.int64)
    return (1_000_000_000 * c) // (1000 * c + 20 * np.repeat(m, np.diff(off)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = column.offsets.to_numpy()
    return off - off[0], column.flatten().to_numpy(zero_copy_only=False)


def _signed(vectors: DataFrame, sent, documents: int, length: int) -> DataFrame:
    """(signature, row, id, terms, impacts) of the documents that hold a term of the queries."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = pickle.loads(sent.value)
        bits = mix(np.arange(queries.size).astype(U64) + U64(12345))
        side = [np.where(bits >> U64(k) & U64(1), 1.0, -1.0) * queries.weight for k in range(DIRECTIONS)]
        for b in batches:
            off, terms = _flat(b.column(3))
            if not b.num_rows or not len(terms):
                continue
            value = _impacts(b.column(2).to_numpy(), off, _flat(b.column(4))[1], documents, length)
            mark = np.zeros(b.num_rows, dtype=np.int64)
            for s in side:
                mark = mark * 2 + (np.diff(np.concatenate([[0.0], np.cumsum(s[terms] * value)])[off]) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(mark), b.column(0), b.column(1), b.column(3), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(value.astype(np.int32)))], names=["signature", "row", "id", "terms", "impacts"])

    return vectors.filter(F.size("terms") > 0).select("row", "id", "n", "terms", "counts").mapInArrow(run, f"signature long, row long, id {kind}, terms array<int>, impacts array<int>")


def _cells(batches: Iterator[pa.RecordBatch], docs: int, postings: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, offsets, terms, impacts) of consecutive documents, ``docs`` or about ``postings`` postings at most."""
    for b in batches:
        off, terms = _flat(b.column(3))
        impacts, lo = _flat(b.column(4))[1], 0
        while lo < b.num_rows:
            hi = min(lo + docs, max(lo + 1, int(np.searchsorted(off, off[lo] + postings, "right")) - 1))
            yield b.column(1)[lo:hi], b.column(2)[lo:hi], off[lo: hi + 1] - off[lo], terms[off[lo]: off[hi]], impacts[off[lo]: off[hi]]
            lo = hi


def _blocked(off: np.ndarray, terms: np.ndarray, impacts: np.ndarray, queries: Queries) -> dict:
    """Posting lists of a cell in blocks, with the blocks' summaries."""
    docs = len(off) - 1
    dense = np.zeros((docs, queries.size), dtype=np.uint8)
    doc = np.repeat(np.arange(docs), np.diff(off))
    dense[doc, terms] = -(-impacts // STEP)
    order = np.argsort(terms, kind="stable")
    lists, first = np.unique(terms[order], return_index=True)
    first = np.append(first, len(order))
    posting, peak = doc[order], np.maximum.reduceat(impacts[order], first[:-1])
    summary = []
    for t, lo, hi in zip(lists.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
        if queries.width(t):
            summary.append(np.maximum.reduceat(dense[np.ix_(posting[lo:hi], queries.near[t])], np.arange(0, hi - lo, BLOCK_POSTINGS), axis=0).tobytes())
    return {"lists": lists, "first": first, "peak": peak, "postings": posting, "summary": b"".join(summary)}


_INDEX = "scout boolean, offsets array<int>, terms array<int>, impacts array<int>, lists array<int>, first array<int>, peak array<int>, postings array<int>, summary binary"


def build_index(vectors: DataFrame, queries: Queries, sent, documents: int, length: int, postings: int) -> DataFrame:
    """One row for each cell: ids and vectors of its documents, posting lists and summaries."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Queries = pickle.loads(sent.value)
        docs = max(32, CELL_ENTRIES // max(1, asked.size))
        for rows, ids, off, terms, impacts in _cells(batches, docs, CELL_POSTINGS):
            cell = _blocked(off, terms, impacts, asked)
            numbers = lambda x: pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
            scout = bool(mix(np.array([rows[0].as_py()], dtype=np.int64).view(U64))[0] % U64(SCOUTS) == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([scout]), numbers(off), numbers(terms), numbers(impacts)]
                + [numbers(cell[x]) for x in ("lists", "first", "peak", "postings")] + [pa.array([cell["summary"]], pa.binary())],
                names=["ids", "scout", "offsets", "terms", "impacts", "lists", "first", "peak", "postings", "summary"])

    signed = _signed(vectors, sent, documents, length)
    parts = max(1, -(-postings // PART_POSTINGS))
    dealt = signed.repartitionByRange(parts, "signature", "row").sortWithinPartitions("signature", "row")
    return handed(dealt.mapInArrow(run, f"ids array<{kind}>, {_INDEX}"), "search-index")


class Best:
    """The best documents so far of each query: (scores, ids), highest first, smaller ids first among equals."""

    def __init__(self, floor: np.ndarray, rows: int):
        self.floor, self.rows = floor.copy(), rows
        self.kept: dict[int, tuple[np.ndarray, list]] = {}

    def offer(self, query: int, score: np.ndarray, ids: list) -> None:
        if query in self.kept:
            score, ids = np.concatenate([self.kept[query][0], score]), self.kept[query][1] + ids
        order = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i] is None, ids[i]))[:self.rows]
        self.kept[query] = score[order], [ids[i] for i in order]
        if len(order) == self.rows:
            self.floor[query] = max(self.floor[query], score[order[-1]])


def _search_cell(cell: dict, queries: Queries, best: Best) -> None:
    docs, lists, first = len(cell["offsets"]) - 1, cell["lists"], cell["first"]
    peak = np.zeros(queries.size, dtype=np.int64)
    peak[lists] = cell["peak"]
    place = np.full(queries.size, -1, dtype=np.int64)
    place[lists] = np.arange(len(lists))
    blocks = -(-np.diff(first) // BLOCK_POSTINGS)
    width = np.array([queries.width(t) for t in lists.tolist()], dtype=np.int64)
    at = np.cumsum(blocks * width) - blocks * width
    summary, exact = np.frombuffer(cell["summary"], np.uint8), None
    part = np.concatenate([[0], np.cumsum(peak[queries.flat] * queries.weight[queries.flat])])
    reach = part[queries.first[1:]] - part[queries.first[:-1]]
    for q in np.flatnonzero(reach >= best.floor).tolist():
        floor, own = best.floor[q], queries.terms[q]
        rest, found = reach[q], []
        for t in own.tolist():
            if rest < floor:
                break  # what only the lighter terms hold stays below
            i = place[t]
            if i < 0:
                continue
            rest -= peak[t] * queries.weight[t]
            columns, weight, bare = queries.columns(q, t)
            table = summary[at[i]: at[i] + blocks[i] * width[i]].reshape(blocks[i], width[i])
            bound = (table[:, columns].astype(np.int64) @ weight) * STEP + peak[bare] @ queries.weight[bare]
            lo, hi = first[i], first[i + 1]
            if (bound >= floor).all():
                found.append(cell["postings"][lo:hi])
            else:
                for k in np.flatnonzero(bound >= floor).tolist():
                    found.append(cell["postings"][lo + k * BLOCK_POSTINGS: min(hi, lo + (k + 1) * BLOCK_POSTINGS)])
        if not found:
            continue
        if exact is None:
            exact = np.zeros((docs, queries.size), dtype=np.int32)
            exact[np.repeat(np.arange(docs), np.diff(cell["offsets"])), cell["terms"]] = cell["impacts"]
        some = np.unique(np.concatenate(found))
        score = exact[np.ix_(some, own)].astype(np.int64) @ queries.weight[own]
        good = score >= floor
        if good.sum() > best.rows:  # only ids are compared beyond this: leave what is below the cell's own last score
            good &= score >= np.partition(score[good], -best.rows)[-best.rows]
        if good.any():
            best.offer(q, score[good], [cell["ids"][int(i)].as_py() for i in some[good]])


def _searched(index: DataFrame, sent, floor: np.ndarray, rows: int, kind: str) -> DataFrame:
    """(query, score, id): the best rows of each query among the cells of each task, with ``floor`` at least."""
    spark = index.sparkSession
    floors = spark.sparkContext.broadcast(floor.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = pickle.loads(sent.value)
        best = Best(np.frombuffer(floors.value, np.int64), rows)
        for b in batches:
            for i in range(b.num_rows):
                cell = {name: np.asarray(b.column(name)[i].values) for name in ("offsets", "terms", "impacts", "lists", "first", "peak", "postings")}
                _search_cell(cell | {"ids": b.column("ids")[i].values, "summary": b.column("summary")[i].as_py()}, queries, best)
        ids = index_type
        for q, (score, names) in best.kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), queries.numbers[q], np.int64)), pa.array(score.astype(np.int64)), pa.array(names, ids)], names=["query", "score", "id"])

    from pyspark.sql.pandas.types import to_arrow_type

    index_type = to_arrow_type(index.schema["ids"].dataType.elementType)
    return index.mapInArrow(run, f"query long, score long, id {kind}")


def ranked_search(docs: DataFrame, items: DataFrame, rows: int = 50, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each row of ``items`` the ``rows`` documents with the highest scores above 0: item id, rank, document id, score.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case, of whole texts. A document's
    impact of a term with tf occurrences is (1000000000 tf) div (1000 tf + 20 m), with m = 50 + (50 n N) div L from its n
    terms, the N documents with terms and their L terms; a term's weight floor(1000 ln((2N + 2) / (2 df + 1))); the score
    sums weight times impact over the item's distinct terms. Equal scores go by ascending document id, NULL ids last.

    NULL and empty texts hold no term, and items without one have no row; repeated rows are documents, and items, of their
    own; other columns are ignored; an empty table on either side gives an empty result.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    asked = query_terms(items, item_id_col, item_text_col).filter(F.size("terms") > 0)
    total = asked.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // QUERY_TERMS))
    found = [_search_block(docs, asked.filter(F.pmod("query", F.lit(blocks)) == k), rows, id_col, text_col, kind) for k in range(blocks)]
    best = found[0]
    for f in found[1:]:
        best = best.unionByName(f)
    named = best.join(asked.select("query", F.col("id").alias(item_id_col)), "query")
    out = named.select(F.col(item_id_col).cast(item_kind).alias(item_id_col), "rank", F.col("id").alias(id_col), "score")
    return out if id_col != item_id_col else out.toDF(item_id_col, "rank", f"found_{id_col}", "score")


def _order() -> list:
    return [F.col("score").desc(), F.col("id").asc_nulls_last()]


def _search_block(docs: DataFrame, asked: DataFrame, rows: int, id_col: str, text_col: str, kind: str) -> DataFrame:
    spark = docs.sparkSession
    # about QUERY_TERMS hashes: see query blocks
    given = asked.select("query", "terms").orderBy("query").toArrow()
    numbers = given.column("query").to_pylist()
    terms = [np.array(t, dtype=np.int64).view(U64) for t in given.column("terms").to_pylist()]
    vocabulary = np.unique(np.concatenate([*terms, np.zeros(0, U64)]))
    vectors = term_vectors(docs, vocabulary, id_col, text_col)
    documents, length, postings = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0))).first()
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    held = held.select("term", F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1).cast("double"))).alias("w")).toArrow()
    weight = np.zeros(len(vocabulary), dtype=np.int64)
    weight[held.column("term").to_numpy()] = held.column("w").to_numpy()
    queries = Queries(numbers, [np.searchsorted(vocabulary, t) for t in terms], weight)
    sent = spark.sparkContext.broadcast(pickle.dumps(queries))
    index = build_index(vectors, queries, sent, documents, length, postings)
    start = np.ones(len(numbers), dtype=np.int64)
    scouted = handed(_searched(index.filter("scout"), sent, start, rows, kind), "search-scouts")
    first = first_rows(scouted, "query", _order(), rows, ["id", "score"], scouted.count())
    last = {r["query"]: r["score"] for r in first.filter(F.col("rank") == rows).select("query", "score").collect()}
    floor = np.array([last.get(n, 1) for n in numbers], dtype=np.int64)
    others = handed(_searched(index.filter("not scout"), sent, floor, rows, kind), "search-found")
    every = scouted.unionByName(others)
    return first_rows(every, "query", _order(), rows, ["id", "score"], every.count())
