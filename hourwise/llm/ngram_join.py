"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence (operator 3).

The incidence matrix is cut into column blocks (ranges of n-gram hashes); a map task sends each block the part of its
documents as packed arrays. A block's task finds its n-grams that two or more distinct sets share; n-grams of one set
can't add to any overlap and end there. What is left is dealt by row: a set whose shared n-grams are fewer than its
bound (75 % of its own size) can't reach the similarity with any other and ends there too. The rows that survive are
multiplied: overlaps of two rows are accumulated over their shared n-grams, for pairs that meet in the rarest n-grams
of both (the prefix that the bound leaves) and whose sizes allow the similarity.

Groups of near copies are not expanded into all pairs: rounds compare each row with one pivot of each of its prefix
n-grams and join what is linked; the last round compares all pairs that meet and aren't joined yet, if the n-grams
that both have from there on suffice for the overlap that their sizes ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.llm.arrays import FOLDED_BYTE, U64, Piece, lean, lean_group, mix, pieces, span_hashes, sums, windows, words
from hourwise.llm.components import components
from hourwise.llm.store import handed

GRAM = 5
#: Similarity: 100 * overlap >= PERCENT * union.
PERCENT = 75
#: Entries of the incidence matrix in a column block on average, and rows of a row block.
BLOCK_ENTRIES, BLOCK_ROWS = 2_500_000, 20_000
#: Entries that a map task holds before it sends them on.
HELD_ENTRIES = 1_000_000
PIVOT_ROUNDS = 1
#: Sets whose numbers are broadcast at most; more go by a shuffle join.
BROADCAST_SETS = 500_000


def gram_sets(p: Piece, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows, size by row): each text's distinct n-grams of A-Z lower-cased words, ordered by row and hash.

    A text with fewer words gives its whole sequence; one without words gives nothing."""
    w = words(p)
    h, first = windows(span_hashes(p.buf, w.start, w.end, FOLDED_BYTE), w.first, gram, whole=True)
    row = np.repeat(np.arange(p.rows, dtype=np.int32), np.diff(first))
    order = np.argsort(h)
    if p.rows < 1 << 16:
        order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(row[order], kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, row, np.bincount(row, minlength=p.rows)


def signatures(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit signature of each row's set."""
    first = np.concatenate([[0], np.cumsum(size)])
    total = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum(mix(h), out=total[1:])
    return mix((total[first[1:]] - total[first[:-1]]) ^ (size.astype(U64) * U64(0xD6E8FEB86659FD93)))


def needed(size: np.ndarray) -> np.ndarray:
    """Least overlap of a set of this size with any other that reaches the similarity."""
    return -(-PERCENT * size // 100)


def _pack40(keys: np.ndarray) -> bytes:
    """The low 40 bits of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


BLOCK = "block int, nodes binary, sizes binary, counts binary, grams binary"


def _blocks(of: np.ndarray, n_blocks: int, owner: np.ndarray, grams: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, extra: np.ndarray | None = None):
    """Entries (owner: index into ``nodes``; ordered by it) dealt to blocks: one packed row for each block."""
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(n_blocks + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        at = order[bounds[k]: bounds[k + 1]]
        mine, count = np.unique(owner[at], return_counts=True)
        row = {"block": int(k), "nodes": nodes[mine].tobytes(), "sizes": sizes[mine].astype(np.uint32).tobytes(),
               "counts": count.astype(np.uint32).tobytes(), "grams": _pack40(grams[at])}
        yield row if extra is None else row | {"shared_by": extra[at].astype(np.uint32).tobytes()}


def document_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node) for every row; ``node`` is the signature of its set, NULL if that is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b.column(1)):
                h, _, size = gram_sets(p)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(p.lo, p.rows), pa.array(size.astype(np.int64)), pa.array(signatures(h, size).view(np.int64), mask=size == 0)],
                    names=["doc_id", "n_shingles", "node"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"doc_id {kind}, n_shingles long, node long")


def _column_blocks(docs: DataFrame, text_col: str, n_blocks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a set's copies in this task are sent once
        grams, owner, nodes, sizes, n, held = [], [], [], [], 0, 0

        def packed() -> pa.RecordBatch:
            h = np.concatenate(grams)
            of = (h >> U64(40)) % U64(n_blocks)
            rows = list(_blocks(of.astype(np.int32), n_blocks, np.concatenate(owner), h, np.concatenate(nodes), np.concatenate(sizes)))
            return pa.RecordBatch.from_pylist(rows, schema=_arrow(False))

        for b in batches:
            for p in pieces(b.column(0)):
                h, row, size = gram_sets(p)
                node = signatures(h, size)
                new = np.zeros(p.rows, dtype=bool)
                for r in np.flatnonzero(size):
                    if (x := int(node[r])) not in seen:
                        seen.add(x)
                        new[r] = True
                use = new[row]
                number = (np.cumsum(new) - 1 + n).astype(np.int32)
                grams.append(h[use])
                owner.append(number[row[use]])
                nodes.append(node[new])
                sizes.append(size[new])
                n += int(new.sum())
                held += int(use.sum())
                if held >= HELD_ENTRIES:
                    yield packed()
                    grams, owner, nodes, sizes, n, held = [], [], [], [], 0, 0
        if held:
            yield packed()

    return docs.select(text_col).mapInArrow(lean(run), BLOCK)


def _arrow(shared: bool) -> pa.Schema:
    fields = [("block", pa.int32()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())]
    return pa.schema(fields + [("shared_by", pa.binary())] * shared)


def _entries(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, sizes, entries by node) of packed rows, one after the other."""
    return (np.concatenate([np.frombuffer(x, U64) for x in group["nodes"]]), np.concatenate([np.frombuffer(x, np.uint32) for x in group["sizes"]]),
            np.concatenate([np.frombuffer(x, np.uint32) for x in group["counts"]]).astype(np.int64))


def _shared_entries(n_row_blocks: int):
    """A column block's entries whose n-gram two or more sets hold, dealt to row blocks."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        nodes, sizes, counts = _entries(group)
        distinct, one, back = np.unique(nodes, return_index=True, return_inverse=True)
        owner = np.repeat(back, counts).astype(np.int64)
        grams = np.concatenate([_unpack40(x) for x in group["grams"]])
        order = np.lexsort((owner, grams)) if len(distinct) < len(nodes) else np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        del order
        keep = np.ones(len(grams), dtype=bool)  # copies that several tasks sent count once
        keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[keep], owner[keep]
        edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        held = np.diff(np.append(edge, len(grams)))
        by = np.repeat(held, held)
        use = by > 1
        grams, owner, by = grams[use], owner[use], by[use]
        order = np.argsort(owner, kind="stable")
        grams, owner, by = grams[order], owner[order], by[order]
        # the block's number goes into the n-gram again, so that it is one number over all blocks
        grams = grams | (U64(int(group["block"].iloc[0]) & 0xFFFFFF) << U64(40))
        of = (distinct[owner] % U64(n_row_blocks)).astype(np.int32)
        rows = []
        for row in _blocks(of, n_row_blocks, owner, grams, distinct, sizes[one], by):
            rows.append(row | {"column": int(group["block"].iloc[0])})
        return pd.DataFrame(rows, columns=["block", "nodes", "sizes", "counts", "grams", "shared_by", "column"])

    return run


ROW_SCHEMA = "node long, size long, grams array<long>"


def _rows(group: pd.DataFrame) -> pd.DataFrame:
    """Rows of the incidence matrix, only shared n-grams, whose number of these reaches their bound; the rarest
    n-grams first."""
    nodes, sizes, counts = _entries(group)
    distinct, one, back = np.unique(nodes, return_index=True, return_inverse=True)
    size = sizes[one].astype(np.int64)
    total = np.bincount(back, weights=counts, minlength=len(distinct)).astype(np.int64)
    good = total >= needed(size)
    owner = np.repeat(back, counts)
    grams = np.concatenate([_unpack40(x) | (U64(c & 0xFFFFFF) << U64(40)) for x, c in zip(group["grams"], group["column"], strict=True)])
    by = np.concatenate([np.frombuffer(x, np.uint32) for x in group["shared_by"]]).astype(np.int64)
    use = good[owner]
    owner, grams, by = owner[use], grams[use].view(np.int64), by[use]
    order = np.lexsort((grams, by, owner))
    ends = np.cumsum(np.bincount(owner, minlength=len(distinct))[good])[:-1]
    return pd.DataFrame({"node": distinct[good].view(np.int64), "size": size[good], "grams": pd.Series(np.split(grams[order], ends) if good.any() else [], dtype=object)})


def incidence(docs: DataFrame, entries: int, sets: int, text_col: str = "text") -> DataFrame:
    """``ROW_SCHEMA``: one row for each distinct set that can reach the similarity with another."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_columns, n_rows = max(least, -(-entries // BLOCK_ENTRIES)), max(least, -(-sets // BLOCK_ROWS))
    shared = _column_blocks(docs, text_col, n_columns).groupBy("block").applyInPandas(lean_group(_shared_entries(n_rows)), BLOCK + ", shared_by binary, column int")
    return shared.groupBy("block").applyInPandas(lean_group(_rows), ROW_SCHEMA)


def _linked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``pairs`` whose accumulated overlap reaches the similarity."""
    asked = handed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    rows = rows.join(F.broadcast(asked) if asked.count() <= BROADCAST_SETS else asked, "node", "left_semi")
    side = lambda x: rows.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("grams").alias(f"{x}_grams"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    overlap = F.size(F.array_intersect("a_grams", "b_grams"))
    return both.withColumn("overlap", overlap).filter(F.col("overlap") * 100 >= (F.col("a_size") + F.col("b_size") - F.col("overlap")) * PERCENT).select("a", "b")


def set_links(rows: DataFrame) -> DataFrame:
    """(node, component) over the rows of ``incidence``: components of the links at the similarity."""
    # unshared n-grams are the rarest, so of the prefix that the bound leaves they take their number away
    bound = F.col("size") - F.ceil(F.col("size") * PERCENT / 100) + 1 - (F.col("size") - F.size("grams"))
    prefix = handed(rows.select("node", "size", F.size("grams").alias("shared"), F.posexplode(F.slice("grams", 1, bound.cast("int"))).alias("at", "gram")), "prefixes")
    state = handed(rows.select("node", F.col("node").alias("component")), "components")
    # the least overlap of a pair, from both sizes, and the most that their shared n-grams allow
    least = F.ceil((F.col("size") + F.col("p_size")) * PERCENT / (100 + PERCENT))
    fits = (F.col("size") * 100 >= F.col("p_size") * PERCENT) & (F.col("p_size") * 100 >= F.col("size") * PERCENT) & (F.least("shared", "p_shared") >= least)
    # no overlap before the rarest common n-gram: from there on both have to have enough left
    enough = F.least(F.col("shared") - F.col("at"), F.col("p_shared") - F.col("p_at")) >= least
    for k in range(PIVOT_ROUNDS + 1):
        open_ = prefix.join(state, "node") if k else prefix.withColumn("component", F.col("node"))
        # the pivot: at first the row with the fewest n-grams of its own, then any
        rank = F.struct(F.when(F.lit(k == 0), -F.col("shared") / F.col("size")).otherwise(F.lit(0.0)), F.xxhash64(F.lit(k), "node"), "node")
        mixed = open_.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                          F.min_by(F.struct("node", "size", "shared", "component"), rank).alias("p")).filter("low <> high")
        open_ = handed(open_.join(mixed.select("gram", "p"), "gram"), "open")
        if not open_.limit(1).count():
            break
        if k == PIVOT_ROUNDS:
            other = open_.select(F.col("gram").alias("p_gram"), *(F.col(c).alias(f"p_{c}") for c in ("node", "size", "shared", "at", "component")))
            met = open_.drop("p").join(other, (F.col("gram") == F.col("p_gram")) & (F.col("node") < F.col("p_node")) & enough)
        else:
            met = open_.select("node", "size", "shared", "component", *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("node", "size", "shared", "component")))
        pairs = met.filter((F.col("component") != F.col("p_component")) & fits).select(F.col("node").alias("a"), F.col("p_node").alias("b")).distinct()
        links = handed(_linked(handed(pairs, "pairs"), rows), "links")
        if not links.limit(1).count():
            continue
        label = lambda x: state.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component"))
        joined = links.join(label("a"), "a").join(label("b"), "b").select("a_component", "b_component").distinct()
        merged = components(joined, "a_component", "b_component").select(F.col("node").alias("component"), F.col("component").alias("_to"))
        state = handed(state.join(merged, "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "components")
    return state


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when 100 * overlap >= 75 * union of their sets of 5-word shingles (words: runs of anything but
    ASCII white space, A-Z in lower case; fewer words: the whole sequence). component_id is the smallest doc_id
    reachable by links, a document's own included. Texts without words (NULL, empty) link with nothing and carry their
    own doc_id; repeated rows are equal documents; a NULL doc_id counts only where a component has no other; long
    texts are taken whole; an empty table gives an empty result; other columns are ignored.
    """
    sets = handed(document_sets(docs, id_col, text_col), "sets")
    total, n = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("node")).first()
    rows = handed(incidence(docs, total, n, text_col), "incidence")
    # one row for each distinct set, then for each component: no group of copies meets in one task
    classes = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    labelled = classes.join(set_links(rows), "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    found = labelled.join(firsts, "component").select("node", "component_id")
    with_set = sets.filter("node IS NOT NULL").join(found, "node").select("doc_id", "n_shingles", "component_id")
    return with_set.unionByName(sets.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
