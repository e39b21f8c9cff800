"""Ranked lexical search (12) against brute force and DuckDB."""

import collections
import math
import re

import duckdb
import numpy as np
import pytest

from hourwise.llm import catalog, ranked_search
from tests.conftest import SF001
from tests.llm.conftest import frame

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(docs, items, rows):
    held = [(i, collections.Counter(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i, s))
        out += [(item, k + 1, i, s) for k, (_, _, i, s) in enumerate(sorted(scored)[:rows])]
    return sorted(map(str, out))


def corpus():
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(60)] + ["é", "Über", "中文", "x1y2"]
    zipf = 1 / np.arange(1, len(words) + 1)
    docs = [(k, " ".join(rng.choice(words, size=rng.integers(1, 60), p=zipf / zipf.sum()))) for k in range(300)]
    docs += [(1000 - k, "the same, w50 W50 w51!") for k in range(70)] + [(400, None), (401, ""), (402, " .,- "), (None, "w50 w51 no id"), (5, "w52 repeated id"), (5, "w52 repeated id")]
    docs += [(403, "w53 " * 4000 + "w54")]
    items = [(k, " ".join(rng.choice(words, size=8))) for k in range(12)]
    return docs, items + [(50, None), (51, ""), (52, "nowhere to be found"), (3, "w50 w51"), (None, "W52, ÜBER über."), (53, " ".join(words))]


def found(spark, docs, items, rows, parts=3):
    src = frame(spark, [(i, t, 1, 2.0, "x") for i, t in docs], "doc_id long, text string, rank int, score double, item_id string").repartition(parts)
    ask = frame(spark, [(i, t, 1) for i, t in items], "item_id long, text string, query long")
    return sorted(str(tuple(r)) for r in ranked_search.ranked_search(src, ask, rows).select("item_id", "rank", "doc_id", "score").collect())


def test_equals_brute_force(spark):
    docs, items = corpus()
    assert found(spark, docs, items, 50) == brute(docs, items, 50)


@pytest.mark.parametrize("change", [{"QUERY_TERMS": 30}, {"SUMMARY_WIDTH": 2}])
def test_more_blocks_of_queries_and_narrow_summaries(spark, monkeypatch, change):
    docs, items = corpus()
    for k, v in change.items():
        monkeypatch.setattr(ranked_search, k, v)
    assert found(spark, docs, items, 7, 2) == brute(docs, items, 7)


def test_empty_tables(spark):
    docs, items = corpus()
    assert found(spark, [], items, 5) == [] and found(spark, docs, [], 5) == [] and found(spark, [(1, None)], [(1, "")], 5) == []
    text = ranked_search.ranked_search(frame(spark, [("b", "w1"), ("a", "w1"), ("c", "other words here")], "doc_id string, text string"), frame(spark, [("i", "w1")], "item_id string, text string"), 2)
    assert [(r["rank"], r["doc_id"]) for r in text.orderBy("rank").collect()] == [(1, "a"), (2, "b")]


def test_blocks_are_skipped_and_nothing_is_lost(monkeypatch):
    """One cell of clustered documents: blocks below the threshold aren't scored, those above are all found."""
    rng = np.random.default_rng(3)
    import pyarrow as pa

    v, docs = 200, 640
    monkeypatch.setattr(ranked_search, "BLOCK_POSTINGS", 8)
    held = [np.unique(np.concatenate([rng.choice(20, 8) + 20 * (d * 10 // docs), [190 + d % 10]])) for d in range(docs)]
    off = np.cumsum([0, *(len(x) for x in held)])
    flat = np.concatenate(held)
    impact = rng.integers(1, 1_000_000, len(flat))
    weight = rng.integers(0, 9000, v)
    asked = [np.unique(np.concatenate([rng.choice(20, 5) + 20 * (q % 10), rng.choice(v, 2)])) for q in range(20)]
    queries = ranked_search.Queries(list(range(20)), asked, weight)
    cell = ranked_search._blocked(off, flat, impact, queries) | {"offsets": off, "terms": flat, "impacts": impact, "ids": pa.array(np.arange(docs))}
    exact = np.zeros((docs, v), dtype=np.int64)
    exact[np.repeat(np.arange(docs), np.diff(off)), flat] = impact
    scored = []
    offer = ranked_search.Best.offer
    monkeypatch.setattr(np, "unique", lambda x, f=np.unique, **k: (scored.append(len(y := f(x, **k))), y)[1])
    monkeypatch.setattr(ranked_search.Best, "offer", offer)
    for floor_rank in (1, 10):
        full = {q: np.sort(exact[:, t] @ weight[t])[::-1] for q, t in enumerate(asked)}
        floor = np.array([max(1, full[q][floor_rank]) for q in range(20)])
        best = ranked_search.Best(floor, 10)
        scored.clear()
        ranked_search._search_cell(cell, queries, best)
        for q in range(20):
            want = [s for s in full[q][:10] if s >= floor[q]]
            assert best.kept.get(q, (np.zeros(0), []))[0].tolist()[:len(want)] == want
    assert 0 < sum(scored) < 0.35 * docs * 20


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF001}/{name}.parquet'")
    got = catalog.op12_ranked_search(spark, SF001)
    names = sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(con.sql(f"select {', '.join(names)} from ({catalog.OP12_SQL})").fetchall())
