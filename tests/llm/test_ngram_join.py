"""N-gram join (3) against all pairs on whole small tables."""

import random
import re

import pytest

from tests.conftest import SF0001
from tests.llm.conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    ids = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(n)] = min(ids.get(find(n), i), i)
    return sorted(str((i, len(sets[n]), ids.get(find(n)) if sets[n] else i)) for n, (i, _) in enumerate(rows))


def near_copies(seed, groups, copies, edits):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, edits)):
                k = rng.randrange(len(w))
                w[k:k + 1] = rng.choice([[], [w[k], "new"], [f"x{rng.randrange(99)}"], [w[k].upper()]])
            out.append(" ".join(w))
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


def found(spark, rows):
    from hourwise.llm.ngram_join import ngram_components

    return sorted(str(tuple(r)) for r in ngram_components(frame(spark, rows)).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    rows = near_copies(seed, 25, 14, 5)
    assert found(spark, rows) == brute(rows)


def test_small_blocks_and_chains(spark, monkeypatch):
    from hourwise.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_ENTRIES", 300)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    chain = [" ".join(f"c{k}" for k in range(2 * i, 2 * i + 40)) for i in range(30)]  # each links with its neighbours only
    rows = near_copies(3, 10, 12, 9) + [(1000 - i, t) for i, t in enumerate(chain)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark, texts):
    rows = texts + [(50, "a b c d"), (51, "A B C D"), (52, "a b c"), (53, "the quick"), (None, "the quick"), (None, "THE QUICK")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_documents_table(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows)
