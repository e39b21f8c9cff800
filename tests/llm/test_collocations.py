"""Phrase collocations (13) against brute force and DuckDB."""

import collections
import re

import duckdb

from hourwise.llm import catalog
from hourwise.llm.collocations import PhraseCounts, collocations
from tests.conftest import SF001
from tests.llm.conftest import frame

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows, longest):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i:i + m])] += 1
    return f, n


def brute(rows, least, longest, top, covered=50):
    f, n = counts(rows, longest)
    known = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in known.items():
        inside = [c for (other, q), c in known.items() if other == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * c >= covered * a for c in inside):
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for k, (s, a, p, l, r) in enumerate(sorted(v)[:top]))


ROWS = ([("en", f"New York City is big. new  york\tcity; NEW YORK; item {k} a a a a") for k in range(12)]
        + [(None, "sans langue ici, sans langue là")] * 6 + [("und", "sans langue ici")] * 5 + [("de", None), ("de", ""), ("fr", " \t\n"), (None, None)]
        + [("en", "de es"), ("de", "en es"), ("es", "en de")] * 11
        + [("fr", "é été É,é été É " * 9 + "x" * 5000 + " a\x0bb c\x0cd " * 11), ("en", "long " * 3000 + "tail end " * 20)])


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_equals_brute_force(spark, monkeypatch):
    src = frame(spark, [(lang, text, 1, "clash", 2.0) for lang, text in ROWS], "lang string, text string, n int, phrase string, rank double").repartition(3)
    assert rows_of(collocations(src, 10, 3, 2000)) == brute(ROWS, 10, 3, 2000)
    # few slots (all phrases collide), short chunks, other lengths, ties cut at the top
    from hourwise.llm import collocations as module

    monkeypatch.setattr(module, "WORDS_AT_ONCE", 7)
    monkeypatch.setattr(module, "PIECE_BYTES", 300)
    assert rows_of(collocations(src, 3, 4, 3, shards=2, slots=16)) == brute(ROWS, 3, 4, 3)
    assert rows_of(collocations(src, 5, 2, 4, shards=5, slots=1 << 10)) == brute(ROWS, 5, 2, 4)


def test_empty_tables(spark):
    assert collocations(frame(spark, [], "lang string, text string")).count() == 0
    assert collocations(frame(spark, [(None, None), ("en", "")], "lang string, text string")).count() == 0


def test_lengths_are_interleaved_and_each_has_one_cycle(spark):
    rows = [("en", "one two three four"[: 4 + 5 * (k // 4 % 4)] + ".") for k in range(800)]
    found = PhraseCounts(frame(spark, rows, "lang string, text string"), 10, 3, shards=4, slots=1 << 12)
    f, n = counts(rows, 3)
    got = collections.Counter((r["k"], r["f"]) for r in found.table.collect())
    assert got == collections.Counter([(len(p), c) for (_, p), c in f.items() if c >= 10] + [(0, n["en"])])
    # words reach the threshold in the first scan, pairs in the second: three words end after six scans, not twelve
    assert len(found.steps) == 6 and found.steps[0][2][1] > 0 and found.steps[1][2][2] > 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF001}/documents.parquet'")
    got = catalog.op13_collocations(spark, SF001)
    names = sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(con.sql(f"select {', '.join(names)} from ({catalog.OP13_SQL})").fetchall())
