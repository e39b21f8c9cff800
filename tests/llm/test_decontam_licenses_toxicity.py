"""Decontamination (2) against all windows, licence scans (4), toxicity (5)."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from hourwise.llm import catalog
from tests.conftest import SF001, SF0001
from tests.llm.conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _grams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def _similar(a, b):
    a, b = collections.Counter(a), collections.Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def _brute(docs, items):
    out = {}
    for i, t in docs:
        g = _grams(t)
        for k, x in items:
            own = _grams(x)
            if not own or not g:
                continue
            width = min(len(own), len(g))
            best = max(_similar(g[a:a + width], own) for a in range(len(g) - width + 1))
            if best >= 0.75:
                out[i, k] = best
    return out


def _passages(seed):
    rng = random.Random(seed)
    items = [(k, " ".join(f"v{rng.randrange(400)}" for _ in range(rng.randrange(4, 60)))) for k in range(25)]
    docs = []
    for i in range(60):
        w = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(0, 3)):
            own = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(own))
                own[k:k + 1] = rng.choice([[], ["edited"], [own[k], "more"], [own[k].upper()]])
            a = rng.randrange(len(w) + 1)
            w[a:a] = own
        docs.append((i, " ".join(w)))
    return docs, items


@pytest.mark.parametrize("part_words", [1_000_000, 300])
def test_leaks_equal_all_windows(spark, part_words):
    from hourwise.llm.decontam import find_leaks

    docs, items = _passages(5)
    docs += [(100, items[3][1]), (101, " ".join(items[3][1].split()[1:])), (102, None), (103, "a b c"), (None, items[4][1])]
    got = find_leaks(frame(spark, docs), frame(spark, items + [(90, None), (91, "one two")], "item_id long, text string"), part_words=part_words).collect()
    want = _brute(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r["similarity"] - want[r["doc_id"], r["item_id"]]) < 1e-9 for r in got)
    by = dict(docs)
    for r in got:
        w = WORD.findall(by[r["doc_id"]])[r["word_start"]: r["word_end"]]
        assert abs(_similar(_grams(" ".join(w)), _grams(dict(items)[r["item_id"]])) - r["similarity"]) < 1e-9


def test_leaks_of_documents(spark, texts):
    from hourwise.llm.decontam import find_leaks

    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in catalog.queries()["op2_decontamination"](spark, SF001).collect()}
    whole = {(i, k) for i, t in docs for k, x in items if x in t}
    assert whole and whole <= got
    near = {(i, k) for i, k in got - whole if _similar([g for g in _grams(dict(docs)[i]) if g in set(_grams(dict(items)[k]))], _grams(dict(items)[k])) < 0.7}
    assert not near
    benchmark = frame(spark, items, "item_id long, text string")
    assert find_leaks(frame(spark, texts), benchmark).count() == 0
    assert find_leaks(frame(spark, []), benchmark).count() == 0 and find_leaks(frame(spark, docs[:5]), benchmark.limit(0)).count() == 0


def test_hamming_blocks_miss_nothing():
    from hourwise.llm.decontam import RADIUS, near_fingerprints

    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (300, 8)).astype(np.uint16)
    b = a[rng.integers(0, 300, 200)].copy()
    for row in b:
        for k in rng.choice(128, rng.integers(0, 60), replace=False):
            row[k // 16] ^= np.uint16(1 << (k % 16))
    d = np.bitwise_count(a[:, None] ^ b[None]).sum(2)
    assert set(zip(*near_fingerprints(a, b))) == set(zip(*np.nonzero(d <= RADIUS)))


NOTICE = re.compile(r"Released under the MIT License\.|Licensed under the Apache License, Version 2\.0\.|GNU General Public License, version 3\.|Licensed under CC BY-NC 4\.0\.")


def test_licences(spark, texts):
    from hourwise.llm.licenses import LicenceClassifier, scan_licences

    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    classifier = LicenceClassifier(docs)
    rows = [(r[0], r[1]) for r in docs.collect()]
    got = scan_licences(docs, classifier).collect()
    want = {(i, k) for i, t in rows for k, x in enumerate(t.split("\n")) if NOTICE.search(x)}
    assert {(r["doc_id"], r["paragraph"]) for r in got} == want and want
    plans = scan_licences(docs, classifier)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plans)
    odd = texts + [(60, "code\nMy library: Licensed under the Apache License, Version 2.0, since 2019\n"), (61, "the license of a bar"),
                   (62, "This work is licensed under the GNU General Public License, version 2."), (63, "LICENSED UNDER CC BY-NC 4.0")]
    found = {(r["doc_id"], r["paragraph"]): r["family"] for r in scan_licences(frame(spark, odd), classifier).collect()}
    assert found == {(60, 1): "Apache-2.0", (62, 0): "GPL-2.0", (63, 0): "CC-BY-NC"}
    assert scan_licences(frame(spark, []), classifier).count() == 0
    assert scan_licences(frame(spark, odd), LicenceClassifier(frame(spark, []))).count() >= 0


def test_wrapped_licences(spark):
    """Every template, wrapped at 35 to 80 columns behind comment marks, between other lines."""
    import textwrap

    from hourwise.llm.licenses import TEMPLATES, LicenceClassifier, scan_licences

    classifier = LicenceClassifier(spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text"))
    rows, want = [], {}
    for k, (family, text) in enumerate(TEMPLATES):
        for width in (35, 60, 72, 80):
            for m, mark in enumerate(("", "# ", " * ")):
                lines = textwrap.wrap(text, width, initial_indent=mark, subsequent_indent=mark)
                if len(lines) > 1:
                    rows.append((1000 * k + 10 * width + m, "\n".join(["int main", "a line of code before it", *lines, "and one after", "", "the end"])))
                    want[rows[-1][0]] = (family, range(2, 2 + len(lines)))
    found = {}
    for r in scan_licences(frame(spark, rows), classifier).collect():
        found.setdefault(r["doc_id"], []).append((r["family"], r["paragraph"]))
    assert len(want) > 60 and set(found) == set(want), [want[i] for i in set(want) - set(found)]
    assert all(f == want[i][0] and p in want[i][1] for i, v in found.items() for f, p in v), [(want[i], v) for i, v in found.items() if any(f != want[i][0] or p not in want[i][1] for f, p in v)]
    twice = [(1, rows[-1][1]), (1, rows[-1][1]), (None, rows[-1][1])]
    assert scan_licences(frame(spark, twice), classifier).count() == 3


def test_toxicity(spark, texts):
    from hourwise.llm.toxicity import drop_toxic, score_toxicity, toxicity_model

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity_model(docs, labels)
    insult = re.compile("loser|idiot|pathetic|scum|worthless|moron|trash|clown|disgusting|stupid", re.I)
    out = score_toxicity(docs, model).join(labels.join(docs, "doc_id"), "doc_id").filter("lang = 'en'").collect()
    out = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert all(r["predicted"] == bool(insult.search(r["text"])) for r in out) and sum(r["predicted"] for r in out) > 20
    # in every language, on rows that nothing was learned from
    held = [r for r in score_toxicity(docs, model).join(labels.join(docs.select("doc_id", "lang"), "doc_id"), "doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["toxic"] is not None]
    for lang in ("en", "de", "fr", "es"):
        toxic, clean = ([r["predicted"] for r in held if r["lang"] == lang and r["toxic"] == y] for y in (1, 0))
        assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.02 * len(clean), (lang, sum(toxic), len(toxic), sum(clean), len(clean))
    odd = score_toxicity(frame(spark, texts + [(70, "you id.i-ot"), (71, "such an i d i o t he is"), (72, "a nice day")]), model).collect()
    assert len(odd) == len(texts) + 3
    by = {r["doc_id"]: r["predicted"] for r in odd}
    assert (by[70], by[71], by[72], by[2], by[3], by[4]) == (1, 1, 0, 0, 0, 0)
    kept = drop_toxic(frame(spark, [(70, "you idiot", 5), (72, "a nice day", 6)], "doc_id long, text string, score int"), model).collect()
    assert [tuple(r) for r in kept] == [(72, "a nice day", 6)]
    none = toxicity_model(frame(spark, []), labels)
    assert {r["score"] for r in score_toxicity(frame(spark, texts), none).collect()} == {0.0}


def test_kernel_tolerates_gaps():
    """The summed triple weights equal the kernel by enumeration, over words with their mark (written as a backtick)."""
    from itertools import combinations

    import pyarrow as pa

    from hourwise.llm.arrays import pieces
    from hourwise.llm.toxicity import DECAY, SPAN, letter_words, margins

    def features(word):
        out = collections.Counter()
        for i, j, k in combinations(range(len(word)), 3):
            if k - i < SPAN:
                out[word[i], word[j], word[k]] += DECAY ** (k - i - 2)
        return out

    def kernel(a, b):
        x, y = features(a), features(b)
        norm = lambda w: sum(DECAY ** (2 * (k - i - 2)) for i, _, k in combinations(range(len(w)), 3) if k - i < SPAN) ** 0.5
        return sum(x[t] * y[t] for t in x) / norm(a) / norm(b)

    weights = np.zeros(1 << 18, dtype=np.float32)
    norm = sum(DECAY ** (2 * (k - i - 2)) for i, _, k in combinations(range(6), 3)) ** 0.5
    for (a, b, c), v in features("`idiot").items():
        weights[(ord(a) - 96) << 12 | (ord(b) - 96) << 6 | (ord(c) - 96)] += v / norm
    words = ["idiot", "idxiot", "idiotic", "patriot", "zzzzzzzz", "theidiotwas"]
    (p,) = pieces(pa.array([" ".join(words)]))
    letters, start, end, _ = letter_words(p)
    assert np.allclose(margins(letters, start, end, weights), [kernel("`" + w, "`idiot") for w in words], atol=1e-5)


def test_windows_with_repeated_shingles_are_found(spark):
    """A passage with its end cut, followed by a run of one word: each window repeats a shingle, similarity 0.75 or more."""
    from hourwise.llm.decontam import Items, find_leaks

    rng = np.random.default_rng(8)
    docs, items = [], []
    for k in range(20):
        words = [f"p{k}x{j}" for j in rng.permutation(104)]
        items.append((k, " ".join(words)))
        docs.append((k, " ".join(words[:90] + ["filler"] * 18 + [f"own{k}"])))
        docs.append((100 + k, " ".join(words[:60] + ["filler"] * 60)))  # too little of it
    got = find_leaks(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()

    def best(doc, item):
        grams = lambda w: collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        a, out = grams(item), 0.0
        for i in range(max(1, len(doc) - len(item) + 1)):
            b = grams(doc[i:i + len(item)])
            out = max(out, sum((a & b).values()) / sum((a | b).values()))
        return out

    want = {(d, i) for d, t in docs for i, x in items if d % 100 == i and best(t.split(), x.split()) >= 0.75}
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) == 20
    assert Items([1], ["a b c d e"]).most.tolist() == [1]
    small = find_leaks(frame(spark, docs[:1]), frame(spark, items[:1], "item_id smallint, text string")).collect()
    assert [r["item_id"] for r in small] == [0]
