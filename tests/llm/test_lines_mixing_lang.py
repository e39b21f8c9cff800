"""Line dedup (9), mixing (8), language identification (7)."""

import collections
import hashlib

import duckdb
import numpy as np

from hourwise.llm import catalog
from tests.conftest import SF0001, SF001
from tests.llm.conftest import frame

BLANKS = " \t\n\x0b\x0c\r"


def _kept(rows, least, docs):
    key = lambda x: x.strip(BLANKS).encode().lower().decode()
    holders = collections.defaultdict(set)
    for n, (i, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(n)
    bad = {k: max(rows[n][0] if rows[n][0] is not None else -(1 << 63) for n in v) for k, v in holders.items() if len(v) >= docs}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in bad or bad[key(x)] == (i if i is not None else -(1 << 63))]
        yield (i, "\n".join(stay), len(lines), len(lines) - len(stay))


def test_line_dedup_odd_rows(spark, texts):
    from hourwise.llm.line_dedup import drop_repeated_lines

    common = "  A common line of more than forty code points, é.\t"
    rows = texts + [(40 + i, f"own {i}\n{common}\n{common.upper().replace('É', 'é')}\nshort") for i in range(6)] + [(45, common), (None, common)]
    src = frame(spark, [(i, t, 7) for i, t in rows], "doc_id long, text string, n_lines int")
    got = drop_repeated_lines(src).collect()
    assert sorted(map(str, _kept(rows, 40, 5))) == sorted(str((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"])) for r in got)
    assert drop_repeated_lines(frame(spark, [])).count() == 0


def test_line_dedup_many_rounds(spark, monkeypatch):
    from hourwise.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    monkeypatch.setattr(line_dedup, "ROUND_BYTES", 2 * 3 * line_dedup.KEY_BYTES)
    rows = [(d, "\n".join(f"line number {(d * 7 + k) % 50} that is long enough" for k in range(10))) for d in range(40)]
    got = line_dedup.drop_repeated_lines(frame(spark, rows), 20, 5).collect()
    assert sorted(map(str, _kept(rows, 20, 5))) == sorted(str((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"])) for r in got)


def test_perfect_hash():
    from hourwise.llm.line_dedup import PerfectHash

    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 64, 50_000, dtype=np.uint64))
    h = PerfectHash.build(keys)
    h = PerfectHash.from_bytes(len(h.levels), h.to_bytes())
    assert sorted(h.place(keys)) == list(range(len(keys)))


def test_line_dedup_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    want = con.execute(catalog.oracle_sql()["op9_line_dedup"]).fetchall()
    got = catalog.queries()["op9_line_dedup"](spark, SF001).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(want) == sorted(map(tuple, got)) and sum(r[2] for r in want) > 0
    one = next(r for r in got if r["n_dropped"] == 0)
    text = spark.read.parquet(f"{SF001}/documents.parquet").filter(f"doc_id = {one['doc_id']}").first()["text"]
    assert one["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def _targets(sizes):
    """Shares by weight, the excess over three times a source's size dealt again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
        open_ -= set(over)
        left -= sum(target[s] for s in over)
    return target


def test_mixing(spark, texts):
    from hourwise.llm.mixing import mix_sources, _permuted

    for n in (1, 2, 3, 7, 1000, 4096, 4097):
        assert sorted(_permuted(np.arange(n), n, 12345)) == list(range(n))
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 900))), [None, "b", "a", "Z", "é", "hot", "hot", "hot"][i % 8]) for i in range(400)]
    rows += [(900, "x " * 50, "tiny"), (901, None, "none"), (902, "", "b"), (900, "x " * 50, "tiny")]
    df = frame(spark, rows, "doc_id long, text string, source string")
    docs, pieces, slots = mix_sources(df, block=16, shard_slots=64)
    got = docs.collect()
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(df.repartition(5), block=16, shard_slots=64)[0].collect()))
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, len((t or "").split())) for i, t, _ in rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = _targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 16 + 16 * 3 for s in sizes)
    filled = slots.collect()
    assert len({(r["source_key"], r["block"], r["epoch"]) for r in filled}) == len(filled) and max(r["epoch"] for r in filled) <= 2
    assert len({r["shard"] for r in filled}) > 1
    assert mix_sources(df.limit(0))[0].count() == 0
    empty = mix_sources(frame(spark, [(1, None, None)], "doc_id long, text string, source string"))[0].collect()
    assert [tuple(r) for r in empty] == [(1, None, 0, 0, 0.0, 0)]


def test_languages(spark, texts):
    from hourwise.llm.langid import document_frequencies, identify, language_model, BITS, ORDERS
    from hourwise.llm.samples import held_out

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = catalog.queries()["op7_language_id"](spark, SF001).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    import zlib
    ids = docs.select("doc_id", held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in ids)
    odd = {r["doc_id"]: r for r in identify(frame(spark, texts), language_model(docs)).collect()}
    assert [odd[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and odd[5]["lang_pred"] != "und"
    bare = language_model(frame(spark, [], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in identify(frame(spark, texts), bare).collect()} == {"und"}
    small = document_frequencies(frame(spark, [(1, "ab"), (2, "ab ab"), (3, None), (4, "")]))
    assert small[-1] == 4 and small[: 1 << BITS].max() == 2 and len(small) == (len(ORDERS) << BITS) + 1
