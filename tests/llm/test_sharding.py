"""Sharding (11) against the published algorithm, DuckDB and slot rules."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hourwise.llm import catalog
from hourwise.llm.sharding import assign_shards, shard_slots, write_shards
from tests.conftest import SF0001
from tests.llm.conftest import frame


def jump(key: int, shards: int) -> tuple[int, int]:
    at, nxt, mask = -1, 0, (1 << 64) - 1
    key &= mask
    while nxt < shards:
        at = nxt
        key = (key * 2862933555777941757 + 1) & mask
        nxt = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at, nxt


@pytest.mark.parametrize("shards", [1, 2, 40, 41, 3000])
def test_jump_is_the_published_one(spark, shards):
    rnd = random.Random(11)
    keys = [0, 1, -1, -5, 2**63 - 1, -(2**63)] + [rnd.getrandbits(64) - 2**63 for _ in range(200)] + list(range(1000, 1400))
    got = {r["doc_id"]: (r["shard"], r["moves_at"]) for r in assign_shards(frame(spark, [(k,) for k in keys], "doc_id long"), shards).collect()}
    assert got == {k: jump(k, shards) for k in keys}


def test_growth_moves_only_into_the_new_shard(spark):
    rows = {n: {r["doc_id"]: (r["shard"], r["moves_at"]) for r in assign_shards(spark.range(5000).withColumnRenamed("id", "doc_id"), n).collect()} for n in (40, 41, 60)}
    moved = [k for k in rows[40] if rows[40][k][0] != rows[41][k][0]]
    assert all(rows[41][k][0] == 40 and rows[40][k][1] == 40 for k in moved)
    assert 60 < len(moved) < 200
    assert all(rows[60][k][0] == rows[40][k][0] for k in rows[40] if rows[40][k][1] >= 60)
    sizes = collections.Counter(v[0] for v in rows[40].values())
    assert len(sizes) == 40 and max(sizes.values()) < 190


def _check(got, rows, shards):
    assert sorted(map(str, ((r["doc_id"], r["size"], r["text_crc32"]) for r in got))) == sorted(
        str((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for i, t in rows)
    by = collections.defaultdict(list)
    for r in got:
        assert (r["shard"], r["moves_at"]) == jump(r["doc_id"] or 0, shards)
        place = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{r['text_crc32']}".encode())
        by[r["shard"]].append((r["slot"], (place, r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"])))
    for slots in by.values():
        slots.sort()
        assert [s for s, _ in slots] == list(range(len(slots)))
        assert [k for _, k in slots] == sorted(k for _, k in slots)


def test_slots_of_odd_rows(spark, texts, monkeypatch):
    from hourwise.llm import sharding

    monkeypatch.setattr(sharding, "BUCKET_ROWS", 3)
    monkeypatch.setattr(sharding, "RUN_ROWS", 7)
    rows = texts + [(77, "the same row")] * 50 + [(77, f"same id {k}") for k in range(60)] + [(None, None)] * 20 + [(9, "y" * 200_000)]
    src = frame(spark, [(i, t, 1, "clash", 5) for i, t in rows], "doc_id long, text string, shard int, slot string, size int")
    first = shard_slots(src, 4).collect()
    _check(first, rows, 4)
    again = shard_slots(src.repartition(5), 4).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert shard_slots(frame(spark, []), 4).count() == 0
    assigned = assign_shards(src, 4)
    assert assigned.columns == ["doc_id", "text", "shard", "slot", "size", "moves_at"] and assigned.count() == len(rows)
    assert assign_shards(frame(spark, [("a", "x"), (None, "y")], "doc_id string, text string"), 4).filter("shard between 0 and 3").count() == 2


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    write_shards(docs, str(tmp_path / "out"), 8, tasks_a_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(*docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert {r["doc_id"]: r["shard"] for r in back.select("doc_id", "shard").collect()} == {r["doc_id"]: jump(r["doc_id"], 8)[0] for r in docs.select("doc_id").collect()}


def test_query_equals_sql_and_has_no_python(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF0001}/documents.parquet'")
    got = catalog.op11_sharding(spark, SF0001)
    names = sorted(got.columns)
    want = con.sql(f"select {', '.join(names)} from ({catalog.OP11_SQL})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert got.filter((F.col("law") != "key") | (F.col("slot") < 0)).count() == 0
