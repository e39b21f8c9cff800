"""The corpus pipeline against brute force, stage by stage, and over the whole small table."""

import re

import corpus_pipeline as cp
from tests.conftest import SF001
from tests.llm.conftest import frame
from tests.llm.test_decontam_licenses_toxicity import _brute
from tests.llm.test_lines_mixing_lang import _kept
from tests.llm.test_ngram_join import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages_of_a_small_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select(*COLUMNS)
    start = _rows(docs)
    insult = re.compile("loser|idiot|pathetic|scum|worthless|moron|trash|clown|disgusting|stupid", re.I)
    clean = _rows(cp.toxicity(spark, docs, SF001))
    kept = {r[0] for r in clean}
    gone = [r for r in start if r[0] not in kept]
    assert set(clean) <= set(start) and gone
    english = [r for r in start if r[2] == "en"]
    assert sum((r[0] not in kept) == bool(insult.search(r[1])) for r in english) / len(english) > 0.97
    deduped = _rows(cp.line_dedup(spark, frame(spark, clean, SCHEMA), SF001))
    want = {i: (t, d) for i, t, _, d in _kept([(r[0], r[1]) for r in clean], 40, 5)}
    assert {r[0]: r[1] for r in deduped} == {i: t for i, (t, d) in want.items() if not d or WORD.search(t)}
    before = {r[0]: r for r in clean}
    assert all(r[4] == (len(r[1]) if want[r[0]][1] else before[r[0]][4]) and r[2:4] == before[r[0]][2:4] for r in deduped)
    single = _rows(cp.near_duplicates(spark, frame(spark, deduped, SCHEMA), SF001))
    label = {int(a): int(b) for a, b in (x.strip("()").split(", ")[::2] for x in brute([(r[0], r[1]) for r in deduped]))}
    assert sorted(single) == sorted(r for r in deduped if label[r[0]] == r[0]) and len(single) < len(deduped)
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    free = _rows(cp.decontamination(spark, frame(spark, single, SCHEMA), SF001))
    leaked = {r[0] for r in single if any(x in r[1] for _, x in items)}
    assert leaked and not leaked & {r[0] for r in free} and set(free) <= set(single)
    dropped = [(r[0], r[1]) for r in single if r not in set(free)]
    assert {i for i, _ in _brute(dropped, items)} == {i for i, _ in dropped}
    mixed = cp.mixing(spark, frame(spark, free, SCHEMA), SF001).collect()
    assert {r["doc_id"]: r["size"] for r in mixed} == {r[0]: len(WORD.findall(r[1])) for r in free}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in mixed)
    total = sum(r["size"] for r in mixed)
    assert abs(sum(r["taken"] for r in mixed) - total) < 0.05 * total


def test_run_equals_its_stages_and_repeats(spark):
    sf = "/root/testdata/sf0.001"
    one, two = (sorted(map(tuple, cp.run(spark, sf).collect())) for _ in range(2))
    assert one == two and one
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None


def test_empty_and_odd_documents(spark, texts, tmp_path):
    for rows in ([], [(i, t, None, None, None) for i, t in texts]):
        docs = frame(spark, rows, SCHEMA)
        docs.write.parquet(str(tmp_path / f"d{len(rows)}" / "documents.parquet"))
        frame(spark, [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / f"d{len(rows)}" / "labels.parquet"))
        frame(spark, [], "item_id long, text string").write.parquet(str(tmp_path / f"d{len(rows)}" / "benchmark.parquet"))
        out = cp.run(spark, str(tmp_path / f"d{len(rows)}")).collect()
        assert (len(out) > 0) == (len(rows) > 0)


def test_rows_are_decided_one_by_one(spark, tmp_path):
    """Repeated rows, rows without an id and rows that share one id with other texts."""
    one, two, item = (" ".join(f"{w}{k}" for k in range(40)) for w in ("left", "right", "item"))
    other = "a text of its own under an id that others have"
    texts = [(5, one), (5, one), (5, one + " end"), (3, one), (None, one), (None, two), (None, two + " end"), (5, other), (None, None), (None, None), (7, two + " " + item), (7, other + " too")]
    rows = [(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(texts)]
    frame(spark, [(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame(spark, rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "rows"))
    for docs in (frame(spark, rows, SCHEMA), spark.read.parquet(str(tmp_path / "rows"))):
        single = cp.near_duplicates(spark, docs, str(tmp_path))
        assert single.columns == COLUMNS
        kept = sorted(int(r[3][1:]) for r in _rows(single))
        assert [k for k in kept if k not in (5, 6)] == [3, 7, 8, 9, 10] and len(kept) == 6
        same = [r for r in _rows(cp.near_duplicates(spark, frame(spark, [rows[0], rows[0], rows[1]], SCHEMA), str(tmp_path)))]
        assert len(same) == 1 and same[0][:2] == (5, one)
    leaky = [(None, "x " + item, "en", "s0", 1), (None, other, "en", "s1", 1), (7, two + " " + item, "en", "s2", 1), (7, other, "en", "s3", 1), (8, item, "en", "s4", 1), (8, item, "en", "s4", 1)]
    assert sorted(r[3] for r in _rows(cp.decontamination(spark, frame(spark, leaky, SCHEMA), str(tmp_path)))) == ["s1", "s3"]
