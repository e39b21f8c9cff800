"""Extra columns, named like an operator's own, change no result; empty tables give empty results."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from hourwise.llm.catalog import tokenizer
from tests.conftest import SF0001
from tests.llm.conftest import frame

CLASHES = ("n_bytes", "n_tokens", "item_id", "similarity", "word_start", "n_shingles", "component_id", "node", "block", "grams", "spans",
           "lang_pred", "score", "label", "kept", "prob", "family", "paragraph", "match", "row", "id", "query", "rank", "shard", "slot", "place", "moves_at", "_n", "_k", "phrase", "f")


def _operators(spark):
    import public_tokenizers

    from hourwise.llm.collocations import collocations
    from hourwise.llm.decontam import find_leaks
    from hourwise.llm.langid import identify, language_model
    from hourwise.llm.ngram_join import ngram_components
    from hourwise.llm.quality import quality, quality_model
    from hourwise.llm.ranked_search import ranked_search
    from hourwise.llm.secrets import scan_secrets
    from hourwise.llm.sharding import shard_slots
    from hourwise.llm.tokens import count_tokens
    from hourwise.llm.toxicity import score_toxicity, toxicity_model

    whole = spark.read.parquet(f"{SF0001}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF0001}/{t}.parquet") for t in ("labels", "benchmark"))
    models = {"lang": language_model(whole, rows=60), "quality": quality_model(whole, labels), "toxic": toxicity_model(whole, labels)}
    return {
        "tokens": lambda d: count_tokens(d, tokenizer("piece_bpe_32k.model")),
        "leaks": lambda d: find_leaks(d, items),
        "components": ngram_components,
        "secrets": lambda d: scan_secrets(d, tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        "language": lambda d: identify(d, models["lang"]),
        "quality": lambda d: quality(d, models["quality"]),
        "toxicity": lambda d: score_toxicity(d, models["toxic"]),
        "slots": lambda d: shard_slots(d, 4),
        "search": lambda d: ranked_search(d, items, 3),
        "phrases": lambda d: collocations(d, top=20),
    }


@pytest.fixture(scope="module")
def operators(spark):
    return _operators(spark)


@pytest.mark.parametrize("name", ["tokens", "leaks", "components", "secrets", "language", "quality", "toxicity", "slots", "search", "phrases"])
def test_extra_columns_and_empty_tables(spark, operators, name):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").filter("doc_id < 60").select("doc_id", "text", "lang")
    crowded = docs.withColumns({c: F.lit(k) if k % 2 else F.lit("x") for k, c in enumerate(CLASHES)}).select(*CLASHES, "doc_id", "text", "lang")
    run = operators[name]
    plain, other = run(docs), run(crowded)
    assert other.columns == plain.columns and sorted(map(str, other.collect())) == sorted(map(str, plain.collect()))
    empty = run(frame(spark, [], "doc_id long, text string, lang string"))
    assert empty.columns == plain.columns and empty.count() == 0


def test_pipeline_stages_keep_columns_with_their_own_names(spark):
    names = ("_pipeline_row", "_pipeline_row_file", "n_lines", "n_dropped", "component_id", "item_id", "similarity")
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").filter("doc_id < 80")
    crowded = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for stage in (cp.line_dedup, cp.near_duplicates, cp.decontamination):
        out, plain = stage(spark, crowded, SF0001), stage(spark, docs, SF0001)
        assert out.columns == crowded.columns
        rows = out.collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in plain.select("doc_id").collect())
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names)
