"""Queries of the operators over their whole tables, with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from hourwise.llm.store import table

MIN_CHARS, MIN_DOCS = 40, 5
TOKEN_LIMIT = 4096


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark, sf):
    """Bytes and tokens of every document under a byte-fallback BPE vocabulary."""
    from hourwise.llm.tokens import count_tokens

    out = count_tokens(table(spark, sf, "documents"), tokenizer("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_decontamination(spark, sf):
    """Documents that hold a copy of a benchmark item."""
    from hourwise.llm.decontam import find_leaks

    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op3_ngram_join(spark, sf):
    """Components of all documents under links of 5-word shingle similarity."""
    from hourwise.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf, "documents"))


def op4_license_scans(spark, sf):
    """Paragraphs of all documents that state a licence."""
    from hourwise.llm.licenses import LicenceClassifier, scan_licences

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return scan_licences(docs, LicenceClassifier(docs))


def op5_toxicity(spark, sf):
    """Toxicity of every document, learned from labelled rows that are not held out."""
    from hourwise.llm.samples import held_out
    from hourwise.llm.toxicity import score_toxicity, toxicity_model

    docs = table(spark, sf, "documents")
    return score_toxicity(docs, toxicity_model(docs, table(spark, sf, "labels"))).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_secret_scans(spark, sf):
    """Secrets in every document: base patterns and strings that a vocabulary encodes badly."""
    import public_tokenizers

    from hourwise.llm.secrets import scan_secrets

    found = scan_secrets(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(written(F.filter("spans", lambda x: x["kind"] != "random")), 256).alias("base_sha256"), written("spans").alias("spans"))


def op7_language_id(spark, sf):
    """Language of every document, learned from the rows that are not held out."""
    from hourwise.llm.langid import identify, language_model
    from hourwise.llm.samples import held_out

    docs = table(spark, sf, "documents")
    return identify(docs, language_model(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_source_mixing(spark, sf):
    """Words that a mix of all sources at their target weights takes of every document."""
    from hourwise.llm.mixing import mix_sources

    documents, _, _ = mix_sources(table(spark, sf, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "source")


OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT row_number() OVER () AS rid, doc_id, string_split(text, chr(10)) AS lines FROM d),
l AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM s),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= {MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT rid) >= {MIN_DOCS}),
m AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> last_doc AS dropped FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id"""


def op9_line_dedup(spark, sf):
    """Every document without the lines that many documents share."""
    from hourwise.llm.line_dedup import drop_repeated_lines

    out = drop_repeated_lines(table(spark, sf, "documents").select("doc_id", "text"), MIN_CHARS, MIN_DOCS)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_quality_rules(spark, sf):
    """Base counts and the quality verdict of every document."""
    from hourwise.llm.quality import quality, quality_model

    docs = table(spark, sf, "documents")
    return quality(docs, quality_model(docs, table(spark, sf, "labels"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "prob")


SHARDS = 40


def _crc32_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, by the table ``entries`` of the 256 bytes' remainders."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295, list_reduce([4294967295] || {octets}, lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])))"


OP11_SQL = f"""
WITH RECURSIVE
crc_table AS (SELECT list(c ORDER BY i) AS entries FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) t(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT rid, doc_id, (octet_length(encode(text)) + 16)::BIGINT AS size, {_crc32_sql("text")} AS text_crc32 FROM d, crc_table),
p AS (SELECT s.*, {_crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || text_crc32::VARCHAR")} AS place FROM s, crc_table),
j AS (SELECT rid, (CASE WHEN coalesce(doc_id, 0) < 0 THEN coalesce(doc_id, 0)::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END)::UHUGEINT AS key, -1::BIGINT AS shard, 0::BIGINT AS jump FROM p
      UNION ALL
      SELECT rid, key, jump, floor((jump + 1)::DOUBLE * (2147483648.0::DOUBLE / ((key // 8589934592) + 1)::DOUBLE))::BIGINT
      FROM (SELECT rid, jump, (key * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS key FROM j WHERE jump < {SHARDS})),
r AS (SELECT rid, shard, jump FROM j WHERE jump >= {SHARDS})
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       (CASE WHEN jump = {SHARDS} THEN {SHARDS} ELSE shard END)::INTEGER AS grown_shard
FROM p JOIN r USING (rid)"""


def op11_sharding(spark, sf):
    """Shard, slot and next shard of every document."""
    from hourwise.llm.sharding import shard_slots

    out = shard_slots(table(spark, sf, "documents"), SHARDS)
    grown = F.when(F.col("moves_at") == SHARDS, F.lit(SHARDS)).otherwise(F.col("shard")).cast("int")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS terms FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS terms FROM benchmark),
q AS MATERIALIZED (SELECT item, item_id, unnest(terms) AS term FROM b),
c AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
t AS (SELECT row, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
f AS MATERIALIZED (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM t SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY term, docs),
i AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))) AS part FROM f JOIN w USING (term), c),
s AS (SELECT item, item_id, row, doc_id, sum(part)::BIGINT AS score FROM i JOIN q USING (term) GROUP BY ALL HAVING sum(part) > 0),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""


def op12_ranked_search(spark, sf):
    """The 50 best documents of every benchmark item."""
    from hourwise.llm.ranked_search import ranked_search

    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select("item_id", "rank", "doc_id", "score")


OP13_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
s AS (SELECT id, lang, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM w),
t AS MATERIALIZED (SELECT lang, x, lead(x, 1) OVER piece AS y, lead(x, 2) OVER piece AS z FROM s WINDOW piece AS (PARTITION BY id ORDER BY i)),
f1 AS MATERIALIZED (SELECT lang, x, count(*) AS f FROM t GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, x, y, count(*) AS f FROM t WHERE y IS NOT NULL GROUP BY ALL HAVING f >= 10),
f3 AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS f FROM t WHERE z IS NOT NULL GROUP BY ALL HAVING f >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT b.lang, b.x || ' ' || b.y AS phrase, b.f AS a, 1 AS c, u.f AS l, v.f AS r FROM f2 b JOIN f1 u ON u.lang = b.lang AND u.x = b.x JOIN f1 v ON v.lang = b.lang AND v.x = b.y
  UNION ALL
  SELECT b.lang, b.x || ' ' || b.y || ' ' || b.z, b.f, 1, u.f, v.f FROM f3 b JOIN f1 u ON u.lang = b.lang AND u.x = b.x JOIN f2 v ON v.lang = b.lang AND v.x = b.y AND v.y = b.z
  UNION ALL
  SELECT b.lang, b.x || ' ' || b.y || ' ' || b.z, b.f, 2, u.f, v.f FROM f3 b JOIN f2 u ON u.lang = b.lang AND u.x = b.x AND u.y = b.y JOIN f1 v ON v.lang = b.lang AND v.x = b.z),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, x || ' ' || y AS phrase, f FROM f3 UNION ALL SELECT lang, y || ' ' || z, f FROM f3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON b.lang = i.lang AND b.phrase = i.phrase WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


def op13_collocations(spark, sf):
    """The best phrases of two and three words of every language."""
    from hourwise.llm.collocations import collocations

    return collocations(table(spark, sf, "documents"))


def pipeline(spark, sf):
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Callable] = {f.__name__: f for f in (op1_token_counts, op2_decontamination, op3_ngram_join, op4_license_scans, op5_toxicity, op6_secret_scans, op7_language_id, op8_source_mixing, op9_line_dedup, op10_quality_rules, op11_sharding, op12_ranked_search, op13_collocations, pipeline)}


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {"op9_line_dedup": OP9_SQL, "op11_sharding": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_collocations": OP13_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
