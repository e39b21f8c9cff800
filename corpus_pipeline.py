"""Corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, source mixing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet in the shared folder and reads again as the next stage's documents. All stages but the last return
the columns of ``docs``. A stage sees what its predecessor kept and nothing else; ``labels`` and ``benchmark`` come
from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwise.llm.store import handed, table


#: 8 MB of row numbers.
BROADCAST_IDS = 1_000_000
ROW = "_pipeline_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row (``ROW``): its file's, by path, and its place there, so that it is the same
    wherever the rows are read. What isn't a plain read of files is written first. Columns of ``docs`` that are named like
    the number are set aside until ``_without``."""
    own = {c: f"_own{c}" for c in docs.columns if c.startswith(ROW)}
    docs = docs.withColumnsRenamed(own) if own else docs
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = handed(docs, "keyed")
    placed = docs.withColumns({f"{ROW}_file": F.col("_metadata.file_path"), f"{ROW}_place": F.col("_metadata.row_index")})
    files = sorted(r[0] for r in placed.select(f"{ROW}_file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame([(f, k << 40) for k, f in enumerate(files)], f"{ROW}_file string, {ROW}_first long")
    row = (F.col(f"{ROW}_first") + F.col(f"{ROW}_place")).alias(ROW)
    return placed.join(F.broadcast(numbers), f"{ROW}_file").select(*(F.col(f"`{c}`") for c in docs.columns), row)


def _without(keyed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose number isn't in ``rejected``, without the number. Up to ``BROADCAST_IDS`` numbers go to
    the documents, more meet them in a shuffle join."""
    rows = handed(rejected.select(ROW).distinct(), "rejected")
    return keyed.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, ROW, "left_anti").select(
        *(F.col(f"`{c}`").alias(c.removeprefix("_own") if c.startswith(f"_own{ROW}") else c) for c in keyed.columns if c != ROW))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on the labelled documents left here, rejects go."""
    from hourwise.llm.toxicity import drop_toxic, toxicity_model

    return drop_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share stay only in the last of them; ``n_chars`` follows the text. Documents
    of which no word is left (all of them stands in others) go."""
    from hourwise.llm.line_dedup import drop_repeated_lines
    from hourwise.llm.mixing import word_count

    # columns of the documents that are named like the operator's counts are set aside
    own = {c: f"_own_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    out = drop_repeated_lines(docs.select(*(F.col(f"`{c}`").alias(own.get(c, c)) for c in docs.columns)))
    out = out.filter((F.col("n_dropped") == 0) | (word_count(F.col("text")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by a similarity of 0.75 or more, one stays: the one with the smallest doc_id, of
    rows that repeat it the first. Rows without a doc_id are in groups like all others and come after those with one."""
    from hourwise.llm.ngram_join import ngram_components

    keyed = _keyed(docs)
    ranked = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    classes = ngram_components(keyed.select(ranked.alias("doc_id"), "text"))
    return _without(keyed, classes.filter(F.col("component_id.row") != F.col("doc_id.row")).select(F.col("doc_id.row").alias(ROW)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of ``benchmark`` go; other rows with the same doc_id stay."""
    from hourwise.llm.decontam import find_leaks

    keyed = _keyed(docs)
    return _without(keyed, find_leaks(keyed, table(spark, sf_dir, "benchmark"), id_col=ROW).select(F.col("doc_id").alias(ROW)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix at target weights takes of each document left: doc_id, source, size, source_size, target,
    taken."""
    from hourwise.llm.mixing import mix_sources

    documents, _, _ = mix_sources(docs)
    return documents


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: Trained scores and seeded draws aren't SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = handed(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
