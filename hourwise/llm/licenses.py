"""Licence scans by a trained paragraph classifier (operator 4), on DataFrame and SQL functions only.

Paragraphs (lines, and windows of lines for notices that are wrapped) become sets of words and word pairs. A multinomial logistic regression with elastic-net penalty is
trained on licence templates, bare and inside paragraphs of the corpus, against paragraphs of the corpus (class
unknown); the penalty leaves most weights at 0. Its scores are divided by the temperature that gives the least log
loss on a fifth of the examples kept aside. A predicted family counts if its probability reaches ``PROBABILITY`` and
the best matching template of all families is one of its own, with at least ``SIMILARITY`` of its pairs in the paragraph.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwise.llm.store import handed

UNKNOWN = "unknown"
PROBABILITY, SIMILARITY = 0.5, 0.6
#: Lines that a wrapped notice may take: the longest template at 35 columns.
WINDOW_LINES = 8
#: Paragraphs of the corpus that the classifier is trained on, about.
SAMPLE_PARAGRAPHS = 4000
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)

#: The usual wording of licence notices, by family.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0", "This work is released into the public domain."),
    ("CC0", "Licensed under CC0 1.0 Universal."),
]


def templates(spark: SparkSession) -> DataFrame:
    """(template, family, text)."""
    return spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(k).alias("template"), F.lit(f).alias("family"), F.lit(t).alias("text")) for k, (f, t) in enumerate(TEMPLATES)))))


def pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))


def grams(text: Column) -> Column:
    """Words and word pairs; words are runs of letters and digits in lower case. (A lambda's variable holds the words,
    so that the text is split once.)"""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}0-9]+"), "")
    return F.element_at(F.transform(F.array(words), lambda w: F.concat(w, pairs(w))), 1)


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, paragraph, text) of every line with a letter."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("paragraph", "text"))
    return lines.filter(F.col("text").rlike(r"\p{L}"))


#: Words that ordinary texts hold too: ``marks`` takes them last.
COMMON = frozenset("by under following provided general international source public project included published subject specific version conditions this work is the of and to in it you or any be".split())


def marks() -> list[str]:
    """Words of the templates, rare and long ones first, so many that no text without them has ``SIMILARITY`` of the pairs of
    any template."""
    chosen: set[str] = set()
    for _, text in TEMPLATES:
        own = _pairs(text)
        for word in sorted({w for x in own for w in x.split()}, key=lambda w: (w not in chosen, w in COMMON, -len(w), w)):
            if sum(not chosen.isdisjoint(x.split()) for x in own) > (1 - SIMILARITY) * len(own) + 1e-9:
                break
            chosen.add(word)
    return sorted(chosen)


def spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, _row, paragraph, n_lines, text): every line with a letter, and the windows of 2 to ``WINDOW_LINES``
    lines with letters or digits in a row that hold one of ``marks``; ``_row`` tells rows of ``docs`` apart."""
    letter, mark = r"\p{L}", rf"(?iu)(?<![\p{{L}}0-9])(?:{'|'.join(marks())})(?![\p{{L}}0-9])"
    split = docs.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), F.split(F.col(text_col), "\n").alias("_lines"), F.col(text_col).rlike(mark).alias("_marked"))
    lines = F.col("_lines")
    one = F.transform(lines, lambda x, i: F.struct(i.alias("paragraph"), F.lit(1).alias("n_lines"), x.alias("text")))
    # a window belongs to its first line with a mark: ``before`` lines stand in front of that
    shapes = F.array(*(F.struct(F.lit(before).alias("before"), F.lit(n).alias("n")) for n in range(2, WINDOW_LINES + 1) for before in range(n)))
    cut = lambda i, s, n: F.slice(lines, F.greatest(i - s["before"] + 1, F.lit(1)), n)
    fits = lambda i, s: ((i >= s["before"]) & (i - s["before"] + s["n"] <= F.size(lines)) & F.forall(cut(i, s, s["n"]), lambda x: x.rlike(r"[\p{L}0-9]"))
                         & ~F.exists(cut(i, s, s["before"]), lambda x: x.rlike(mark)))
    around = lambda i: F.transform(F.filter(shapes, lambda s: fits(i, s)), lambda s: F.struct(
        (i - s["before"]).alias("paragraph"), s["n"].alias("n_lines"), F.concat_ws(" ", cut(i, s, s["n"])).alias("text")))
    marked = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(mark))
    wrapped = F.when(F.col("_marked") & (F.size(lines) > 1), F.flatten(F.transform(marked, around))).otherwise(F.slice(one, 1, 0))
    every = split.filter(lines.isNotNull()).select(id_col, "_row", F.inline(F.concat(one, wrapped)))
    return every.filter(F.col("text").rlike(letter))


class LicenceClassifier:
    """Vocabulary, weights and temperature, fitted on the templates and a bounded sample of paragraphs."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_PARAGRAPHS):
        spark = docs.sparkSession
        known = templates(spark).withColumn("grams", grams(F.col("text")))
        self.vocabulary = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0).fit(known)
        listed = F.array(*(F.lit(w) for w in self.vocabulary.vocabulary))
        total = docs.count()
        hash_ = F.pmod(F.xxhash64(F.lit(4), id_col, text_col), F.lit(1 << 24))
        some = docs.filter(hash_ < int((1 << 24) * min(1.0, rows / 8 / max(1, total))) + 1).limit(rows)
        lines = paragraphs(some, id_col, text_col).select("text").distinct().withColumn("grams", grams(F.col("text")))
        # a paragraph with a licence's wording is no example of the unknown class
        plain = lines.filter(F.size(F.array_intersect(F.filter("grams", lambda g: g.contains(" ")), listed)) < 3)
        plain = handed(plain.withColumn("_k", F.xxhash64("text")).orderBy("_k").limit(rows).withColumn("template", F.pmod("_k", F.lit(len(TEMPLATES))).cast("int")).select("template", "text"), "plain")
        inside = known.select("template", "family", F.col("text").alias("notice")).join(plain.select("template", "text"), "template").select(
            "family", F.when(F.xxhash64("text") % 2 == 0, F.concat_ws(" ", "notice", "text")).otherwise(F.concat_ws(" ", "text", "notice")).alias("text"))
        bare = known.select("family", F.explode(F.array_repeat("text", 20)).alias("text"))
        examples = plain.select(F.lit(UNKNOWN).alias("family"), "text").unionByName(inside.filter(F.xxhash64("text", "family") % 4 == 0)).unionByName(bare)
        # a few thousand rows that every training step passes over
        examples = handed(examples.repartition(2).withColumn("grams", grams(F.col("text"))), "examples")
        examples = self.vocabulary.transform(examples)
        indexer = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(examples)
        self.families = indexer.labels
        examples = indexer.transform(examples)
        aside = F.pmod(F.xxhash64(F.lit(44), "text"), F.lit(5)) == 0
        trainer = LogisticRegression(maxIter=30, regParam=0.002, elasticNetParam=0.5, family="multinomial", standardization=False)
        self.model = trainer.fit(examples.filter(~aside).select("label", "features"))
        held = self.model.transform(examples.filter(aside)).select(F.col("label").cast("int").alias("label"), vector_to_array("rawPrediction").alias("m"))
        losses = held.agg(*(F.avg(-F.log(F.greatest(F.element_at(_softmax(F.col("m"), t), F.col("label") + 1), F.lit(1e-12)))).alias(f"t{k}") for k, t in enumerate(TEMPERATURES))).first()
        ranked = [(x, t) for x, t in zip(losses, TEMPERATURES, strict=True) if x is not None]
        self.temperature = min(ranked)[1] if ranked else 1.0

    def predict(self, lines: DataFrame) -> DataFrame:
        """Those of ``lines`` (with ``grams``) that a family scores highest for, with ``family`` and its calibrated
        ``prob``. They are written once, so that nothing is scored again for each use of a score."""
        scored = self.model.setProbabilityCol("").transform(self.vocabulary.transform(lines))
        named = scored.filter(F.col("prediction") != float(self.families.index(UNKNOWN)) if UNKNOWN in self.families else F.lit(True))
        kept = handed(named.select(*lines.columns, F.col("prediction").cast("int").alias("_k"), vector_to_array("rawPrediction").alias("_m")), "licences")
        names = F.array(*(F.lit(x) for x in self.families))
        return kept.withColumn("family", F.element_at(names, F.col("_k") + 1)).withColumn(
            "prob", F.element_at(_softmax(F.col("_m"), self.temperature), F.col("_k") + 1)).drop("_k", "_m")


def _softmax(margins: Column, temperature: float) -> Column:
    e = F.transform(margins, lambda x: F.exp((x - F.array_max(margins)) / F.lit(temperature)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def scan_licences(docs: DataFrame, classifier: LicenceClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, prob, similarity): every paragraph with a confirmed licence family, by its first line
    (from 0).

    Every line of every text is classified, and every window of 2 to ``WINDOW_LINES`` consecutive lines with letters
    or digits that can reach the similarity, for notices wrapped over lines (comment marks don't count as words). Of windows
    that overlap, the most similar, then shortest, is given out, unless it overlaps a confirmed line of its family or a
    more similar one; of the confirmed lines all but those in a more similar window of another family (the first line
    of a GPL 3 notice fits GPL 2 as well). NULL and empty texts have none; repeated rows are
    scanned each; an empty table gives an empty result; other columns are ignored.
    """
    # as many structs as there are templates
    every = F.array(*(F.struct((F.size(F.array_intersect(F.array(*(F.lit(x) for x in own)), F.col("grams"))) / F.lit(len(own))).alias("similarity"), F.lit(family).alias("match"))
                      for family, own in ((f, sorted(_pairs(t))) for f, t in TEMPLATES)))
    lines = spans(docs, id_col, text_col).withColumn("grams", grams(F.col("text"))).drop("text")
    named = classifier.predict(lines.filter((F.col("n_lines") == 1) | (F.array_max(every)["similarity"] >= SIMILARITY))).filter(F.col("prob") >= PROBABILITY)
    compared = handed(named.select(F.col(id_col).alias("doc_id"), "_row", F.col("paragraph").cast("long").alias("paragraph"), "n_lines", "family", "prob", every.alias("_every")), "compared")
    best = F.array_max("_every")["similarity"]
    own = F.exists("_every", lambda x: (x["match"] == F.col("family")) & (x["similarity"] >= best))
    found = compared.filter((best >= SIMILARITY) & own).select("doc_id", "_row", F.struct(
        (F.col("n_lines") > 1).alias("wide"), (-best).alias("rank"), "n_lines", "paragraph", "family", "prob").alias("x"))
    end = lambda x: x["paragraph"] + x["n_lines"]
    inside = lambda x, y: (x["paragraph"] >= y["paragraph"]) & (end(x) <= end(y))
    meets = lambda x, y: (x["paragraph"] < end(y)) & (y["paragraph"] < end(x))
    # y comes first in the order, but a line may be less similar than a window
    beaten = lambda x, y: meets(x, y) & ((x["family"] == y["family"]) | (y["rank"] <= x["rank"]))
    part = lambda x, y: inside(x, y) & (x["family"] != y["family"]) & (y["rank"] < x["rank"])
    of_row = found.groupBy("doc_id", "_row").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    kept = F.aggregate("xs", F.slice("xs", 1, 0), lambda got, x: F.when(~x["wide"] | ~F.exists(got, lambda y: beaten(x, y)), F.concat(got, F.array(x))).otherwise(got))
    whole = F.filter("ys", lambda x: ~F.exists("ys", lambda y: part(x, y)))
    return of_row.select("doc_id", kept.alias("ys")).select("doc_id", F.inline(whole)).select("doc_id", "paragraph", "family", "prob", (-F.col("rank")).alias("similarity"))


def _pairs(text: str) -> set[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return {" ".join(x) for x in zip(words, words[1:])}
