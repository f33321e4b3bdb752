"""Licence scans: paragraphs scored by sparse word n-grams, confirmed by comparison with templates. Built-in functions only.

1. Templates (short public notices per family) are varied: whole, with surrounding words, cut. Together with all of the corpus'
   paragraphs that share no telling word with a template (class ``unknown``) they train a multinomial logistic regression over the
   n-grams (1 to 3 words) that occur in templates. Paragraphs with the same n-grams are one row with their number as weight; the
   class as a whole weighs at most ``unknown_weight`` paragraphs, so that a large corpus does not outweigh the templates.
2. A part of both is left out of training. On it the bar for "known" is set: the lowest probability at which no left-out unknown
   paragraph passes, at least ``least_probability`` and at most 0.95.
3. Every paragraph (line) of every document that holds a telling word is scored: its n-grams meet the table of weights, whose size
   depends on the templates alone. A paragraph without any word that names a licence or its terms counts as unknown.
4. A prediction counts as confirmed when enough of a template of that family is in the paragraph.

Defined cases: null and empty texts have no paragraph; a paragraph may be repeated and is reported each time; rows are told apart
by doc_id and the number of the paragraph, repeated rows give repeated hits; a null doc_id is reported as null; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import lower_ascii, written

WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
SEED = 3
UNKNOWN_WEIGHT = 2000
LEAST_PROBABILITY = 0.5
CONFIRMED = 0.6
UNKNOWN = "unknown"

# Usual short notices of public licences.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL version 2 or later.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-only",
        "Licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU Affero General Public License.",
    ),
    "bsd": (
        "Released under the BSD License.", "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc": (
        "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "public_domain": (
        "This work is in the public domain.", "Released into the public domain.", "Dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "reserved": ("All rights reserved.", "Copyright. All rights reserved.", "No part of this publication may be reproduced without written permission."),
}


def tokens(text):
    """Lower-cased words: letters, digits, inner dots."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(f"({WORD})"), F.lit(1))


def grams(words):
    """Distinct n-grams of one to three words."""
    def run(n: int):
        upto = F.size(words) - (n - 1)
        return F.when(upto > 0, F.transform(F.sequence(F.lit(1), upto), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(run(1), run(2), run(3)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (from 0), words of each line with a word."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("paragraph", "line"))
    return lines.withColumn("words", tokens(F.col("line"))).filter(F.size("words") > 0)


def template_rows(spark: SparkSession) -> DataFrame:
    """family, number, words of each template."""
    rows = [(family, n, text) for family, texts in TEMPLATES.items() for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, number int, text string").select("family", "number", tokens(F.col("text")).alias("words"))


def telling_words() -> list[str]:
    """Words of the templates that name a licence or its terms; a notice holds at least one of them."""
    everyday = {  # words of everyday English among the templates
        "a", "all", "and", "any", "are", "as", "at", "be", "by", "copy", "except", "file", "files", "following", "form", "forms", "free", "in", "into",
        "is", "it", "its", "later", "may", "met", "no", "not", "of", "or", "part", "person", "project", "provided", "source", "that", "the", "this", "to",
        "under", "use", "with", "without", "work", "you", "charge", "obtain", "obtaining", "written", "version", "v", "here", "hereby", "code",
    }
    found = {w for texts in TEMPLATES.values() for t in texts for w in re.findall(WORD, t.lower())}
    return sorted(w for w in found - everyday if not w[0].isdigit() and len(w) > 1)


def has_telling_word(words):
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in telling_words()]))


class Model:
    """Weights per n-gram and class, biases, and the bar for known."""

    def __init__(self, weights: DataFrame, biases: dict[str, float], bar: float):
        self.weights, self.biases, self.bar = weights, biases, bar


def vocabulary() -> list[str]:
    """N-grams of the templates, in order."""
    runs = [re.findall(WORD, t.lower()) for texts in TEMPLATES.values() for t in texts]
    return sorted({" ".join(w[i : i + n]) for w in runs for n in (1, 2, 3) for i in range(len(w) - n + 1)})


def plain_grams(words):
    """The n-grams of templates in a paragraph without telling words, in order. Few can be there, so they are looked for."""
    telling = set(telling_words())
    able = [g for g in vocabulary() if not telling & set(g.split(" "))]
    single = F.array_intersect(words, F.array(*[F.lit(g) for g in able if " " not in g]))
    runs = F.array(*[F.lit(f" {g} ") for g in able if " " in g])
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    found = F.transform(F.filter(runs, lambda g: F.contains(text, g)), lambda g: F.trim(g))
    return F.array_sort(F.when(F.size(single) > 1, F.concat(single, found)).otherwise(single))


def told_apart(docs: DataFrame) -> DataFrame:
    """hit, doc_id, paragraph, words of every paragraph with a telling word; plain n-grams and left_out of every other one."""
    telling = has_telling_word(F.col("words"))
    mark = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "paragraph"), F.lit(5)) == 0
    return paragraphs(docs).select(F.monotonically_increasing_id().alias("hit"), "doc_id", "paragraph", F.when(telling, F.col("words")).alias("words"),
                                   F.when(~telling, plain_grams(F.col("words"))).alias("plain"), mark.alias("left_out"))


def probabilities(rows: DataFrame, keys: list[str], own, weights: DataFrame, biases: dict[str, float]) -> DataFrame:
    """``keys`` with the best family other than unknown and its probability. ``rows`` holds the keys, ``own`` gives a row's n-grams."""
    classes = sorted(biases)
    each = rows.select(*keys, F.explode(own).alias("gram")).join(F.broadcast(weights), "gram")
    sums = each.groupBy(*keys).agg(*[(F.sum(c) + biases[c]).alias(c) for c in classes])
    top = F.greatest(*[F.col(c) for c in classes])
    whole = sum((F.exp(F.col(c) - top) for c in classes), F.lit(0.0))
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("score"), F.lit(c).alias("family")) for c in classes if c != UNKNOWN]))
    return sums.select(*keys, best["family"].alias("family"), (F.exp(best["score"] - top) / whole).alias("probability"))


def train(docs: DataFrame, unknown_weight: int = UNKNOWN_WEIGHT, least_probability: float = LEAST_PROBABILITY, seed: int = SEED) -> Model:
    """Fits on varied templates and all paragraphs without telling words."""
    return _fit(written(told_apart(docs).filter("words IS NULL")), unknown_weight, least_probability, seed)


def _fit(apart: DataFrame, unknown_weight: int = UNKNOWN_WEIGHT, least_probability: float = LEAST_PROBABILITY, seed: int = SEED) -> Model:
    """``apart`` is what ``told_apart`` gives, stored."""
    spark = apart.sparkSession
    known = template_rows(spark)
    half = lambda c: F.greatest(F.lit(1), F.ceil(F.size(c) * 0.7).cast("int"))
    around = F.array(*[F.lit(w) for w in ("see", "notes", "below")])
    varied = F.array(F.col("words"), F.slice("words", 1, half("words")), F.concat(around, F.col("words")), F.concat(F.col("words"), around), F.slice(F.col("words"), F.size("words") - half("words") + 1, half("words")))
    known = known.select("family", "number", F.posexplode(varied).alias("way", "words")).select(
        "family", (F.pmod(F.xxhash64(F.lit(seed), "family", "number", "way"), F.lit(5)) == 0).alias("left_out"), grams(F.col("words")).alias("grams"))
    plain = written(apart.filter("words IS NULL").groupBy(F.col("plain").alias("grams"), "left_out").agg(F.count(F.lit(1)).alias("n")))
    in_all = plain.agg(F.sum("n")).first()[0] or 0
    plain = plain.withColumns({"family": F.lit(UNKNOWN), "weight": F.col("n") * min(1.0, unknown_weight / max(1, in_all))})
    grams_of = vocabulary()
    vectors = CountVectorizerModel.from_vocabulary(grams_of, "grams", "features")
    vectors.setBinary(True)
    classes = sorted([*TEMPLATES, UNKNOWN])
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("family")).cast("double") - 1
    rows = known.withColumn("weight", F.lit(1.0)).unionByName(plain.drop("n"))
    fitted = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60, weightCol="weight").fit(
        vectors.transform(rows.filter(~F.col("left_out"))).withColumn("label", number).select("features", "label", "weight"))
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    seen = matrix.shape[0]
    table = [(g, *(float(matrix[k, i]) if k < seen else 0.0 for k in range(len(classes)))) for i, g in enumerate(grams_of)]
    weights = written(spark.createDataFrame(table, "gram string, " + ", ".join(f"`{c}` double" for c in classes)))
    biases = {c: float(bias[k]) if k < seen else -50.0 for k, c in enumerate(classes)}
    unknown = plain.filter("left_out").select("grams", F.monotonically_increasing_id().alias("n"))
    worst = probabilities(unknown, ["n"], F.col("grams"), weights, biases).agg(F.max("probability")).first()[0]
    return Model(weights, biases, max(least_probability, min(0.95, worst or 0.0)))


def scan(docs: DataFrame, model: Model | None = None, confirmed: float = CONFIRMED) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed of each paragraph that passes the bar."""
    spark = docs.sparkSession
    apart = told_apart(docs)
    apart = written(apart if model is None else apart.filter("words IS NOT NULL"))  # texts are cut into words once, for training as well
    model = model or _fit(apart)
    found = apart.filter("words IS NOT NULL").select("hit", "doc_id", "paragraph", "words")
    scored = probabilities(found, ["hit"], grams(F.col("words")), model.weights, model.biases).filter(F.col("probability") > model.bar)
    own = template_rows(spark).select("family", "number", grams(F.col("words")).alias("grams"))
    own = own.select("family", "number", F.size("grams").alias("of"), F.explode("grams").alias("gram"))
    shared = found.join(scored, "hit").select("hit", "family", F.explode(grams(F.col("words"))).alias("gram")).join(F.broadcast(own), ["family", "gram"])
    best = shared.groupBy("hit", "number", "of").agg(F.count(F.lit(1)).alias("n")).groupBy("hit").agg(F.max(F.col("n") / F.col("of")).alias("similarity"))
    out = found.select("hit", "doc_id", "paragraph").join(scored, "hit").join(best, "hit", "left")
    similarity = F.coalesce("similarity", F.lit(0.0))
    return out.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round(similarity, 6).alias("similarity"),
                      (similarity >= confirmed).alias("confirmed"))
