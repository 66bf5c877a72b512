"""Licence scan of paragraphs: a trained classifier, a calibrated unknown class, and templates that confirm.

Texts are cut into lines, and long lines into overlapping pieces of
``PIECE_WORDS`` words. Word bigrams and trigrams that occur in the labelled table
(but for those of common words alone) are looked up in each piece and a multinomial logistic regression names the family or
the class ``unknown``. A second regression, fitted on held-back labelled rows, turns
the lead of the best family over ``unknown`` into a probability. What is more likely
known than not is compared with the family's templates by 3-word shingles.

Everything runs in the JVM, row by row after the explode: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, NGram
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.llm.common import require

PIECE_WORDS = 60
PIECE_STEP = 30
SIMILARITY = 0.8
UNKNOWN = "unknown"
#: Notices and opening words of public licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "This project is released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL, version 2 or later.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the LGPL, version 3.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "You are free to share and adapt the material for any purpose under the Creative Commons Attribution license.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": (
        "Released under CC0 1.0, public domain dedication.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "Proprietary": (
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "Copyright, all rights reserved.",
        "This material is confidential and proprietary and may not be copied or distributed without written consent.",
    ),
}
#: Sentences near the subject, and far from it, that are no licence.
OTHERS: tuple[str, ...] = (
    "You need a driving license to rent a car in this town.",
    "The new album was released under the name of the band last week.",
    "The software was released in version 2.0 with many changes.",
    "She was granted permission to leave the room before the end.",
    "The general public is free to visit the library on Sunday.",
    "He works for a foundation that gives free meals to the poor.",
    "The terms of the contract were published in the paper.",
    "Apache helicopters were seen above the valley in the morning.",
    "Students of MIT and of other schools took part in the contest.",
    "The source of the river is in the mountains to the north.",
    "A copy of the letter was found in the house of the author.",
    "The notice on the door said that the shop is closed for good.",
    "All rights of way across the field are to be kept open.",
    "Creative people in common areas often share their work with others.",
    "The law does not require a warranty for goods that are sold as used.",
    "The committee met on Tuesday to discuss the plan in detail.",
    "It was a bright cold day and the clocks were striking.",
    "The weather will be mild with some rain in the west.",
    "We walked along the coast until it was dark.",
    "The recipe calls for two eggs and a cup of flour.",
    "This work is the best that the painter ever did.",
    "You may obtain tickets at the gate or by mail.",
    "The file was lost and could not be found again.",
    "No part of the building was open to visitors.",
    "In this version of the story the king does not return.",
    "The conditions are met by most of the players.",
    "Use of the road is limited to the people who live there.",
    "The above is an example of what may go wrong.",
    "Licensed doctors are hard to find in the country.",
    "The public domain of the city was sold to investors.",
)


#: Common English words. An n-gram of these alone tells nothing and is no feature.
COMMON = frozenset(
    "a all an and any are as at be been before but by can could each for from had has have he her his if in into is it its "
    "may more most must no not of on one or other our out shall she should so such than that the their them there these they "
    "this to under up was we were what when which who will with would you your".split()
)


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased, and of other signs beyond ASCII."""
    return F.filter(F.split(F.lower(text), r"[\x00-/:-`{-\x7F]+"), lambda w: w != "")


def labelled_rows() -> list[tuple[str, str]]:
    """(label, text): each template whole, without its edges, in halves, and set between other words."""
    rows = []
    for i, (family, texts) in enumerate(TEMPLATES.items()):
        for j, text in enumerate(texts):
            words = text.split()
            cut = len(words) // 2
            near, far = OTHERS[(i + 3 * j) % len(OTHERS)], OTHERS[(7 * i + j + 5) % len(OTHERS)]
            variants = [text, text.upper(), f"{near} {text}", f"{text} {far}", f"Copyright 2020 The Authors. {text}"]
            if cut >= 6:
                variants += [" ".join(words[:cut]), " ".join(words[cut:]), " ".join(words[2:]), " ".join(words[:-2])]
            rows += [(family, v) for v in variants]
    for i, text in enumerate(OTHERS):
        words = text.split()
        other = OTHERS[(i + 11) % len(OTHERS)].split()
        mixed = " ".join(words[: len(words) // 2] + other[len(other) // 2 :])
        rows += [(UNKNOWN, text), (UNKNOWN, mixed), (UNKNOWN, f"{text} {' '.join(other)}"), (UNKNOWN, " ".join(reversed(words)))]
    return rows


@dataclass
class Model:
    families: list[str]
    keywords: list[str]
    vectorizer: CountVectorizerModel
    classifier: LogisticRegressionModel
    slope: float
    offset: float


def _grams(df: DataFrame) -> DataFrame:
    two, three = NGram(n=2, inputCol="__w", outputCol="__g2"), NGram(n=3, inputCol="__w", outputCol="__g3")
    return three.transform(two.transform(df)).withColumn("__g", F.concat("__g2", "__g3")).drop("__g2", "__g3")


def _lead(raw: Column, unknown: int) -> Column:
    """Margin of the best family over unknown."""
    a = vector_to_array(raw)
    return F.array_max(F.filter(a, lambda x, i: i != unknown)) - F.get(a, F.lit(unknown))


def train(spark: SparkSession) -> Model:
    """Fit on the labelled table above: two thirds for the classes, the rest for the calibration."""
    rows = labelled_rows()
    families = [*sorted(TEMPLATES), UNKNOWN]
    cells = [F.struct(F.lit(float(families.index(f))).alias("label"), F.lit(t).alias("text"), F.lit(i % 3 == 2).alias("late")) for i, (f, t) in enumerate(rows)]
    table = spark.range(1, numPartitions=1).select(F.inline(F.array(*cells)))
    grams = _grams(table.withColumn("__w", words_of(F.col("text"))))
    counted = CountVectorizer(inputCol="__g", outputCol="__x", binary=True, vocabSize=1 << 14).fit(grams)
    vocabulary = [g for g in counted.vocabulary if not COMMON.issuperset(g.split(" "))]
    keywords = sorted({w for g in vocabulary for w in g.split(" ")} - COMMON)
    vectorizer = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="__g", outputCol="__x").setBinary(True)
    counted = vectorizer.transform(grams)
    learner = LogisticRegression(featuresCol="__x", labelCol="label", rawPredictionCol="__raw", probabilityCol="__p", predictionCol="__y", family="multinomial", regParam=0.002, maxIter=40)
    first = learner.fit(counted.filter("not late"))
    unknown = float(families.index(UNKNOWN))
    leads = first.transform(counted.filter("late")).select((F.col("label") != unknown).cast("double").alias("label"), F.array(_lead(F.col("__raw"), int(unknown))).alias("m"))
    calibrator = LogisticRegression(featuresCol="__m", labelCol="label", regParam=0.01, maxIter=40).fit(leads.withColumn("__m", array_to_vector("m")))
    classifier = learner.fit(counted)
    slope, offset = float(calibrator.coefficients[0]), float(calibrator.intercept)
    start = classifier.interceptVector.toArray()
    if slope * (max(np.delete(start, int(unknown))) - start[int(unknown)]) + offset >= 0:
        raise RuntimeError("a text without any feature must be unknown")
    return Model(families, keywords, vectorizer, classifier, slope, offset)


def pieces(docs: DataFrame, text: str, keywords: list[str]) -> DataFrame:
    """Rows of ``paragraph`` (line number from 0), ``piece`` (from 0) and words ``__w``.

    Lines without any of the keywords are left out: every feature has one of them.
    """
    lines = docs.select("*", F.posexplode(F.split(F.col(text), "\n", -1)).alias("paragraph", "__line"))
    worded = lines.withColumn("__all", words_of(F.col("__line"))).drop("__line")
    worded = worded.filter((F.size("__all") > 1) & F.exists("__all", lambda w: w.isin(*keywords)))
    n = F.size("__all")
    starts = F.when(n <= PIECE_WORDS, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - PIECE_STEP - 1, F.lit(PIECE_STEP)))
    cut = worded.select("*", F.posexplode(starts).alias("piece", "__at"))
    return cut.withColumn("__w", F.slice("__all", F.col("__at") + 1, F.lit(PIECE_WORDS))).drop("__all", "__at")


def _shingles(words: Column) -> Column:
    last = F.greatest(F.size(words) - 3, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, 3), " ")))


def _template_words(text: str) -> Column:
    return words_of(F.lit(text))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, paragraph, piece, family, probability, similarity, confirmed) of each piece that is not unknown.

    ``probability`` is the calibrated chance that the piece is a licence text at all;
    ``similarity`` is the best overlap of 3-word shingles with a template of the
    family, over the smaller of both sets; from 0.8 on it confirms the prediction.
    Null and empty texts and lines of fewer than two words give no row; ids may be
    null; repeated rows repeat. Other columns are not looked at.
    """
    require(docs, id_col, text)
    light = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    counted = model.vectorizer.transform(_grams(pieces(light, "__text", model.keywords).drop("__text")))
    scored = model.classifier.transform(counted.drop("__g"))
    unknown = len(model.families) - 1
    lead = _lead(F.col("__raw"), unknown)
    chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(model.slope) * lead + F.lit(model.offset))))
    best = F.array_position(vector_to_array("__raw"), F.array_max(F.filter(vector_to_array("__raw"), lambda x, i: i != unknown))) - 1
    known = scored.withColumn("probability", chance).filter("probability >= 0.5").withColumn("__k", best.cast("int"))
    named = known.withColumn("family", F.element_at(F.array(*map(F.lit, model.families)), F.col("__k") + 1))
    own = named.withColumn("__s", _shingles(F.col("__w")))

    def overlap(template: str) -> Column:
        other = _shingles(_template_words(template))
        return F.size(F.array_intersect("__s", other)) / F.least(F.size("__s"), F.size(other))

    similarity = F.lit(0.0)
    for family, texts in TEMPLATES.items():
        found = [overlap(t) for t in texts]
        similarity = F.when(F.col("family") == family, F.greatest(*found)).otherwise(similarity)
    return own.withColumn("similarity", similarity).select(
        F.col("__id").alias(id_col), "paragraph", "piece", "family", "probability", "similarity", (F.col("similarity") >= SIMILARITY).alias("confirmed")
    )
