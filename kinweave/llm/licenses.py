"""License scans with a trained paragraph classifier, in DataFrame operations only.

Sparse logistic regression over word n-grams gives each candidate paragraph a licence family; a family whose probability
is under the calibrated threshold is unknown, and a prediction counts as confirmed if the paragraph shares enough word
pairs with one of the family's templates. Which paragraphs are worth scoring follows from the weights themselves: one that holds too
little of them can't be named a licence, whatever else it says.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, narrow

#: N-grams of up to this many words, features at most, share of word pairs that confirms, precision that sets the threshold.
LONGEST, FEATURES, CONFIRMS, PRECISION = 3, 4_096, 0.5, 0.99
NONE, UNKNOWN = "none", "unknown"

#: Everyday words. N-grams of such words and numbers alone are no features, as they say nothing about licences.
EVERYDAY = "a all an and any are as at be but by for from has have if in is it its may must no not of on or so that the their this to was will with you your".split()
#: How much of what it takes to be named a licence the gate may leave out (see Model.gate).
LEFT_OUT = 0.01

# What the licences themselves say, in part, and the names by which notices call them.
TEXTS = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, which is dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
NAMES = {
    "mit": ["the MIT License", "MIT", "the MIT licence"],
    "apache": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0"],
    "gpl": ["the GNU General Public License, version 3", "the GNU General Public License, version 2", "the GNU GPL", "the GPLv3", "GPL-3.0-or-later", "GPL-2.0"],
    "lgpl": ["the GNU Lesser General Public License, version 3", "the LGPL", "LGPL-2.1-or-later"],
    "agpl": ["the GNU Affero General Public License, version 3", "the AGPL", "AGPL-3.0"],
    "bsd": ["the BSD License", "the 3-Clause BSD License", "the Simplified BSD License", "BSD-3-Clause", "BSD-2-Clause"],
    "mpl": ["the Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"],
    "isc": ["the ISC License", "ISC"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "the Creative Commons Attribution License", "CC BY 3.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-3.0", "the Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC-BY-NC-4.0", "CC BY-NC-ND 4.0", "the Creative Commons Attribution-NonCommercial License"],
    "public-domain": ["the Unlicense", "CC0", "CC0 1.0", "CC0-1.0"],
}
FRAMES = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "SPDX-License-Identifier: {}", "This project is distributed under the terms of {}.", "License: {}", "The code is available under {}; see the LICENSE file.", "You may use it under {}."]
OTHERS = [
    "The driver must carry a valid driving licence at all times.", "A fishing license is required for anyone over sixteen.", "She lost her license to practise medicine in the spring.", "The restaurant applied for a liquor license last year.", "You need permission from the owner to enter the field.",
    "He asked for permission to leave the table.", "The warranty on the washing machine lasts two years.", "The extended warranty covers parts and labour.", "Copyright law has changed a great deal since then.", "The lawyer explained how copyright works for songs.",
    "The charity redistributes food to those in need.", "Wealth was redistributed by the new tax.", "The photo is thought to be in the public domain in most countries.", "The council licensed three new taxis this week.", "A licensed plumber should look at the pipes.",
    "The company sells licenses for its fonts.", "Please choose a license for your project before you publish it.", "How do I renew my license plate online?", "The court dismissed the copyright claim.", "The team was granted permission to film on the bridge.",
    "Without warranty, the car was cheaper.", "Creative work and commons are topics of this course.", "The apache helicopter landed near the river.", "A student of MIT won the prize.", "The university is a public institution with general access.", "Version 2.0 of the game came out in May.",
    "The author reserved all rooms at the hotel.", "Their rights were reserved by the treaty.", "Software update 3 is available to download.", "The terms of the agreement were published by the foundation.", "Open the file and copy the text below.", "The following conditions make the road dangerous: ice and fog.",
]


def labelled() -> list[tuple[str, str]]:
    """(family, paragraph): the table that the classifier learns from, the same at every size of corpus."""
    rows = [(family, part) for family, texts in TEXTS.items() for text in texts for part in [text, *(s + "." for s in text.split(". ") if len(s.split()) > 5)]]
    rows += [(family, " ".join(texts)) for family, texts in TEXTS.items()]
    rows += [(family, frame.format(name)) for family, names in NAMES.items() for name in names for frame in FRAMES]
    rows += [("proprietary", f"Copyright (c) {year} {who}. All rights reserved.") for year in (1999, 2012, 2021) for who in ("Example Corp", "the authors", "A. Writer")]
    rows += [(NONE, text) for text in OTHERS]
    # One licence's name is a German word.
    rows += [(NONE, f"{who} mit {what}.") for who in ("Kaffee", "Das Haus", "Er kam", "Wir fahren", "Ein Buch", "Sie spricht") for what in ("Milch", "dem Garten", "seinem Bruder", "der Bahn", "vielen Bildern", "uns")]
    return rows


def _literal(spark: SparkSession, rows: list[tuple], schema: str, names: list[str]) -> DataFrame:
    """A small table, made once from a literal: later plans, and their descriptions, don't carry its text."""
    text = json.dumps([dict(zip(names, row)) for row in rows])
    return cut(spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>"))))


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _grams(words: Column, size: int) -> Column:
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.array_join(F.slice(words, i, size), " "))).otherwise(F.array().cast("array<string>"))


def grams_of(words: Column) -> Column:
    """The distinct n-grams of one to LONGEST words."""
    return F.array_distinct(F.concat(*[_grams(words, n) for n in range(1, LONGEST + 1)]))


class Model:
    """families in order; weights: n-gram -> a weight for each family; intercepts; the calibrated threshold."""

    def __init__(self, families: list[str], grams: list[str], weights: np.ndarray, intercepts: np.ndarray, threshold: float):
        self.families, self.grams, self.intercepts, self.threshold = families, grams, intercepts, threshold
        self.weights = np.round(weights, 4)

    def gate(self) -> tuple[dict[str, float], float] | None:
        """Words with a share each, and the least sum of shares with which a paragraph can be named a licence; None: any can.

        To be named, a paragraph's n-grams must make up for a family's lead of 'none' in the intercepts. Each n-gram's
        largest part of any family's lead is given to one of its words, that of most n-grams; a paragraph whose words' shares
        sum to less than 1 can't be named. Words of the least shares, of LEFT_OUT together, are left out.
        """
        none = self.families.index(NONE)
        others = [i for i in range(len(self.families)) if i != none]
        lead = self.intercepts[none] - self.intercepts[others]
        if (lead <= 0).any():
            return None
        part = (np.maximum(0, self.weights[:, others] - self.weights[:, [none]]) / lead).max(axis=1)
        held: dict[str, int] = {}
        for gram in self.grams:
            for word in set(gram.split()):
                held[word] = held.get(word, 0) + (word not in EVERYDAY and not word.isdigit())
        shares: dict[str, float] = {}
        for gram, p in zip(self.grams, part.tolist()):
            if p > 0:
                owner = max(gram.split(), key=lambda w: (held[w], w))
                shares[owner] = shares.get(owner, 0.0) + p
        left = 0.0
        for word in sorted(shares, key=lambda w: (shares[w], w)):
            if left + shares[word] > LEFT_OUT:
                break
            left += shares.pop(word)
        return shares, 1 - left - 1e-6

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(g, [float(x) for x in w]) for g, w in zip(self.grams, self.weights) if w.any()]
        return _literal(spark, rows, "gram: string, weights: array<double>", ["gram", "weights"])


def train(spark: SparkSession, rows: list[tuple[str, str]] | None = None, precision: float = PRECISION) -> Model:
    """Calibrates on a fifth of the labelled table after a fit on the rest, then fits on the whole table.

    Notices are held out by the name that they give, so no held name was learnt from. The threshold is the least
    probability at which predictions on the held rows are right with that precision; below it a family is unknown.
    """
    rows = rows or labelled()
    families = sorted({f for f, _ in rows} - {NONE}) + [NONE]
    named = {(family, frame.format(name)): at for at, (family, name) in enumerate((f, n) for f, names in NAMES.items() for n in names) for frame in FRAMES}
    held_out = [named.get(row, i) % 5 == 3 for i, row in enumerate(rows)]
    table = _literal(spark, [(i, float(families.index(f)), t, h) for i, ((f, t), h) in enumerate(zip(rows, held_out))], "i: int, label: double, text: string, held: boolean", ["i", "label", "text", "held"])
    telling = lambda gram: F.exists(F.split(gram, " "), lambda w: ~w.isin(EVERYDAY) & w.rlike("[a-z].|.[a-z]"))
    table = table.withColumn("grams", F.filter(grams_of(words_of(F.col("text"))), telling)).coalesce(1).cache()

    def fit(learnt: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
        vectors = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=FEATURES, minDF=1.0).fit(learnt)
        coded = vectors.transform(learnt).cache()
        fitted = LogisticRegression(regParam=0.002, elasticNetParam=0.2, maxIter=60, family="multinomial", standardization=False).fit(coded)
        coded.unpersist()
        return vectors.vocabulary, fitted.coefficientMatrix.toArray().T, fitted.interceptVector.toArray()

    try:
        vocabulary, weights, intercepts = fit(table.where(~F.col("held")))
        held = table.where("held").select("label", "grams").collect()
        whole = fit(table)
    finally:
        table.unpersist()
    at = {g: i for i, g in enumerate(vocabulary)}
    right, wrong = [], []
    for r in held:
        logits = weights[[at[g] for g in r.grams if g in at]].sum(axis=0) + intercepts
        p = np.exp(logits - logits.max())
        p /= p.sum()
        k = int(np.argmax(p))
        if families[k] != NONE:
            (right if k == int(r.label) else wrong).append(float(p[k]))
    # The least probability from which on the held rows' precision holds.
    cuts = sorted({0.35, *right})
    good = [c for c in cuts if (n := sum(x >= c for x in right)) and n / (n + sum(x >= c for x in wrong)) >= precision]
    return Model(families, *whole, min(good, default=0.5))


def templates(spark: SparkSession) -> DataFrame:
    """family, template, pair, n: the distinct word pairs of each template, and how many it has."""
    rows = [(family, text) for family, texts in TEXTS.items() for text in [*texts, " ".join(texts)]]
    rows += [(family, frame.format(name)) for family, names in NAMES.items() for name in names for frame in FRAMES]
    table = _literal(spark, [(i, f, t) for i, (f, t) in enumerate(rows)], "template: int, family: string, text: string", ["template", "family", "text"])
    pairs = F.array_distinct(_grams(words_of(F.col("text")), 2))
    return table.select("template", "family", pairs.alias("pairs")).select("template", "family", F.size("pairs").alias("n"), F.explode("pairs").alias("pair"))


def _holds_one_of(text: Column, words: list[str]) -> Column:
    """Whether a lower-case text has a word that begins like one of the words."""
    starts: dict[str, list[str]] = {}
    for word in sorted(words):
        starts.setdefault(word[0], []).append(word[1:])
    return text.rlike("(?:^|[^a-z0-9])(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in starts.items()) + ")")


def paragraphs(df: DataFrame, model: Model) -> DataFrame:
    """id, k, unit, words: the paragraphs of rows with id, k and text that the model can name a licence (see Model.gate).

    A paragraph is a line, and also a run of lines between empty lines if it has several: notices stand on a line of their
    own, licences go over many.
    """
    lines = F.split("text", "\n")
    runs = F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda p: F.contains(F.trim(p), F.lit("\n")))
    # Between empty lines; a text without any is one run.
    units, rows = F.concat(lines, runs), df.select("id", "k", F.lower("text").alias("text"))
    gate = model.gate()
    if gate is None:
        return rows.select("id", "k", F.posexplode(units).alias("unit", "paragraph")).select("id", "k", "unit", words_of(F.col("paragraph")).alias("words"))
    shares, least = gate
    if not shares:
        return rows.where("false").select("id", "k", F.lit(0).alias("unit"), words_of(F.col("text")).alias("words"))
    found = rows.where(_holds_one_of(F.col("text"), [*shares])).select("id", "k", F.posexplode(F.filter(units, lambda p: _holds_one_of(p, [*shares]))).alias("unit", "paragraph"))
    worded = found.select("id", "k", "unit", words_of(F.col("paragraph")).alias("words"))
    known = F.array(*[F.lit(w) for w in shares])
    share = F.create_map(*[F.lit(x) for item in shares.items() for x in item])
    return worded.where(F.aggregate(F.array_intersect("words", known), F.lit(0.0), lambda total, w: total + F.element_at(share, w)) >= least)


def classify(df: DataFrame, text: str = "text", doc_id: str = "doc_id", model: Model | None = None, confirms: float = CONFIRMS) -> DataFrame:
    """One row for each candidate paragraph: id, k, unit, family (or 'none', 'unknown'), probability, shared, confirmed."""
    spark = df.sparkSession
    model = model or train(spark)
    docs = narrow(df, id=doc_id, text=text).withColumn("k", F.xxhash64("id", "text"))
    # Candidates are kept, so the texts are read once. What is exploded carries nothing of the paragraph but its key.
    units = cut(paragraphs(docs.where("text is not null"), model).dropDuplicates(["id", "k", "unit"])).withColumn("u", F.monotonically_increasing_id())
    grams = units.select("u", F.explode(grams_of(F.col("words"))).alias("gram"))
    # The weights and templates are of fixed size; Spark sees that and broadcasts them.
    joined = grams.join(F.broadcast(model.table(spark)), "gram", "left")
    each = [F.coalesce(F.get("weights", i), F.lit(0.0)) for i in range(len(model.families))]
    sums = joined.groupBy("u").agg(*[F.sum(w).alias(f"w{i}") for i, w in enumerate(each)])
    logits = F.array(*[F.col(f"w{i}") + float(b) for i, b in enumerate(model.intercepts)])
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    scored = units.join(sums, "u").select("u", "id", "k", "unit", "words", powers.alias("powers")).withColumn("best", F.array_position("powers", F.array_max("powers")).cast("int"))
    named = scored.select(
        "u", "id", "k", "unit", "words", F.element_at(F.array(*map(F.lit, model.families)), F.col("best")).alias("named"), (F.array_max("powers") / F.aggregate("powers", F.lit(0.0), lambda a, b: a + b)).alias("probability")
    ).withColumn("family", F.when((F.col("named") != NONE) & (F.col("probability") < model.threshold), UNKNOWN).otherwise(F.col("named")))
    pairs = named.where(~F.col("family").isin(NONE, UNKNOWN)).select("u", "family", F.array_distinct(_grams(F.col("words"), 2)).alias("pairs"))
    met = pairs.select("u", "family", F.size("pairs").alias("m"), F.explode("pairs").alias("pair")).join(F.broadcast(templates(spark)), ["family", "pair"])
    shared = met.groupBy("u", "template").agg((F.count(F.lit(1)) / F.least(F.max("m"), F.max("n"))).alias("shared")).groupBy("u").agg(F.max("shared").alias("shared"))
    out = named.join(shared, "u", "left").withColumn("shared", F.coalesce("shared", F.lit(0.0)))
    return out.select("id", "k", "unit", "family", "probability", "shared", (F.col("shared") >= confirms).alias("confirmed"))


def license_scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", model: Model | None = None, confirms: float = CONFIRMS) -> DataFrame:
    """One row for each row of df: doc_id, family, probability, families, n_paragraphs, n_confirmed, n_unknown.

    family is the confirmed one of highest probability (the first by name of equals), 'unknown' if paragraphs only look
    like a licence, 'none' else; families are all confirmed ones, sorted. Null, empty and licence-free texts give 'none'.
    Rows alike in id and text have the same result. Texts, also very long ones, are read whole; an empty table gives no rows, and
    other columns are not looked at.
    """
    found = classify(df, text, doc_id, model, confirms)
    sure = F.col("confirmed")
    doubtful = (F.col("family") == UNKNOWN) | ~F.col("family").isin(NONE, UNKNOWN) & ~sure
    by_row = found.groupBy("id", "k").agg(
        F.max(F.when(sure, F.struct("probability", F.lit(0).alias("z")))).getField("probability").alias("probability"),
        F.min(F.when(sure, F.struct((-F.col("probability")).alias("p"), F.col("family").alias("f")))).getField("f").alias("family"),
        F.sort_array(F.collect_set(F.when(sure, F.col("family")))).alias("families"), F.count(F.lit(1)).alias("n_paragraphs"), F.count_if(sure).alias("n_confirmed"), F.count_if(doubtful).alias("n_unknown"),
    )
    docs = narrow(df, id=doc_id, text=text).select("id", F.xxhash64("id", "text").alias("k"))
    joined = docs.join(by_row.withColumnsRenamed({"id": "id_", "k": "k_"}), F.col("id_").eqNullSafe(F.col("id")) & (F.col("k_") == F.col("k")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        F.col("id").alias("doc_id"), F.coalesce("family", F.when(F.col("n_unknown") > 0, UNKNOWN), F.lit(NONE)).alias("family"), F.coalesce("probability", F.lit(0.0)).alias("probability"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"), zero("n_paragraphs"), zero("n_confirmed"), zero("n_unknown"),
    )
