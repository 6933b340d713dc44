"""Licence scans: a trained paragraph classifier whose predictions a template comparison confirms.

A paragraph is a line that is not blank; every one is judged. Its word n-grams (one to three
words) meet the weights of a multinomial logistic regression in a join with a broadcast table of
bounded size; a softmax with a fitted temperature gives probabilities over the families and an
unknown class. A family stands if its probability is at least MIN_PROBABILITY and at least
MIN_OVERLAP of the paragraph's three-word shingles occur in one of its templates. A paragraph
without a shingle of any template cannot be confirmed and is unknown: that exact condition, read
from the templates, spares most lines the join.

The model is fitted on the driver from the templates below, windows of their sentences and
sentences that are no licence, never from the corpus. The temperature is fitted on sentences that
the weights have not seen: each fold's sentences, with all windows of them, are predicted by a
model of the others. The corpus meets SQL expressions only.

Null texts have no paragraphs. A doc_id on several rows is one document: its paragraphs add up,
and each row shows the sum; null doc_ids count as one. Empty tables give empty results. Columns
beyond doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE, read

MIN_PROBABILITY, MIN_OVERLAP = 0.5, 0.6
STEPS, RATE, SHRINK, MAX_GRAM = 200, 0.1, 1e-3, 3
FOLDS = 4
#: Teaching rows of no known n-gram, which are no licence.
BLANKS = 40
UNKNOWN = "unknown"

#: Short notices and the main sentences of well-known licences.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "Released into the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "reserved": ("All rights reserved. Copyright by the publisher.", "Copyright (c) the authors. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."),
}
#: Sentences with words of licences that are no licence.
OTHERS = (
    "He renewed his driving licence last week.", "The licence plate was covered in mud.", "She asked for permission to leave the room.",
    "The shop gives a two year warranty on every bicycle.", "Taxes redistribute income between households.", "A gnu is an antelope that lives in large herds.",
    "The council issued a licence to sell food at the market.", "Copyright law differs from one country to another.", "They were held liable for the damage to the house.",
    "The warrant was signed by a judge.", "The fishing license fee rises every spring.", "Permission to land was granted by the tower.",
    "The public domain is discussed in this article.", "His poetic licence annoyed the critics.", "The lawyer explained liability and copyright to the class.",
)


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_in(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def grams_of(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + n]) for n in range(1, MAX_GRAM + 1) for i in range(len(words) - n + 1)})


def _examples() -> list[tuple[int, str, list[str]]]:
    """(sentence, family, n-grams) of whole sentences, their windows, and windows with a word left out."""
    out, sentence = [], 0
    for family, texts in (*TEMPLATES.items(), (UNKNOWN, OTHERS)):
        for text in texts:
            words = words_in(text)
            runs = [words, *(words[i : i + 12] for i in range(0, max(1, len(words) - 11), 6))]
            runs += [words[:i] + words[i + 1 :] for i in range(0, len(words), 5)]
            out += [(sentence, family, grams_of(r)) for r in runs if r]
            sentence += 1
    return out + [(sentence + i, UNKNOWN, []) for i in range(BLANKS)]


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases; the families count alike whatever the number of their examples."""
    even = (1 / (y @ y.sum(axis=0)))[:, None]
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    for _ in range(STEPS):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - y) * even
        w -= 40 * RATE * (x.T @ error + SHRINK * w / x.shape[1])
        b -= RATE * error.sum(axis=0)
    return w, b


def _table_of(examples: list[tuple[int, str, list[str]]], families: list[str], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.zeros((len(examples), len(number))), np.zeros((len(examples), len(families)))
    for row, (_, family, found) in enumerate(examples):
        known = [number[g] for g in found if g in number]
        if found:
            x[row, known] = 1 / np.sqrt(len(found))
        y[row, families.index(family)] = 1
    return x, y


@lru_cache(maxsize=1)
def unseen() -> tuple[np.ndarray, np.ndarray]:
    """Logits of every example by a model that has not seen its sentence, and the labels."""
    families, examples = [*TEMPLATES, UNKNOWN], _examples()
    fold, logits, labels = np.array([s % FOLDS for s, _, _ in examples]), [], []
    for k in range(FOLDS):
        taught, told = ([e for e, f in zip(examples, fold, strict=True) if (f == k) == held] for held in (False, True))
        number = {g: i for i, g in enumerate(sorted({g for *_, found in taught for g in found}))}
        w, b = _fit(*_table_of(taught, families, number))
        x, y = _table_of(told, families, number)
        logits.append(x @ w + b)
        labels.append(y)
    return np.concatenate(logits), np.concatenate(labels)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def model() -> tuple[list[str], dict[str, list[float]], list[float], float]:
    """Families (the last is unknown), weights by n-gram, biases, temperature."""
    families, examples = [*TEMPLATES, UNKNOWN], _examples()
    number = {g: i for i, g in enumerate(sorted({g for *_, found in examples for g in found}))}
    w, b = _fit(*_table_of(examples, families, number))
    logits, labels = unseen()
    loss = lambda t: float(-(labels * np.log(softmax(logits / t) + 1e-300)).sum())
    temperature = min(np.geomspace(0.02, 5, 80), key=loss)
    return families, {g: [round(float(v), 6) for v in w[i]] for g, i in number.items()}, [round(float(v), 6) for v in b], float(temperature)


def gate(phrases: set[str]) -> str:
    """A pattern of lower-case text for any of the phrases of words, as a tree of their letters."""

    def tree(rest: set[str]) -> str:
        parts = ["(?![a-z0-9])"] if "" in rest else []
        for letter in sorted({r[0] for r in rest if r}):
            parts.append(("[^a-z0-9]++" if letter == " " else letter) + tree({r[1:] for r in rest if r and r[0] == letter}))
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return "(?<![a-z0-9])" + tree(phrases)


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Constant rows as a SQL expression."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def shingle_owners() -> dict[str, list[str]]:
    """The families of each three-word shingle of a template."""
    owners: dict[str, list[str]] = {}
    for family, texts in TEMPLATES.items():
        for shingle in sorted({" ".join(w[i : i + 3]) for t in texts for w in [words_in(t)] for i in range(len(w) - 2)}):
            owners.setdefault(shingle, []).append(family)
    return owners


def _low(text):
    return F.translate(text, _LETTERS, _LETTERS.lower())


def paragraphs(docs: DataFrame, text: bool = True) -> DataFrame:
    """doc_id, line, family, probability, overlap, confirmed (and the paragraph, if text) of every line with a shingle of a template; all others are unknown."""
    spark = docs.sparkSession
    families, weights, biases, temperature = model()
    table = F.broadcast(_table(spark, [{"g": g, "w": w} for g, w in weights.items()], "g:string,w:array<double>"))
    owners = shingle_owners()
    known = F.broadcast(_table(spark, [{"g": s, "families": f} for s, f in owners.items()], "g:string,families:array<string>"))

    shingled = gate(set(owners))
    hinted = docs.filter(_low("text").rlike(shingled)).select("doc_id", F.xxhash64("text").alias("text_id"), F.posexplode(F.split("text", "\n")).alias("line", "paragraph"))
    hinted = hinted.filter(_low("paragraph").rlike(shingled))
    words = F.array_remove(F.split(_low("paragraph"), "[^a-z0-9]+"), "")
    lines = hinted.select(F.monotonically_increasing_id().alias("id"), "doc_id", "text_id", "line", words.alias("words"))

    def grams(n: int):
        whole = F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))
        return F.when(F.size("words") >= n, F.array_distinct(whole)).otherwise(F.array().cast("array<string>"))

    own = ["id", "doc_id", "text_id", "line"]
    lines = lines.select(*own, F.concat(*(grams(n) for n in range(1, MAX_GRAM + 1))).alias("grams"), F.size(grams(3)).alias("n3"))
    each = lines.select(*own, F.size("grams").alias("n"), "n3", F.explode("grams").alias("g"))
    met = each.join(table, "g", "left").join(known, "g", "left")
    sums = [F.coalesce(F.sum(F.get("w", F.lit(i))), F.lit(0.0)).alias(f"s{i}") for i in range(len(families))]
    overlaps = [F.sum(F.array_contains("families", f).cast("int")).alias(f"o{i}") for i, f in enumerate(families[:-1])]
    found = met.groupBy(*own, "n", "n3").agg(*sums, *overlaps)
    logits = F.array(*((F.col(f"s{i}") / F.sqrt(F.greatest("n", F.lit(1))) + biases[i]) / temperature for i in range(len(families))))
    shares = F.array(*(F.coalesce(F.col(f"o{i}"), F.lit(0)) / F.greatest("n3", F.lit(1)) for i in range(len(families) - 1)), F.lit(0.0))
    found = found.select(*own, logits.alias("z"), shares.alias("shares"))
    best = F.array_position("z", F.array_max("z")).cast("int")
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max("z")))
    found = found.select("doc_id", "text_id", "line", F.element_at(F.array(*map(F.lit, families)), best).alias("family"), (1 / total).alias("probability"), F.element_at("shares", best).alias("overlap"))
    sure = (F.col("family") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY) & (F.col("overlap") >= MIN_OVERLAP)
    found = found.withColumn("confirmed", sure)
    if text:
        texts = hinted.dropDuplicates(["doc_id", "text_id", "line"]).withColumnsRenamed({c: f"{c}_" for c in ("doc_id", "text_id", "line")})
        found = found.join(texts, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("text_id") == F.col("text_id_")) & (F.col("line") == F.col("line_")))
    return found.select("doc_id", "line", *(["paragraph"] if text else []), "family", "probability", "overlap", "confirmed")


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    """Per document: its paragraphs, how many a licence family is confirmed for, the others, and the families."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = paragraphs(docs, text=False).filter("confirmed").groupBy(F.col("doc_id").alias("id"))
    found = found.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))).cast("long")
    counted = docs.select("doc_id", n_lines.alias("n_lines"))
    sums = counted.groupBy(F.col("doc_id").alias("of")).agg(F.sum("n_lines").alias("n_lines"))
    joined = counted.select("doc_id").join(sums, F.col("doc_id").eqNullSafe(F.col("of"))).join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return joined.select("doc_id", n.alias("n_license_lines"), (F.col("n_lines") - n).alias("n_unknown_lines"), F.coalesce("families", F.lit("")).alias("families"))
