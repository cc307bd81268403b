"""Licence scan: a trained paragraph classifier, its unknown class calibrated, its finds confirmed against templates.

A paragraph is a line with a word; a line that goes on in the next one, which begins with a small letter, is one with it.
It becomes hashed word 1- and 2-grams. A sparse logistic regression, one row of weights for each licence family and one
for "unknown", gives probabilities; few grams have weights, so most paragraphs meet none and are unknown at once. A
temperature calibrates them: it is fitted on what models say of templates, other licences and corpus lines that they
were not trained on, whole ones at a time; the last model is then trained on all. A found family is confirmed where the
paragraph and one of the family's templates share enough word 3-grams.

Scoring uses DataFrame functions only. Training runs once, on the driver, on the templates' parts and on the documented
bound of ``sample_lines`` corpus lines as unknown ones, those of smallest hash.

Defined results: null or empty text has no paragraphs and no licence; a paragraph is judged by itself, so repeats count
each; rows that repeat have equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short notices and opening sentences of public licences, by family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is distributed under the Apache Software License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under the Creative Commons Attribution ShareAlike license, CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.",
        "Released under the Creative Commons NonCommercial ShareAlike license, CC BY-NC-SA 4.0.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GNU GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.",
        "Released into the public domain under the Unlicense.",
    ),
}
# Sentences with words of licences that grant none of the families, and notices of other licences.
OTHERS = (
    "The licensed driver had a public version of the general work.",
    "All rights reserved.",
    "A license fee is due each year under the terms of this agreement.",
    "The software version was released to the public under a new name.",
    "Permission to enter the building is granted by the guard.",
    "This work was done at the university in the general department.",
    "He studied at MIT and worked under a professor of law.",
    "The Apache helicopter was released in version two.",
    "Licensed under the terms of our commercial agreement.",
    "The conditions of the binary star were published in a free source.",
    "Licensed under the Eclipse Public License, version 2.0.",
    "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License, version 2.1.",
    "Released under the Boost Software License, version 1.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Licensed under CC BY-ND 4.0.",
    "SPDX-License-Identifier: LGPL-2.1-or-later",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Released under the GNU Lesser General Public License, version 3.",
    "SPDX-License-Identifier: EPL-2.0",
    "Licensed under the Common Development and Distribution License, version 1.0.",
    "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License.",
    "Licensed under the Microsoft Public License.",
    "Released under the ISC License.",
    "Released under the zlib license.",
    "Distributed under the Artistic License 2.0.",
    "Licensed under the Open Software License, version 3.0.",
)
# Names of licences, by family and of others, and forms in which names stand in headings and short notices.
NAMES = {
    "apache": ("Apache License", "Apache License 2.0", "Apache License, Version 2.0", "Apache Software License", "Apache-2.0", "Apache 2.0"),
    "bsd": ("BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "New BSD License", "Simplified BSD License", "BSD-2-Clause", "BSD-3-Clause"),
    "cc-by": ("Creative Commons Attribution License", "Creative Commons Attribution 4.0 International", "CC BY 4.0", "CC BY-SA 4.0", "CC-BY-4.0", "CC-BY-SA-4.0"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial License", "Creative Commons NonCommercial 4.0 International", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC-BY-NC-4.0"),
    "gpl": ("GNU General Public License", "GNU General Public License, version 2", "GNU General Public License v3", "GNU GPL", "GPLv2", "GPLv3", "GPL version 3", "GPL-2.0-only", "GPL-3.0-or-later"),
    "mit": ("MIT License", "MIT License (MIT)", "MIT"),
    "mpl": ("Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"),
    "public-domain": ("Unlicense", "CC0 1.0 Universal", "CC0-1.0"),
}
OTHER_NAMES = (
    "Eclipse Public License",
    "GNU Lesser General Public License",
    "GNU Library General Public License",
    "GNU Affero General Public License",
    "GNU Free Documentation License",
    "LGPLv3",
    "AGPLv3",
    "EPL-2.0",
    "Boost Software License",
    "European Union Public Licence",
    "Common Development and Distribution License",
    "Common Public License",
    "Microsoft Public License",
    "ISC License",
    "zlib License",
    "Artistic License",
    "Open Software License",
    "CC BY-ND 4.0",
    "Creative Commons Attribution-NoDerivatives 4.0 International",
)
FORMS = ("{}", "The {}", "Licensed under {}.", "Released under the {}.", "Distributed under the terms of the {}.", "This project is covered by the {}.", "License: {}")


def templates() -> dict[str, tuple[str, ...]]:
    """All templates of each family: notices, and names in each form; a name of one word stands for itself only if it has a number."""
    alone = lambda name: " " in name or any(c.isdigit() for c in name)
    named = {family: tuple(form.format(name) for name in names for form in FORMS if alone(name) or not form.removeprefix("The ") == "{}") for family, names in NAMES.items()}
    return {family: (*texts, *named[family]) for family, texts in TEMPLATES.items()}


def others() -> tuple[str, ...]:
    """What is no licence of a family: sentences, and names of other licences in each form."""
    return (*OTHERS, *(form.format(name) for name in OTHER_NAMES for form in FORMS))


UNKNOWN = "unknown"
#: A line end inside a sentence.
GOES_ON = r"(?<=[\p{L}\p{N},;])\n(?=\p{Ll})"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.+\-]+"), lambda w: w != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _trimmed(text: Column) -> Column:
    """Words without the points that end a sentence."""
    return F.transform(_words(text), lambda w: F.rtrim(w, F.lit(".-")))


def buckets(text: Column, size: int) -> Column:
    """Hash buckets of the 1- and 2-grams of a paragraph."""

    def grams(w: Column) -> Column:
        one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(size)).cast("int"))
        two = F.transform(w, lambda x, i: F.pmod(F.xxhash64(x, F.coalesce(F.get(w, i + 1), F.lit(""))), F.lit(size)).cast("int"))
        return F.concat(one, two)

    return _let(_trimmed(text), grams)


def grams3(text: Column) -> Column:
    """Distinct word 3-grams of a paragraph, shorter at its end, so that two words have some too."""
    return _let(_trimmed(text), lambda w: F.array_distinct(F.transform(w, lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))))


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last is UNKNOWN
    buckets: np.ndarray  # hash buckets that have weights
    weights: np.ndarray  # bucket by family
    bias: np.ndarray
    temperature: float
    size: int
    known: str  # word 3-grams of each family's templates, as JSON


def train(
    documents: DataFrame,
    *,
    size: int = 1 << 15,
    sample_lines: int = 4_000,
    line_chars: int = 400,
    sparsity: float = 2e-4,
    steps: int = 300,
    folds: int = 4,
) -> Model:
    """Fit the classifier on the templates, on others, and on at most ``sample_lines`` corpus lines.

    The lines are those of smallest hash without "licen" in about ``sample_lines`` / 10 texts, of smallest hash too. Each
    fold leaves out every ``folds``-th template, other sentence and corpus line, whole, and judges them.
    """
    spark = documents.sparkSession
    families = (*sorted(TEMPLATES), UNKNOWN)
    n_docs = max(1, documents.count())
    bound = min(1.0, sample_lines / 10 / n_docs) * 2 - 1  # of hashes, from -1 to 1
    few = documents.where("text is not null").where(F.xxhash64("doc_id") <= F.lit(int(bound * ((1 << 63) - 1)))).select("text")
    lines = few.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line").between(1, line_chars) & ~F.lower("line").contains("licen"))
    lines = lines.distinct().orderBy(F.xxhash64("line"), "line").limit(sample_lines)
    rows = [(UNKNOWN, r.line, k, 1.0) for k, r in enumerate(lines.collect())]  # family, text, which fold leaves it out, weight
    n_lines = len(rows)
    starts = ("", "Note: ", "This document is ", "Copyright 2020 by the authors. ", "All text here is ")
    foreign = others()
    rows += [(UNKNOWN, x, k, max(1.0, 4 * n_lines / len(foreign))) for k, x in enumerate(foreign)]
    for family, texts in templates().items():
        rows += [(family, start + (text[0].lower() + text[1:] if start.endswith("is ") else text), k, 1.0) for k, text in enumerate(texts) for start in starts]
    table = spark.createDataFrame([(k, x) for k, (_, x, _, _) in enumerate(rows)], "k long, text string")
    found = [b for _, b in sorted((r.k, r.b) for r in table.select("k", buckets(F.col("text"), size).alias("b")).collect())]
    used = np.unique(np.concatenate([np.array(b, dtype=np.int64) for b in found[n_lines:]]))  # grams of texts on licences
    x = np.zeros((len(found), len(used)))
    for n, b in enumerate(found):
        x[n, np.searchsorted(used, np.intersect1d(b, used))] = 1.0
    y = np.array([families.index(f) for f, _, _, _ in rows])
    fold, given = np.array([k % folds for _, _, k, _ in rows]), np.array([w for _, _, _, w in rows])
    score = np.zeros((len(y), len(families)))
    for k in range(folds):
        own, other = fold == k, fold != k
        weights, bias = _fit(x[other], y[other], given[other], len(families), sparsity, steps)
        score[own] = x[own] @ weights + bias
    share = _shares(y, given, len(families))
    loss = {t: -(share * np.log(np.maximum(_softmax(score / t)[np.arange(len(y)), y], 1e-12))).sum() for t in TEMPERATURES}
    weights, bias = _fit(x, y, given, len(families), sparsity, steps)
    some = np.flatnonzero(np.abs(weights).sum(axis=1) > 0)
    table = spark.createDataFrame([(f, t) for f, texts in sorted(templates().items()) for t in texts], "family string, text string")
    grams: dict[str, list[list[str]]] = {}
    for r in table.select("family", grams3(F.col("text")).alias("grams")).collect():  # a row a template
        grams.setdefault(r.family, []).append(r.grams)
    return Model(families, used[some], weights[some], bias, float(min(loss, key=loss.get)), size, json.dumps(grams))


#: Temperatures that the calibration tries.
TEMPERATURES = np.geomspace(0.05, 20, 80)


def _shares(y: np.ndarray, given: np.ndarray, classes: int) -> np.ndarray:
    """Weights of rows that add up to the same for each class, and to 1 in all."""
    share = given / np.maximum(np.bincount(y, weights=given, minlength=classes), 1e-9)[y]
    return share / share.sum()


def _fit(x: np.ndarray, y: np.ndarray, given: np.ndarray, classes: int, sparsity: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a multinomial logistic regression by proximal steps, which set small weights to zero."""
    share, target = _shares(y, given, classes), np.eye(classes)[y]
    weights, bias = np.zeros((x.shape[1], classes)), np.zeros(classes)
    for _ in range(steps):
        slope = share[:, None] * (_softmax(x @ weights + bias) - target)
        weights -= 2.0 * (x.T @ slope)
        bias -= 2.0 * slope.sum(axis=0)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - 2.0 * sparsity, 0)
    return weights, bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _constant(values: np.ndarray, kind: str) -> Column:
    """A constant array, written as one string that Spark reads once."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast(f"array<{kind}>")


def scan(documents: DataFrame, model: Model, *, least_probability: float = 0.5, least_similarity: float = 0.6) -> DataFrame:
    """Per document (doc_id, text): n_paragraphs, and its licence paragraphs as licences, an array of structs.

    A struct has the paragraph's place, family, probability, the best share of 3-grams in common with a template of that
    family (of the smaller side), and confirmed. ``family`` is that of the most probable confirmed paragraph, or null.
    """
    place = np.full(model.size, -1)
    place[model.buckets] = np.arange(len(model.buckets))
    where, flat, bias = _constant(place, "int"), _constant(np.round(model.weights, 6).reshape(-1), "double"), _constant(np.round(model.bias, 6), "double")
    n = len(model.families)
    gain = model.weights[:, :-1] - model.weights[:, -1:]
    cues = _constant(np.round(gain.max(axis=1, initial=0.0), 6), "double")  # the most a bucket gives any family over unknown
    least_cues = float((model.bias[-1] - model.bias[:-1]).min()) - 1e-4
    names = F.array(*[F.lit(f) for f in model.families])
    known = F.from_json(F.lit(model.known), "map<string,array<array<string>>>")

    def judge(paragraph: Column, at: Column) -> Column:
        met = F.array_distinct(F.filter(F.transform(buckets(paragraph, model.size), lambda b: F.get(where, b)), lambda p: p >= 0))

        def score(places: Column) -> Column:
            logits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda f: (F.get(bias, f) + F.aggregate(places, F.lit(0.0), lambda a, p: a + F.get(flat, p * n + f))) / F.lit(model.temperature))
            return _let(logits, best)

        def best(z: Column) -> Column:
            top = F.array_max(z)
            total = F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v - top))
            return F.struct(F.get(names, (F.array_position(z, top) - 1).cast("int")).alias("family"), (1 / total).alias("probability"))

        nothing = F.struct(F.lit(UNKNOWN).alias("family"), F.lit(1.0).alias("probability"))
        # where all cues together can't lift a family over unknown, unknown is the most probable
        found = _let(met, lambda places: F.when(F.aggregate(places, F.lit(0.0), lambda a, p: a + F.get(cues, p)) > least_cues, score(places)).otherwise(nothing))
        return _let(found, lambda x: F.struct(at.alias("paragraph"), x["family"].alias("family"), x["probability"].alias("probability"), paragraph.alias("text")))

    def confirm(x: Column) -> Column:
        def shares(own: Column) -> Column:
            return F.array_max(F.transform(F.element_at(known, x["family"]), lambda t: F.size(F.array_intersect(own, t)) / F.least(F.size(own), F.size(t))))

        similarity = _let(grams3(x["text"]), shares)
        several = (F.size(_words(x["text"])) > 1) | x["text"].rlike("[0-9]")  # a word alone may be a word of the language
        sure = (x["probability"] >= least_probability) & (similarity >= least_similarity) & several
        return F.struct(x["paragraph"].alias("paragraph"), x["family"].alias("family"), x["probability"].alias("probability"), similarity.alias("similarity"), sure.alias("confirmed"))

    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), GOES_ON, " ")
    paragraphs = F.filter(F.split(text, "\n"), lambda p: p.rlike(r"[\p{L}\p{N}]"))
    judged = _let(paragraphs, lambda ps: F.struct(F.size(ps).alias("n"), F.filter(F.transform(ps, judge), lambda x: x["family"] != UNKNOWN).alias("found")))
    docs = documents.select("doc_id", judged.alias("_judged"))
    docs = docs.select("doc_id", F.col("_judged.n").cast("long").alias("n_paragraphs"), F.transform("_judged.found", confirm).alias("licences"))
    sure = F.filter("licences", lambda x: x["confirmed"])
    order = F.array_sort(F.transform(sure, lambda x: F.struct((-x["probability"]).alias("p"), x["paragraph"].alias("at"), x["family"].alias("family"))))
    return docs.withColumn("family", F.get(order, 0)["family"])


def scan_corpus(documents: DataFrame, **more) -> DataFrame:
    return scan(documents, train(documents), **more)
