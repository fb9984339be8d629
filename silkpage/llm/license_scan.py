"""License scans by a trained paragraph classifier (native: DataFrame functions only).

A paragraph is a line. Its features are the hashes of its different word n-grams, n = 1
to 3. A softmax regression over licence families and an unknown class is trained on the
driver from the fixed wordings below, their parts, and a bounded sample of different
paragraphs of the corpus that have none of the CUES and are not similar to any of the
wordings; n-grams that such paragraphs have are no features, so that what remains is
rare outside licences. The temperature of its
probabilities is fitted on whole wordings and a whole family kept out of training, and a
family needs CONFIDENCE.
A prediction stands only if a wording of the family is found in the paragraph: of the
shorter of the two, SIMILARITY of the word pairs are shared.

Scoring is one scan without shuffle: arrays of hashes per document, and only documents
with a feature are looked at by paragraph.

Defined cases: null and empty texts have no paragraphs and no family; repeated rows are
scanned each; a document's result lists each confirmed family once, in order of name;
columns of other names play no part.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Paragraphs of the corpus that training sees at most.
NEGATIVES = 3_000
CONFIDENCE, SIMILARITY = 0.5, 0.6
#: The family that calibration takes for unknown.
KEPT_OUT = "cc0"
UNKNOWN = "unknown"
CUES = r"(?i)licen[cs]|copyright|rights reserved|warrant|permission|redistribut"
#: Wordings of licence notices, by family.
WORDINGS = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "This article is distributed under the terms of the Creative Commons Attribution License CC BY"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0 1.0 Universal."),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
}
#: Sentences with words of licences that are none, for the unknown class.
LOOKALIKES = (
    "The driver must carry a valid license at all times.",
    "A fishing license is required on the lake.",
    "The public has general rights of way across the field.",
    "Permission to enter the building was granted by the guard.",
    "He was released under the supervision of his general.",
    "The work is under way and the version will be released.",
    "Seats are reserved and all rights of the guests are respected.",
    "The software comes with a warranty of two years.",
)

_WORD = r"[^a-z0-9]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(_WORD, text.lower()) if w]


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _WORD), lambda w: w != F.lit(""))


def _grams(ws: Column) -> Column:
    """Hashes of the n-grams, n = 1 to 3, of an array column that is computed already."""
    n = F.size(ws)

    def of(k: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)))
        return F.when(n >= k, F.transform(at, lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))

    return F.concat(of(1), of(2), of(3))


def _hashed(spark: SparkSession, texts: list[str]) -> list[list[int]]:
    """The n-gram hashes of a few texts of the code or the sample."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("w", _tokens(F.col("t"))).withColumn("w2", F.concat("w", F.array()))
    rows = df.select("i", F.size("w2").alias("n"), F.array_distinct(_grams(F.col("w2"))).alias("g")).collect()
    return [list(r.g) for r in sorted(rows, key=lambda r: r.i)]


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _alike(wordings: Column, grams: Column) -> Column:
    """The largest similarity of different n-grams to one of the wordings; 0 without any."""
    alike = F.transform(wordings, lambda t: F.size(F.array_intersect(t.getField("g"), grams)) / F.greatest(F.least(F.size(t.getField("g")), F.size(grams)), F.lit(1)))
    return F.coalesce(F.array_max(alike), F.lit(0.0))


def _wordings(known: list[tuple[int, list[int]]]) -> Column:
    return _constant([{"f": f, "g": g} for f, g in known], "array<struct<f:int,g:array<bigint>>>")


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of a softmax regression; families and the unknown weigh the same."""
    w, b = np.zeros((x.shape[1], n)), np.zeros(n)
    b[n - 1] = 1.0
    target = np.eye(n)[y]
    weight = np.where(y == n - 1, 0.5 / max(1, (y == n - 1).sum()), 0.5 / max(1, (y != n - 1).sum()))[:, None]
    for _ in range(400):
        err = (_softmax(x @ w + b) - target) * weight
        w -= 12 * (x.T @ err + 1e-5 * w)
        w = np.sign(w) * np.maximum(np.abs(w) - 12 * 2e-6, 0)  # few features keep a weight
        b -= 12 * err.sum(axis=0) * 0.1
    return w, b


def train(docs: DataFrame, text: str = "text", negatives: int = NEGATIVES) -> dict:
    """The model: families, features (hash, weights), intercepts, temperature, wordings.

    The temperature is fitted on a regression that has never seen the last wording of any
    family that has several, nor the whole family KEPT_OUT, which must come out as unknown
    (held_out_loss; held_out_unknown: share of that family's lines that do). The model
    itself is then fitted on all wordings."""
    spark = docs.sparkSession
    families = [*sorted(WORDINGS), UNKNOWN]
    none = len(families) - 1
    known = [(k, s) for k, name in enumerate(families[:-1]) for s in WORDINGS[name]]
    wordings = [(k, sorted(set(gs))) for (k, _), gs in zip(known, _hashed(spark, [s for _, s in known]), strict=True)]
    texts, labels, kept_out = [], [], []
    for k, name in enumerate(families[:-1]):
        for i, s in enumerate(WORDINGS[name]):
            ws = s.split()
            parts = [s, "Copyright 2020 The Authors. " + s, s + " See the file for details.", "Notice: " + s]
            if len(ws) > 11:
                parts += [" ".join(ws[: len(ws) * 2 // 3]), " ".join(ws[len(ws) // 3 :])]
            out = name == KEPT_OUT or 0 < i == len(WORDINGS[name]) - 1
            texts += parts
            labels += [k] * len(parts)
            kept_out += [out] * len(parts)
    texts += LOOKALIKES
    labels += [none] * len(LOOKALIKES)
    kept_out += [i % 5 == 4 for i in range(len(LOOKALIKES))]
    grams = _hashed(spark, texts)
    candidates = sorted({g for gs, k in zip(grams, labels, strict=True) if k != none for g in gs})
    # About `negatives` documents by a hash of their texts, then that many of their different
    # lines. Lines like a wording are none, however often they occur and whatever their words.
    # Of them only the n-grams come here that a wording has too: no more than there are of those.
    one_in = max(1, docs.count() // negatives)
    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(one_in)) == 0)
    lines = some.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("p")).filter(F.trim("p") != "").filter(~F.col("p").rlike(CUES)).distinct()
    lines = lines.filter(_let(F.array_distinct(_let(_tokens(F.col("p")), _grams)), lambda g: _alike(_wordings(wordings), g)) < SIMILARITY)
    lines = lines.select(F.xxhash64("p").alias("h"), F.array_intersect(F.array_distinct(_let(_tokens(F.col("p")), _grams)), _constant(candidates, "array<bigint>")).alias("g"))
    sample = lines.orderBy("h").limit(negatives).collect()
    common = {g for r in sample for g in r.g}
    names = [g for g in candidates if g not in common]
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(texts) + len(sample), len(names)))  # what a sampled line has is no feature
    for r, gs in enumerate(grams):
        x[r, [at[g] for g in gs if g in at]] = 1
    y = np.array(labels + [none] * len(sample))
    out = np.array(kept_out + [i % 5 == 4 for i in range(len(sample))])
    w, b = _fit(x[~out], y[~out], len(families))
    truth = np.where(y == families.index(KEPT_OUT), none, y)[out]
    z = x[out] @ w + b
    losses = {t: -np.log(_softmax(z / t)[np.arange(out.sum()), truth] + 1e-12).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
    temperature = min(losses, key=losses.get)
    best = _softmax(z / temperature)
    strange = y[out] == families.index(KEPT_OUT)
    unknown = (best[strange].argmax(axis=1) == none) | (best[strange].max(axis=1) < CONFIDENCE)
    w, b = _fit(x, y, len(families))
    features = [(h, [round(float(v), 5) for v in w[i]]) for h, i in at.items() if np.abs(w[i]).max() > 1e-4]
    return {
        "families": families, "features": features, "intercepts": [float(v) for v in b], "temperature": temperature, "wordings": wordings,
        "held_out_loss": losses[temperature], "held_out_unknown": float(unknown.mean()),
    }


def _constant(value, kind: str) -> Column:
    """A nested literal: folded once when the plan is optimized."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """df with license_hits: array of (paragraph, family, probability, similarity, confirmed),
    of the paragraphs that have a feature."""
    none = len(model["families"]) - 1
    features = _constant([{"h": h, "w": w} for h, w in model["features"]], "array<struct<h:bigint,w:array<double>>>")
    hashes = _constant([h for h, _ in model["features"]], "array<bigint>")
    wordings = _wordings(model["wordings"])
    base = F.array(*[F.lit(v) for v in model["intercepts"]])
    names = F.array(*[F.lit(n) for n in model["families"]])
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__w", _tokens(body)).withColumn("__any", F.arrays_overlap(_grams(F.col("__w")), hashes))

    def judged(p: Column, found: Column, grams: Column) -> Column:
        z = F.aggregate(
            F.filter(features, lambda m: F.array_contains(found, m.getField("h"))), base, lambda a, m: F.zip_with(a, m.getField("w"), lambda x, y: x + y)
        )

        def rated(z: Column) -> Column:
            e = F.transform(z, lambda v: F.exp((v - F.array_max(z)) / model["temperature"]))
            best = F.array_position(z, F.array_max(z)).cast("int") - 1
            prob = 1.0 / F.aggregate(e, F.lit(0.0), lambda a, v: a + v)

            def confirmed(best: Column) -> Column:
                similar = _alike(F.filter(wordings, lambda t: t.getField("f") == best), grams)
                sure = (best != none) & (prob >= CONFIDENCE)
                return F.struct(
                    p.alias("paragraph"),
                    F.when(sure, F.get(names, best)).otherwise(UNKNOWN).alias("family"),
                    prob.alias("probability"),
                    similar.alias("similarity"),
                    (sure & (similar >= SIMILARITY)).alias("confirmed"),
                )

            return _let(best, confirmed)

        return _let(z, rated)

    # One lambda variable holds each step's value, so nothing is computed twice.
    def paragraph(p: Column, i: Column) -> Column:
        return _let(_tokens(p), lambda ws: _let(F.array_distinct(_grams(ws)), lambda g: _let(F.array_intersect(g, hashes), lambda found: F.when(F.size(found) > 0, judged(i, found, g)))))

    hits = F.filter(F.transform(F.split(body, "\n"), paragraph), lambda h: h.isNotNull())
    return df.withColumn("license_hits", F.when(F.col("__any"), hits)).drop("__w", "__any")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))
    hits = F.coalesce("license_hits", F.array().cast(found.schema["license_hits"].dataType))
    sure = F.filter(hits, lambda h: h.getField("confirmed"))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda h: h.getField("family")))), ",").alias("licenses"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.size(F.filter(hits, lambda h: h.getField("family") == UNKNOWN)).cast("long").alias("n_unknown"),
        F.array_max(F.transform(sure, lambda h: h.getField("probability"))).alias("probability"),
        F.array_max(F.transform(sure, lambda h: h.getField("similarity"))).alias("similarity"),
    )
