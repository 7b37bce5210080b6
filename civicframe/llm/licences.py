"""Licence families of paragraphs: a trained sparse classifier, confirmed by templates, scored in DataFrame functions alone.

Multinomial logistic regression over word uni- and bigrams is trained on the driver from the templates below, cut and altered, against
texts that only talk about licences. The probability is calibrated on held-out alterations by a temperature, and below a threshold the
paragraph is of the unknown class. A prediction is confirmed by the share of a template's bigrams that the paragraph has.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Wording of public licences and of the usual notices.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Zlib": [
        "Licensed under the zlib License.",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Proprietary": ["All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "Copyright. All rights reserved."],
}
#: Short names of licences, as tags and prose have them.
SHORT = {
    "MIT": ["MIT"],
    "Apache-2.0": ["Apache-2.0"],
    "GPL-3.0": ["GPLv3", "GPL-3.0-only", "GPL-3.0-or-later"],
    "GPL-2.0": ["GPLv2", "GPL-2.0-only", "GPL-2.0-or-later"],
    "LGPL": ["LGPLv3", "LGPL-2.1-or-later", "LGPL-3.0-only"],
    "AGPL-3.0": ["AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause"],
    "ISC": ["ISC"],
    "MPL-2.0": ["MPL-2.0"],
    "EPL-2.0": ["EPL-2.0"],
}
TEMPLATES = {f: [*texts, *(form.format(name) for name in SHORT.get(f, ()) for form in ("SPDX-License-Identifier: {}", "licensed under {}", "{} licensed", *["under the {}"] * any(map(str.isdigit, name))))] for f, texts in TEMPLATES.items()}
#: Texts of the unknown class.
OTHER = [
    "The driver's license was issued by the state and the licence number is printed on the card.",
    "A license is required to sell food in this city, and the license fee is paid every year.",
    "The version of the report was published by the foundation under the terms of the agreement.",
    "The public was free to use the copy of the work in the library without restriction.",
    "Please read the terms of service and the privacy policy before you use this site.",
    "The software was released in a new version and the source of the problem was found.",
    "All the rights of the person are reserved by the law of the land.",
    "They granted permission to any person to copy and distribute the notice.",
]
#: Words of which any licence notice has one; a paragraph without them is unknown. Fixed values.
ANCHOR = r"licen[cs]|copyright|\bcc\b|\bcc0\b|creative\W+commons|public\W+domain|redistribut|permission|rights\W+reserved|\bgnu\b|mozilla|eclipse|warrant|\b(?:[al]?gplv?|mpl|epl|bsd|apache)-?\d|\bspdx\b|anyone\W+is\W+free\W+to"
#: Line breaks within a paragraph: in texts with blank lines (or bare comment marks) all others; elsewhere those that a hard wrap may have made, after
#: a line of such a width that ends no sentence.
BLANK = r"\n[^\w\n]*\n"
BREAK = r"(?<=\w[^\w\n]{0,20})\n(?=[^\w\n]*\w)"
WRAP = r"(?<![^\n]{121})(?<![.!?][^\w\s]{0,2}\s{0,2})(?:(?<=[^\n]{60})\n(?=[^\w\n]*\w)|(?<=[^\n]{30})\n(?=[^\w\n]*[\p{Ll}\d]))"
JOIN = "\x01"
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
FAMILIES = (*TEMPLATES, "unknown")
THRESHOLD, CONFIRMED = 0.6, 0.6
#: Bigrams of a template that a paragraph has to have for its share to be taken of the part it covers.
COVERED = 10


def words(text: str) -> list[str]:
    import re

    return re.findall(WORD, text.lower())


def grams(w: list[str]) -> set[str]:
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}


@dataclass
class Model:
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float


def altered(rng: random.Random, text: str, noise: list[str], cut: bool = True) -> list[str]:
    """A cut of the text with words dropped, and other words around it."""
    w = words(text)
    if cut and len(w) > 12 and rng.random() < 0.5:
        n = rng.randint(10, len(w))
        at = rng.randint(0, len(w) - n)
        w = w[at : at + n]
    w = [x for x in w if rng.random() > 0.04]
    pad = lambda: [rng.choice(noise) for _ in range(rng.choice((0, 0, 0, 2, 6, 20)))]
    return pad() + w + pad()


@cache
def train(seed: int = 5, copies: int = 60, epochs: int = 300) -> Model:
    rng = random.Random(seed)
    noise = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8))) for _ in range(400)] + "the of and to in is for on with that by as it are was this be".split()
    data = [(f, altered(rng, t, noise)) for f, ts in TEMPLATES.items() for t in ts for _ in range(copies if len(words(t)) > 3 else copies // 4)]
    data += [("unknown", altered(rng, t, noise)) for t in OTHER for _ in range(copies)]
    data += [("unknown", [rng.choice(noise) for _ in range(rng.randint(1, 60))]) for _ in range(8 * copies)]
    rng.shuffle(data)
    of: dict[str, int] = {}
    for _, w in data:
        for g in grams(w):
            of[g] = of.get(g, 0) + 1
    known = sorted(g for g, n in of.items() if n >= 6)
    at = {g: i for i, g in enumerate(known)}
    x = np.zeros((len(data), len(known)))
    for i, (_, w) in enumerate(data):
        x[i, [at[g] for g in grams(w) if g in at]] = 1
    y = np.eye(len(FAMILIES))[[FAMILIES.index(f) for f, _ in data]]
    held = np.arange(len(data)) % 5 == 0
    w, b = np.zeros((len(known), len(FAMILIES))), np.zeros(len(FAMILIES))

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for _ in range(epochs):
        d = (soft(x[~held] @ w + b) - y[~held]) / (~held).sum()
        w -= 4.0 * (x[~held].T @ d + 1e-5 * w)
        b -= 4.0 * d.sum(0)
    z = x[held] @ w + b
    loss = lambda t: -np.log(np.maximum((soft(z / t) * y[held]).sum(1), 1e-12)).mean()
    temperature = min((0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0), key=loss)
    keep = np.abs(w).max(1) > 0.02
    return Model({g: [round(float(v), 6) for v in w[at[g]]] for g in known if keep[at[g]]}, [round(float(v), 6) for v in b], temperature)


def tables(spark: SparkSession, model: Model) -> tuple[DataFrame, DataFrame]:
    """The weights of each gram, and the bigrams of each template: a few thousand rows."""
    weights = spark.createDataFrame([(g, v) for g, v in model.weights.items()], "gram string, w array<double>")
    rows = [(f, i, g, at, len(b)) for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for w in [words(t)] for b in [[*dict.fromkeys(f"{x} {y}" for x, y in zip(w, w[1:], strict=False))]] for at, g in enumerate(b)]
    return weights, spark.createDataFrame(rows, "family string, template int, gram string, place int, size int")


def paragraphs(docs: DataFrame) -> DataFrame:
    """The paragraphs with an anchor word, and of those of several lines the lines with one too; equal rows once.

    doc_id, paragraph (its first line in the text, from 0) and body; ``run`` and ``of`` name the paragraph that a line is in, ``whole`` is false for such lines.
    """
    sql = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    anchor, join = sql(ANCHOR), f"'{JOIN}'"
    text = f"translate(text, {join}, ' ')"
    joined = f"regexp_replace({text}, case when text rlike {sql(BLANK)} then {sql(BREAK)} else {sql(WRAP)} end, {join})"
    # the lines of the text, those that carry on a paragraph with the mark in front, and where paragraphs begin: all linear in the number of lines
    every = f"split(replace({joined}, {join}, '\n{JOIN}'), '\n')"
    starts = f"filter(transform(every, (x, i) -> if(startswith(x, {join}), -1, i)), i -> i >= 0)"
    runs = "transform(starts, (s, p) -> named_struct('run', s, 'x', array_join(slice(every, s + 1, coalesce(try_element_at(starts, p + 2), size(every)) - s), '')))"
    found = f"filter({runs}, s -> lower(s.x) rlike {anchor})"
    lines = f"filter(transform(split(run.x, {join}), (x, k) -> named_struct('paragraph', run.run + k, 'body', x, 'whole', false)), l -> instr(run.x, {join}) > 0 and lower(l.body) rlike {anchor})"
    units = f"concat(array(named_struct('paragraph', run.run, 'body', replace(run.x, {join}, ' '), 'whole', true)), {lines})"
    out = docs.where(F.lower("text").rlike(ANCHOR)).select("doc_id", F.expr(every).alias("every")).select("doc_id", "every", F.expr(starts).alias("starts"))
    out = out.select("doc_id", F.explode(F.expr(found)).alias("run")).select("doc_id", F.col("run.run").alias("run"), F.xxhash64("run.x").alias("of"), F.explode(F.expr(units)).alias("unit"))
    return out.select("doc_id", "unit.paragraph", "unit.body", "run", "of", "unit.whole").distinct()


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per paragraph found: doc_id, paragraph, family, probability, template_share, confirmed.

    A paragraph is a line or a run of wrapped lines, numbered by its first line. Its lines are scored too, so that a notice among other lines counts: one is a finding
    instead of the paragraph if it has as many of the template's bigrams or is confirmed alone, and besides it if confirmed of another family. The share is that of the template's
    part which the paragraph covers, if that is long enough, else of the whole. Paragraphs of the unknown class aren't findings, so null and empty texts, and an empty table, give no rows. Null
    ids stay null; repeated rows of one id and text give one finding. Other columns are ignored. Only paragraphs with an anchor word are shuffled.
    """
    model = model or train()
    weights, templates = tables(docs.sparkSession, model)
    found = paragraphs(docs).withColumn("words", F.regexp_extract_all(F.lower("body"), F.lit(WORD), F.lit(0)))
    pairs = F.expr("if(size(words) < 2, array(), transform(sequence(1, greatest(size(words) - 1, 1)), i -> concat(words[i - 1], ' ', words[i])))")
    by = ["doc_id", "paragraph", F.xxhash64("body").alias("mark"), "run", "of", "whole"]
    rows = found.select(*by, F.explode(F.array_distinct(F.concat("words", pairs))).alias("gram"))
    n = len(FAMILIES)
    key = ["doc_id", "paragraph", "mark", "run", "of", "whole"]
    sums = rows.join(F.broadcast(weights), "gram").groupBy(*key).agg(*(F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(n)))
    z = F.array(*((F.col(f"z{i}") + model.bias[i]) / model.temperature for i in range(n)))
    scored = sums.select(*key, z.alias("z")).withColumn("top", F.array_max("z"))
    scored = scored.select(*key, F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("z", F.col("top")).cast("int")).alias("family"), (1 / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))).alias("probability"))
    shares = rows.join(F.broadcast(templates), "gram").groupBy(*key, "family", "template").agg(F.count("*").alias("had"), F.first("size").alias("size"), (F.max("place") - F.min("place") + 1).alias("part"))
    shares = shares.withColumn("share", F.col("had") / F.when(F.col("had") >= COVERED, F.col("part")).otherwise(F.col("size")))
    shares = shares.groupBy(*key, "family").agg(F.max("share").alias("share"), F.max("had").alias("had"))
    same = [scored[k].eqNullSafe(shares[k]) for k in (*key, "family")]
    out = scored.where((F.col("family") != "unknown") & (F.col("probability") >= THRESHOLD)).join(shares, same, "left")
    share = F.coalesce("share", F.lit(0.0))
    out = out.select(*(scored[k] for k in (*key, "family")), F.round("probability", 6).alias("probability"), F.round(share, 6).alias("template_share"), (share >= CONFIRMED).alias("confirmed"), F.coalesce("had", F.lit(0)).alias("had"))
    w = Window.partitionBy("doc_id", "run", "of")
    most = lambda where, x: F.max(F.when(where, x)).over(w)
    whole, line = F.col("whole"), ~F.col("whole") & F.col("confirmed")
    out = out.select("*", *(most(whole, F.col(x)).alias(f"run_{x}") for x in ("family", "confirmed", "had")), F.coalesce(most(line, F.lit(True)), F.lit(False)).alias("lines"))
    as_much = F.coalesce(most(line & (F.col("family") == F.col("run_family")), F.col("had")) >= F.col("run_had"), F.lit(False))
    out = out.withColumn("run_found", F.col("run_family").isNotNull() & (F.col("run_confirmed") | ~F.col("lines")) & ~as_much)
    out = out.where(F.when(whole, F.col("run_found")).otherwise(~F.col("run_found") | F.col("confirmed") & (F.col("family") != F.col("run_family"))))
    return out.select("doc_id", "paragraph", "family", "probability", "template_share", "confirmed")
