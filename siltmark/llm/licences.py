"""Licence notices in texts: a trained paragraph classifier. DataFrame functions only on the main path.

Paragraphs are lines, and windows of consecutive lines, joined, within a block between blank
lines; longer lines are cut into pieces that windows join again. A window holds the longest
template wherever it begins in the window's first line. Texts that don't hold enough of any
template as a whole are left out first, which loses nothing.

Paragraphs are described by the words and word pairs they hold. A sparse multinomial logistic
regression, fitted on the driver from notice templates and a bounded sample of the corpus's
paragraphs, has weights for the templates' n-grams only. So scoring is a join of the n-grams
of all paragraphs with one small table, whose size is that of the templates, and a sum. The
temperature of the scores is calibrated on held-out variants; a paragraph of which no family
is likely enough is unknown. A prediction is confirmed if the paragraph holds enough of
the n-grams of one of the family's templates. A paragraph can have several families: each must be
likely with the others confirmed set aside, and hold enough of what its template has beyond
the templates confirmed of likelier families.
"""

from __future__ import annotations

import json
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import written

#: Notices by family. A number stands for any.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file in the project root.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "bsd": (
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    "cc_by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc_by_sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc_by_nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "public_domain": ("This is free and unencumbered software released into the public domain.", "Dedicated to the public domain under CC0 1.0 Universal."),
    "proprietary": ("All rights reserved. No part of this work may be reproduced without written permission.", "Copyright. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
#: Sentences that speak of licences and aren't notices.
OTHERS = (
    "The driver lost her license after the accident.",
    "A fishing license is required under the law of the state.",
    "The work was released in the version of the author.",
    "He asked for permission to use the source of the river.",
    "The general public was free to modify the terms.",
    "This software is distributed to any person without a fee.",
)
UNKNOWN = "unknown"
#: A family's calibrated probability, and the part of a template's n-grams held, from which a prediction stands.
LIKELY, HELD = 0.5, 0.6
#: Paragraphs of the corpus in the fit, about, and characters of each.
SAMPLE, SAMPLE_CHARS = 600, 600
_TOKEN = "[a-z0-9]+"
_STOP = frozenset("a an and any are as be by for from in is it may not of on or that the this to with you".split())


def _tokens(text: str) -> list[str]:
    return ["0" if t.isdigit() else t for t in re.findall(_TOKEN, text.lower())]


def _grams(text: str) -> set[str]:
    t = _tokens(text)
    plain = _STOP | {"0"}
    return {x for x in t if x not in plain} | {f"{a} {b}" for a, b in zip(t, t[1:], strict=False) if not (a in plain and b in plain)}


#: Words of the longest template, of a line that is one piece, and in which a window's pieces begin.
LONGEST = max(len(_tokens(t)) for ts in TEMPLATES.values() for t in ts)
PIECE, SPAN = 2 * LONGEST, 3 * LONGEST


class Model:
    """Vocabulary, weights (n-grams by families, unknown last), bias and temperature."""

    def __init__(self, corpus: list[str] = (), seed: int = 0):
        rng = random.Random(seed)
        self.families = [*TEMPLATES, UNKNOWN]
        self.templates = [(f, _grams(t)) for f, ts in TEMPLATES.items() for t in ts]
        self.vocabulary = sorted(set().union(*(g for _, g in self.templates)))
        texts, labels = [], []
        noise = sorted({w for t in (*corpus, *OTHERS) for w in _tokens(t)}) or ["x"]
        for f, ts in TEMPLATES.items():
            for t in ts:
                for k in range(12):
                    kept = [w for w in t.split() if k == 0 or rng.random() > 0.08]
                    extra = [rng.choice(noise) for _ in range(rng.choice((0, 0, 10, 40)))]
                    texts.append(" ".join([*extra, *kept, *extra[:5]]))
                    labels.append(self.families.index(f))
        for t in (*OTHERS * 12, *corpus):
            texts.append(t)
            labels.append(len(self.families) - 1)
        for _ in range(300):  # scattered words of notices aren't one
            words = [w for w in rng.choice(rng.choice(list(TEMPLATES.values()))).split() if rng.random() < 0.35]
            rng.shuffle(words)
            texts.append(" ".join(words))
            labels.append(len(self.families) - 1)
        at = {g: i for i, g in enumerate(self.vocabulary)}
        x = np.zeros((len(texts), len(at)))
        for i, t in enumerate(texts):
            x[i, [at[g] for g in _grams(t) if g in at]] = 1
        y = np.eye(len(self.families))[labels]
        held = np.arange(len(texts)) % 5 == 0
        self.weights, self.bias = self._fit(x[~held], y[~held])
        self.temperature = self._calibrated(x[held] @ self.weights + self.bias, y[held])

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 4.0, l1: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
        """Proximal gradient descent: weights that don't matter become zero."""
        w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
        for _ in range(rounds):
            d = (self._softmax(x @ w + b) - y) / len(x)
            w -= rate * (x.T @ d)
            b -= rate * d.sum(axis=0)
            w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        return w, b

    def _calibrated(self, z: np.ndarray, y: np.ndarray) -> float:
        loss = {t: -np.log((self._softmax(z / t) * y).sum(axis=1) + 1e-12).mean() for t in np.geomspace(0.25, 4, 25)}
        return float(min(loss, key=loss.get))

    def families_of(self, text: str) -> list[tuple[str, float]]:
        """The same decisions in plain Python, for a paragraph: families and scores, the likeliest first."""
        g = _grams(text)
        z = sum((self.weights[i] for i, v in enumerate(self.vocabulary) if v in g), self.bias)
        p = self._softmax(z[None] / self.temperature)[0]
        held = [(self.families.index(f), t) for f, t in self.templates if len(t & g) / len(t) >= HELD]
        other = sum(p[k] for k in range(len(p)) if k not in {f for f, _ in held})
        likely = [(f, t) for f, t in held if p[f] >= LIKELY * (p[f] + other)]
        apart = [f for f, t in likely if all(len(t & g - u) >= HELD * len(t - u) > 0 for f2, u in likely if (p[f2], -f2) > (p[f], -f))]
        return [(self.families[f], float(p[f] / (p[f] + other))) for f in sorted(set(apart), key=lambda f: (-p[f], f))]

    def predict(self, text: str) -> tuple[str, float]:
        """The likeliest family of a paragraph."""
        return next(iter(self.families_of(text)), (UNKNOWN, 0.0))

    def table(self, spark: SparkSession) -> DataFrame:
        """(gram, i, w, t): weights by family, and the templates that have the n-gram; one row for each n-gram of the templates."""
        rows = [{"gram": v, "i": i, "w": [round(float(a), 9) for a in self.weights[i]], "t": [k for k, (_, g) in enumerate(self.templates) if v in g]} for i, v in enumerate(self.vocabulary)]
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<gram:string,i:int,w:array<double>,t:array<int>>>")))

    def template_table(self, spark: SparkSession) -> DataFrame:
        """(k, f, g): of each template its family's place and its n-grams."""
        at = {g: i for i, g in enumerate(self.vocabulary)}
        rows = [{"k": k, "f": self.families.index(f), "g": sorted(at[x] for x in g)} for k, (f, g) in enumerate(self.templates)]
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<k:int,f:int,g:array<int>>>")))


def _words(text: str) -> Column:
    """Lower-case words, numbers as 0."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0)), lambda w: F.when(w.rlike("^[0-9]+$"), "0").otherwise(w))


def _pairs(words: str) -> Column:
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def pieces(texts: DataFrame, text: str, key: str) -> DataFrame:
    """(key, seg, line, words, before, start): lines with a letter, long ones in pieces, numbered in a text.

    before is the last word of the piece before in the block; start is the first piece of
    the block from which a window reaches this one.
    """
    w = Window.partitionBy(key).orderBy("line")
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "of"))
    lines = lines.withColumn("block", F.count_if(~F.col("of").rlike("[A-Za-z]")).over(w)).where("of rlike '[A-Za-z]'").select(key, "line", "block", _words("of").alias("all"))
    # a line of PIECE words is whole; a longer one is cut at every LONGEST words
    step = F.when(F.size("all") <= PIECE, F.lit(PIECE)).otherwise(F.lit(LONGEST))
    cut = F.transform(F.sequence(F.lit(1), F.size("all"), step), lambda a: F.slice("all", a, step))
    segments = lines.select(key, "line", "block", F.posexplode(cut).alias("piece", "words"))
    in_block = Window.partitionBy(key, "block").orderBy("line", "piece")
    segments = segments.withColumn("seg", F.row_number().over(Window.partitionBy(key).orderBy("line", "piece")))
    segments = segments.withColumn("before", F.lag(F.element_at("words", -1)).over(in_block)).withColumn("at", F.sum(F.size("words")).over(in_block) - F.size("words"))
    reach = Window.partitionBy(key, "block").orderBy("at").rangeBetween(-SPAN, 0)
    return segments.withColumn("start", F.min("seg").over(reach)).select(key, "seg", "line", "words", "before", "start")


def fit(docs: DataFrame, text: str = "text") -> Model:
    """A model whose unknown class knows a hash sample of the corpus's paragraphs, of at most SAMPLE (about)."""
    n = docs.count()
    rate = min(1.0, SAMPLE / max(1, n))
    h = F.xxhash64(F.col(text), F.lit("licences"))
    picked = docs.where(F.col(text).isNotNull() & (F.pmod(h, F.lit(1 << 30)) < int(rate * (1 << 30)) + 1)).select(h.alias("h"), F.split(text, "\n").alias("p"))
    some = picked.select("h", F.substring(F.get("p", F.pmod("h", F.size("p")).cast("int")), 1, SAMPLE_CHARS).alias("line")).distinct()
    lines = [r.line for r in some.orderBy("h", "line").limit(2 * SAMPLE).collect()]
    # a notice among the sample must not teach that notices are unknown
    first = Model()
    return Model([x for x in lines if first.predict(x)[0] == UNKNOWN and not re.search(r"licen[sc]e|copyright|all rights reserved", x, re.I)])


def _softmax(scores: Column, bias: list[float], temperature: float) -> Column:
    z = F.transform(F.zip_with(scores, F.array(*[F.lit(b) for b in bias]), lambda a, b: a + b), lambda v: v / temperature)

    def share(z_: Column) -> Column:
        e = F.transform(z_, lambda v: F.exp(v - F.array_max(z_)))
        return F.element_at(F.transform(F.array(e), lambda e_: F.transform(e_, lambda v: v / F.aggregate(e_, F.lit(0.0), lambda a, x: a + x))), 1)

    return F.element_at(F.transform(F.array(z), share), 1)


def find_licences(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds licences: an array of (paragraph, family, score, held), one for each notice, in order.

    paragraph counts the text's lines from 0, and is the first one of a notice over several; score is
    the calibrated probability with other families confirmed set aside; held is the part of
    the best template of the family that the paragraph has. Windows that overlap and have the same
    family are one notice, none where a line of them has the family by itself. A null or empty text has
    no notices. Repeated rows each get theirs; a column named licences is replaced. keep:
    columns to carry (default: all).
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c != "licences"]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64(text).alias("__h"), F.col(text).alias("__text"))
    table, n, m = model.table(spark), len(model.families), len(model.templates)
    least = [HELD * len(g) for _, g in model.templates]
    vocabulary, templates = F.broadcast(table), F.broadcast(model.template_table(spark))
    # texts that hold enough of a template as a whole; equal texts give the same n-grams, counted once
    whole = rows.where("__text is not null").select("__h", _words("__text").alias("words"))
    grams = whole.select("__h", F.explode(F.array_distinct(F.concat("words", _pairs("words")))).alias("gram"))
    once = grams.join(F.broadcast(table.select("gram")), "gram", "left_semi").distinct().join(vocabulary, "gram")
    counts = once.groupBy("__h").agg(*[F.count_if(F.array_contains("t", k)).alias(f"t{k}") for k in range(m)])
    able = counts.where(F.greatest(*[F.col(f"t{k}") / x for k, x in enumerate(least)]) >= 1).select("__h")
    texts = rows.select("__h", "__text").join(able, "__h", "left_semi").dropDuplicates(["__h"])
    # n-grams of pieces, and of windows from every piece; a pair over the edge is not the first piece's
    parts = written(pieces(texts, "__text", "__h"), "licence-pieces")
    own = F.transform(F.concat("words", _pairs("words")), lambda g: F.struct(g.alias("gram"), F.col("seg").alias("last")))
    edge = F.when(F.col("before").isNotNull(), F.array(F.struct(F.concat_ws(" ", "before", F.get("words", F.lit(0))).alias("gram"), (F.col("seg") - 1).alias("last")))).otherwise(F.array().cast("array<struct<gram:string,last:int>>"))
    met = parts.select("__h", "seg", "start", F.inline(F.concat(own, edge))).join(vocabulary.select("gram"), "gram", "left_semi")
    single = met.where("last = seg").select("__h", F.col("seg").alias("s"), F.lit(True).alias("single"), "gram")
    windows = met.where("start <= last").select("__h", F.explode(F.sequence("start", "last")).alias("s"), F.lit(False).alias("single"), "gram")
    held_grams = single.unionByName(windows).distinct().join(vocabulary, "gram")
    unit = ["__h", "s", "single"]
    sums = [F.sum(F.get("w", F.lit(k))).alias(f"w{k}") for k in range(n)] + [F.count_if(F.array_contains("t", k)).alias(f"t{k}") for k in range(m)]
    scored = held_grams.groupBy(*unit).agg(F.collect_list("i").alias("has"), *sums).where(F.greatest(*[F.col(f"t{k}") / x for k, x in enumerate(least)]) >= 1)
    held = F.array(*[F.col(f"t{k}") / float(len(g)) for k, (_, g) in enumerate(model.templates)])
    chance = scored.select(*unit, "has", held.alias("held"), _softmax(F.array(*[F.col(f"w{k}") for k in range(n)]), model.bias.tolist(), model.temperature).alias("p"))
    of = chance.crossJoin(templates).withColumn("held", F.get("held", F.col("k"))).where(F.col("held") >= HELD).withColumn("pf", F.get("p", F.col("f")))
    confirmed = F.collect_set("f").over(Window.partitionBy(*unit))
    other = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda a, k: a + F.when(F.array_contains("c", k), 0.0).otherwise(F.get("p", k)))
    of = of.withColumn("c", confirmed).withColumn("score", F.col("pf") / (F.col("pf") + other)).where(F.col("score") >= LIKELY)
    rivals = F.collect_list(F.struct("pf", "f", "g")).over(Window.partitionBy(*unit))

    def beyond(r: Column) -> Column:
        rest = F.array_except("g", r["g"])
        likelier = (r["pf"] > F.col("pf")) | ((r["pf"] == F.col("pf")) & (r["f"] < F.col("f")))
        return ~likelier | ((F.size(rest) > 0) & (F.size(F.array_intersect(rest, F.col("has"))) >= HELD * F.size(rest)))

    apart = of.withColumn("rivals", rivals).where(F.forall("rivals", beyond)).groupBy(*unit, "f").agg(F.max("held").alias("held"), F.first("score").alias("score"))
    # windows' last pieces; those that overlap are one notice, of the window that holds most and begins last
    lasts = parts.select("__h", F.explode(F.sequence("start", "seg")).alias("s"), "seg").groupBy("__h", "s").agg(F.max("seg").alias("end"))
    found = written(apart.join(lasts, ["__h", "s"]).withColumn("end", F.when(F.col("single"), F.col("s")).otherwise(F.col("end"))), "licence-found")
    alone = found.where("single")
    w = found.where("not single").join(alone.select("__h", "f", F.col("s").alias("a")), ["__h", "f"], "left").groupBy("__h", "f", "s", "end", "held", "score").agg(F.coalesce(F.bool_or(F.col("a").between(F.col("s"), F.col("end"))), F.lit(False)).alias("in")).where("not in")
    order = Window.partitionBy("__h", "f").orderBy("s")
    w = w.withColumn("new", F.coalesce(F.col("s") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    w = w.withColumn("island", F.count_if("new").over(order)).groupBy("__h", "f", "island").agg(F.max_by(F.struct("s", "held", "score"), F.struct("held", "s")).alias("b")).select("__h", "f", "b.*")
    notices = alone.select("__h", "f", "s", "held", "score").unionByName(w.select("__h", "f", "s", "held", "score")).join(parts.select("__h", F.col("seg").alias("s"), F.col("line").cast("long").alias("paragraph")), ["__h", "s"])
    notices = notices.groupBy("__h", "paragraph", "f").agg(F.max("score").alias("score"), F.max("held").alias("held"))
    families = F.array(*[F.lit(f) for f in model.families])
    # a text's notices are at most its lines times the families
    of = notices.groupBy("__h").agg(F.array_sort(F.collect_list(F.struct("paragraph", F.get(families, F.col("f")).alias("family"), "score", "held"))).alias("licences"))
    none = F.array().cast("array<struct<paragraph:bigint,family:string,score:double,held:double>>")
    return rows.drop("__text").join(of, "__h", "left").select(*[F.col(f"`{c}`") for c in keep], F.coalesce("licences", none).alias("licences"))
