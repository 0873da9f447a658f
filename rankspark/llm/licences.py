"""Licence notices by a trained classifier on word n-grams, in plain DataFrame expressions.

A multinomial logistic regression with an L1 penalty is fitted on licence notices and on ordinary lines, a bounded sample.
Its weighted n-grams become one constant of the plan, a hash table that each n-gram looks itself up in. Only lines with one
of its gate words are scored: the evidence of all other n-grams together cannot outweigh the intercept of the class "none",
so nothing is lost. A line that its family and template settle is a paragraph; adjacent lines that are not settled alone,
such as a notice wrapped over many, are scored together.

Whether a notice belongs to none of the families is a class of its own, calibrated by leaving families out: models that never
saw a family score its notices, and a logistic curve over the best probability and the share of the template's n-grams parts
these strangers from members.
"""
from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import written

#: Notices by family (fixed values).
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind.",
                   "This project is released under the Apache 2.0 license."],
    "MIT": ["Released under the MIT License.", "This software is licensed under the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version.",
            "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details.",
            "Released under the GPL v3."],
    "LGPL": ["This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License, version 2.1.",
             "Licensed under the LGPL 3.0."],
    "BSD": ["Use of this source code is governed by a BSD-style license.", "Released under the BSD 3-Clause License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the MPL 2.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This text is available under the Creative Commons Attribution-ShareAlike License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "This work is in the public domain under CC0 1.0."],
    "proprietary": ["All rights reserved.", "Copyright, all rights reserved. No part of this publication may be reproduced without prior written permission."],
}
FAMILIES = ("none", *TEMPLATES)
#: Ordinary lines that the classifier is fitted on (those of least hash), and the longest of them in characters.
SAMPLE, LONGEST = 1500, 2000
#: N-grams of a notice up to ORDER words are weighed.
ORDER = 3
#: Groups of families left out in turn for the calibration of the unknown class.
LEFT_OUT = 3
#: Penalty of the weights, and steps of the fit.
PENALTY, STEPS = 1e-4, 400
#: Slots of the hash table of n-grams.
SLOTS = 1 << 12
#: Lines at most so far apart are scored together.
APART = 2
#: Share of a notice's words that makes a line of the documents no ordinary one.
NEAR = 0.6


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(w: Column) -> Column:
    """Distinct runs of one to ORDER words, in time linear in the words."""
    def of(n: int) -> Column:
        def run(x: Column, i: Column) -> Column:
            parts = [x]
            for k in range(1, n):
                parts += [F.lit(" "), F.get(w, i + k)]
            return F.concat(*parts)  # null where the words end
        return F.transform(w, run)
    return F.array_distinct(F.array_compact(F.concat(w, *[of(n) for n in range(2, ORDER + 1)])))


@dataclass(frozen=True)
class Model:
    #: slot -> its n-grams with one weight per family, as JSON; intercepts per family.
    table: str
    intercepts: tuple[float, ...]
    #: Words without one of which no line can be other than "none".
    gate: tuple[str, ...]
    temperature: float
    #: Intercept and weights of the best probability and the template share: the logit of belonging to a family.
    known: tuple[float, float, float]


def _variants(text: str) -> list[str]:
    """A notice as it is, without its last words, with a leading year and holder, within a sentence, and its two halves."""
    w = text.rstrip(".").split()
    out = [text, " ".join(w[:max(3, len(w) * 3 // 4)]), f"Copyright 2021 The Authors. {text}", f"Note: {text} See the file for details.", text.upper()]
    return out + ([" ".join(w[:len(w) // 2]), " ".join(w[len(w) // 2:])] if len(w) >= 20 else [])


def _listed(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def _parts(text: str) -> tuple[set[str], set[tuple[str, str]]]:
    w = _listed(text)
    return set(w), set(zip(w, w[1:], strict=False))


_NOTICES = [_parts(t) for ts in TEMPLATES.values() for t in ts]


def _close(line: str) -> bool:
    """Whether a line shares most words of a notice, or three and most of its own words with one, and some of its word pairs:
    no ordinary line."""
    w, pairs = _parts(line)
    return any((len(w & t) >= NEAR * len(t) or len(w & t) >= max(3, NEAR * len(w))) and len(pairs & p) >= max(1, NEAR / 2 * len(pairs)) for t, p in _NOTICES)


def _ordinary(docs: DataFrame, text: str, sample: int) -> list[str]:
    """At most ``sample`` distinct lines without a legal word and not close to a notice, those of least hash.

    Only lines below a hash that some 4 * sample distinct ones have are told apart and ordered."""
    line = docs.select(F.explode(F.split(F.col(f"`{text}`").cast("string"), "\n")).alias("line")).where(
        f"trim(line) <> '' and length(line) <= {LONGEST} and not lower(line) rlike 'licen[cs]|copyright|rights reserved|permission|public domain'")
    line = line.withColumn("h", F.xxhash64("line"))
    n = line.agg(F.approx_count_distinct("h")).first()[0]
    below = int(min(1.0, 4 * sample / max(n, 1)) * (1 << 64)) - (1 << 63)
    drawn = line.where(F.col("h") < min(below, (1 << 63) - 1)).distinct().orderBy("h", "line").limit(2 * sample).collect()
    return [r.line for r in drawn if not _close(r.line)][:sample]


def _templates() -> Column:
    """Family by number -> the distinct n-grams of each of its notices."""
    def of(text: str) -> list[str]:
        w = _listed(text)
        return sorted({" ".join(w[i:i + n]) for n in range(1, ORDER + 1) for i in range(len(w) - n + 1)})
    return F.from_json(F.lit(json.dumps([[], *([of(t) for t in ts] for ts in TEMPLATES.values())])), "array<array<array<string>>>")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named: Spark would copy a column's expression to every use."""
    return F.get(F.transform(F.array(value), use), 0)


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SLOTS)).cast("int")


def scored(lines: DataFrame, table: str, intercepts: tuple[float, ...], temperature: float) -> DataFrame:
    """``lines`` (w, ...) with score: guess, probability and confirmed_by, the share of the best template's n-grams."""
    known = F.from_json(F.lit(table), "array<array<struct<g:string,v:array<double>>>>")  # constant: folded into one value of the plan

    def logits(g: Column) -> Column:
        hits = F.flatten(F.transform(g, lambda x: F.filter(F.get(known, _slot(x)), lambda e: e["g"] == x)))
        start = F.array(*[F.lit(b / temperature) for b in intercepts])
        return F.aggregate(hits, start, lambda a, e: F.zip_with(a, e["v"], lambda x, y: x + y / temperature))

    def said(g: Column, z: Column, top: Column, best: Column) -> Column:
        share = F.array_max(F.transform(F.get(_templates(), best), lambda t: F.size(F.array_intersect(t, g)) / F.size(t)))
        return F.struct(F.get(F.array(*[F.lit(x) for x in FAMILIES]), best).alias("guess"), F.coalesce(share, F.lit(0.0)).alias("confirmed_by"),
                        (1 / F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v - top))).alias("probability"))
    return lines.withColumn("score", _let(grams(F.col("w")), lambda g: _let(logits(g), lambda z: _let(F.array_max(z), lambda top: _let(
        (F.array_position(z, top) - 1).cast("int"), lambda best: said(g, z, top, best))))))


def _fitted(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of the L1-penalised multinomial regression: accelerated proximal steps from zero."""
    # equal rows count together: most ordinary lines have no n-gram of a notice
    rows, n = np.unique(np.column_stack([x, label]).astype(np.uint8), axis=0, return_counts=True)
    total, n = len(x), n[:, None] ** 0.5
    x, y = np.column_stack([rows[:, :-1], np.ones(len(rows))]), np.eye(len(FAMILIES))[rows[:, -1]]
    v = np.ones(x.shape[1])
    for _ in range(20):
        v = x.T @ (n.ravel() ** 2 * (x @ v))
        v /= np.linalg.norm(v)
    rate = 2 * total / float(np.linalg.norm(n.ravel() * (x @ v)) ** 2)
    b = ahead = np.zeros((x.shape[1], len(FAMILIES)))
    t = 1.0
    for _ in range(STEPS):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - rate * (x.T @ (n * n * (p - y))) / total
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * PENALTY, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead = new + (before - 1) / t * (new - b)
        b = new
    return b[:-1].T, b[-1]


def _packed(slots: list[int], vocabulary: list[str], matrix: np.ndarray) -> str:
    table: list[list[dict]] = [[] for _ in range(SLOTS)]
    for slot, gram, weights in zip(slots, vocabulary, matrix.T, strict=True):
        if np.abs(weights).max() > 1e-6:
            table[slot].append({"g": gram, "v": [round(float(w), 6) for w in weights]})
    return json.dumps(table)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton steps of a slightly ridged logistic regression of a few columns."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        ridge = 1e-2 * np.eye(len(b))
        b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
    return tuple(float(v) for v in b)


def _gate(vocabulary: list[str], matrix: np.ndarray, intercepts: np.ndarray, seen: Counter) -> set[str]:
    """Words such that a line without any of them is "none": per family, the commonest n-grams are left ungated as long as
    their evidence together stays below the lead of "none"; of every other one the word rarest in ordinary lines counts."""
    out = set()
    for k in range(1, len(intercepts)):
        lead, speaks = intercepts[0] - intercepts[k], matrix[k] - matrix[0]
        order = sorted((j for j in range(len(vocabulary)) if speaks[j] > 0), key=lambda j: (-min(seen[w] for w in vocabulary[j].split(" ")), j))
        for j in order:
            rarest = min(vocabulary[j].split(" "), key=lambda w: (seen[w], w))
            if rarest in out:
                continue
            if speaks[j] < lead:
                lead -= speaks[j]
            else:
                out.add(rarest)
    return out


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Fits on the notices and on at most ``sample`` ordinary lines of at most LONGEST characters. Deterministic."""
    spark = docs.sparkSession
    ordinary = _ordinary(docs, text, sample)
    rows = [(float(FAMILIES.index(k)), v) for k, ts in TEMPLATES.items() for t in ts for v in _variants(t)]
    ordinary += [""] * (100 - len(ordinary))  # a small corpus still speaks for "none"
    data = spark.createDataFrame(rows + [(0.0, x) for x in ordinary], "label double, line string")
    data = written(data.withColumn("w", words(F.col("line"))).withColumn("grams", grams(F.col("w"))), "licence-rows")
    drawn = data.orderBy("label", "line").collect()  # bounded by the sample
    label = np.array([int(r.label) for r in drawn])
    count = Counter(g for r in drawn if r.label for g in r.grams)
    vocabulary = sorted(g for g, n in count.items() if n > 1)
    number = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(drawn), len(vocabulary)))
    for i, r in enumerate(drawn):
        x[i, [number[g] for g in r.grams if g in number]] = 1
    slots = {r.g: r.s for r in spark.createDataFrame([(g,) for g in vocabulary], "g string").select("g", _slot(F.col("g")).alias("s")).collect()}
    slots = [slots[g] for g in vocabulary]

    matrix, intercepts = _fitted(x, label)
    raw = x @ matrix.T + intercepts

    def loss(t: float) -> float:
        z = raw / t
        return float((np.logaddexp.reduce(z, axis=1) - z[np.arange(len(z)), label]).sum())
    temperature = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    seen = Counter(w for r in drawn if not r.label for w in set(r.w))

    held = []
    for turn in range(LEFT_OUT):
        stay = (label == 0) | (label % LEFT_OUT != turn)
        m, b = _fitted(x[stay], label[stay])
        own = F.get(F.array(*[F.lit(f) for f in FAMILIES]), F.col("label").cast("int")) == F.col("score.guess")
        held += scored(data.where("label > 0"), _packed(slots, vocabulary, m), tuple(float(v) for v in b), temperature).select(
            own.alias("own"), "score.*").where("guess <> 'none'").collect()
    known = _logistic(np.array([(r.probability, r.confirmed_by) for r in held]).reshape(-1, 2), np.array([float(r.own) for r in held]))
    return Model(_packed(slots, vocabulary, matrix), tuple(float(v) for v in intercepts), tuple(sorted(_gate(vocabulary, matrix, intercepts, seen))), temperature, known)


def scan(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text", gated: bool = True) -> DataFrame:
    """doc_id, paragraph (its first line, from 0), lines, family, probability, confirmed_by: one row per licence paragraph.

    A line that is settled as a family's notice is a paragraph of one line. Other lines with a gate word form a paragraph
    with those at most APART lines away; it has a family, or is "unknown" with the calibrated probability of a stranger, or
    is no licence text and gives no row. ``gated=False`` scores every line, with the same result.

    Null and empty texts have no lines; whole texts are scanned; repeated rows give repeated results; null ids stay null; an
    empty table gives no rows; other columns are not read. Only lines with a gate word are shuffled.
    """
    model = model or fit(docs, text)
    lines = docs.select(F.col(f"`{key}`").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    lines = lines.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("paragraph", "line")).select("doc_id", "row", "paragraph", words(F.col("line")).alias("w"))
    open_ = F.exists("w", lambda w: w.isin(*model.gate))

    def judged(rows: DataFrame) -> DataFrame:
        a, b, c = model.known
        out = rows.select("*", "score.*").drop("score").withColumn("member", 1 / (1 + F.exp(-(a + b * F.col("probability") + c * F.col("confirmed_by")))))
        return out.withColumn("sure", (F.col("guess") != "none") & (F.col("member") >= 0.5))

    def score(rows: DataFrame, name: str) -> DataFrame:
        return written(scored(rows, model.table, model.intercepts, model.temperature), name)
    alone = judged(score(lines.where(open_) if gated else lines, "licence-lines")).where(open_ | (F.col("guess") != "none"))
    order = Window.partitionBy("row").orderBy("paragraph")
    rest = alone.where(~F.col("sure")).select("doc_id", "row", "paragraph", "w").withColumn(
        "starts", F.coalesce(F.col("paragraph") - F.lag("paragraph").over(order) > APART, F.lit(True)).cast("int"))
    rest = rest.withColumn("run", F.sum("starts").over(order)).groupBy("row", "run").agg(
        F.first("doc_id").alias("doc_id"), F.min("paragraph").alias("paragraph"), F.count("*").alias("lines"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "w"))), lambda x: x["w"])).alias("w"))
    found = alone.where("sure").withColumn("lines", F.lit(1).cast("long")).unionByName(judged(score(rest, "licence-runs")).where("guess <> 'none'").drop("run"))
    return found.select(
        "doc_id", F.col("paragraph").cast("long").alias("paragraph"), "lines", F.when(F.col("sure"), F.col("guess")).otherwise("unknown").alias("family"),
        F.round(F.when(F.col("sure"), F.col("probability")).otherwise(1 - F.col("member")), 6).alias("probability"), F.round("confirmed_by", 6).alias("confirmed_by"))
