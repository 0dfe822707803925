"""Licence scan: a sparse n-gram logistic regression over paragraphs, confirmed by templates (DataFrame and SQL only).

A paragraph is a line of a text, or two lines in a row that both may hold a name, where a statement may be
wrapped. Its features are its words and word pairs, those of the model's vocabulary only. The model is
multinomial with one class per licence family and one for unknown paragraphs, trained on the driver by
proximal gradient steps whose shrinkage leaves few weights: on statements of each family with words left out
and added, and, as unknown, on statements of other licences and on prose.

Calibration is by statements and families that training has not seen: statements, other licences and prose
are dealt to folds, each fold is judged by a model fitted without it, and one temperature is chosen that
makes these judgements' probabilities right. A paragraph is of a family only if the family's calibrated
probability reaches ``LEAST_PROBABILITY``.

A prediction is confirmed by a template of its family: the paragraph shares at least ``CONFIRM`` of the word
pairs of the template or of its own, whichever has fewer, and has *all* pairs of the template's name (marked
in the statements below), so that one licence's name is not taken for another's. A line is
judged whole and by its clauses, clauses of more than ``SPAN`` words by overlapping windows too, and every
confirmed family is given once, with its highest probability.

Scoring is one projection over whole texts: weights are constants of the plan, so there is no join,
shuffle or Python on the executors. As only what holds a template's whole name can be confirmed, texts
without any name's rarest word are passed over, and so are lines without a pair of a name in them or across
their ends: that skips work, not results.

Defined cases: null and empty texts have no licence; repeated lines count each; rows with one doc_id are
scanned each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

BUCKETS, LEAST_PROBABILITY, CONFIRM, SEED, FOLDS = 1 << 16, 0.5, 0.3, 3, 3
TOKEN = r"[a-z0-9]+(?:[.][0-9]+)*"

#: Where a line's clauses part; words of a window over a longer clause, and between starts. A family must be
#: found in two windows in a row, since an edge may cut a name down to another family's.
CLAUSE, SPAN, STEP = r"(?i)(?<=[.;!?])\s+|,?\s+(?:and/or|or|and)\s+", 32, 8

#: Statements by which licence families are named or granted; the name in braces must be there whole.
STATEMENTS = {
    "apache": ["Licensed under the {Apache License}, Version 2.0.", "Licensed under the {Apache License}, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.{apache.org/licenses/LICENSE}-2.0", "SPDX-License-Identifier: {Apache-2.0}", "{License: Apache} 2.0", "Released under the {Apache 2.0} license."],
    "bsd": ["{Redistribution and use in source and binary forms}, with or without modification, are permitted provided that the following conditions are met", "Released under the {BSD License}.", "Licensed under the 3-clause {BSD license}.", "SPDX-License-Identifier: {BSD-3-Clause}", "SPDX-License-Identifier: {BSD-2-Clause}", "{License: BSD}", "Neither the {name of the copyright holder nor the names of its contributors} may be used to endorse or promote products"],
    "cc": ["Licensed under {CC BY 4.0}.", "Licensed under {CC BY 3.0}.", "This work is licensed under a {Creative Commons Attribution 4.0} International License.", "Licensed under {CC BY-SA 4.0}.", "Available under the {Creative Commons Attribution-ShareAlike} license.", "SPDX-License-Identifier: {CC-BY-4.0}"],
    "cc-nc": ["Licensed under {CC BY-NC 4.0}.", "This work is licensed under a {Creative Commons Attribution-NonCommercial 4.0} International License.", "Licensed under {CC BY-NC-SA 4.0}.", "For non-commercial use only under the {Creative Commons NonCommercial} license.", "This text is licensed under a {Creative Commons Attribution-NonCommercial-ShareAlike} license."],
    "gpl": ["This work is licensed under the {GNU General Public License}, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the {GNU General Public License} as published by the Free Software Foundation", "Licensed under {the GPL}.", "SPDX-License-Identifier: {GPL-3.0}-or-later", "SPDX-License-Identifier: {GPL-2.0}-only", "{License: GPL}"],
    "lgpl": ["Licensed under the {GNU Lesser General Public License}, version 2.1.", "This library is free software; you can redistribute it under the terms of the {GNU Lesser General Public License}", "SPDX-License-Identifier: {LGPL-2.1}-only", "SPDX-License-Identifier: {LGPL-3.0}-or-later", "Licensed under {the LGPL}.", "{License: LGPL}"],
    "mit": ["Released under the {MIT License}.", "Licensed under the {MIT license}.", "Permission is hereby granted, free of charge, to any {person obtaining a copy of this software and associated documentation files}, to deal in the Software without restriction", "SPDX-License-{Identifier: MIT}", "{License: MIT}", "{Permission is hereby granted, free of charge, to any person obtaining a copy of this software}"],
    "mpl": ["This Source Code Form is subject to the terms of the {Mozilla Public License}, v. 2.0.", "Licensed under the {Mozilla Public License}, version 2.0.", "SPDX-License-Identifier: {MPL-2.0}", "{License: MPL} 2.0"],
    "proprietary": ["{All rights reserved}. No part of this publication may be reproduced without permission.", "Copyright 2020 Example Corp. {All rights reserved}.", "{All rights reserved}.", "{Unauthorized copying} of this file is strictly prohibited. Proprietary and confidential.", "This document is {proprietary and confidential} and may not be copied."],
}

#: Statements of other licences, which are unknown here.
OTHERS = [
    "Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it under the terms of the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-only",
    "Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Distributed under the Boost Software License, Version 1.0.", "Licensed under the Artistic License 2.0.", "This is free and unencumbered software released into the public domain.",
    "Released under the zlib License.", "SPDX-License-Identifier: ISC", "Licensed under the ISC License.", "Licensed under the Common Development and Distribution License.", "Licensed under the European Union Public Licence, version 1.2.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Released into the public domain under CC0 1.0.", "Licensed under the Microsoft Public License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    "This licence agreement is between you and the company.", "You need a software license to open this file.", "See the license for details.", "The General Public Services Committee met in May.",
]

#: Prose that names licences' words without granting anything, and plain prose.
PROSE = [
    "She passed her driving test and got a licence in the spring.", "The bar lost its licence to sell wine after a fire.", "A licence is needed for fishing in this river.", "The general public was invited to the free concert.",
    "The software was released under great pressure in May.", "This work is hard and the terms are not good.", "Version 3 of the plan was worse than version 2.0 of it.", "He wrote a book about the history of the common law.",
    "You may not use this door; use the other one.", "The source of the river is in the hills and its form is long.", "They were granted permission to build a house on the hill.", "The museum is open to the public and free of charge on Sundays.",
    "The conditions for growth are met in warm and wet places.", "With or without him we go to the sea in the morning.", "The names of the streets are written on the walls.", "A person of any kind may join, and all are welcome.",
    "I read that the file was lost and no copy of it remains.", "Our foundation gives help to poor students at school.", "The institute of technology offers courses in the evening.", "What is it that they see when the day is over?",
    "as published by the city in a report on that matter", "either the one or the other at your option", "it is provided by the state to those who want it", "subject to change at any time and in any place",
]


def tokens(paragraph: str) -> list[str]:
    return re.findall(TOKEN, paragraph.lower())


def grams(words: list[str]) -> list[str]:
    return words + pairs_of(words)


def pairs_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def templates() -> dict[str, list[tuple[list[str], list[str]]]]:
    """For each family its statements' pairs and the pairs of the name in them."""
    return {family: [(sorted(set(pairs_of(tokens(t)))), sorted(set(pairs_of(tokens(re.search(r"[{](.*)[}]", t)[1]))))) for t in own] for family, own in STATEMENTS.items()}


def examples(seed: int = SEED, copies: int = 12) -> list[tuple[list[str], str, int]]:
    """Words, class and fold: statements with words left out and prose put before or after, other licences so too, and prose alone.

    What comes from one statement has one fold.
    """
    r = np.random.default_rng(seed)
    prose = [tokens(p) for p in PROSE]
    pick = lambda: prose[r.integers(len(prose))]
    out = [(p, "unknown", k % FOLDS) for k, p in enumerate(prose) for _ in range(2)]
    stated = [(tokens(t), family, k % FOLDS) for family, own in STATEMENTS.items() for k, t in enumerate(own)]
    for words, kind, fold in [*stated, *[(tokens(t), "unknown", k % FOLDS) for k, t in enumerate(OTHERS)]]:
        out.append((words, kind, fold))
        for _ in range(copies):
            kept = [w for w in words if r.random() > 0.08]
            out.append(((pick()[: r.integers(0, 6)] if r.random() < 0.4 else []) + kept + (pick()[: r.integers(0, 6)] if r.random() < 0.4 else []), kind, fold))
    for _ in range(40 * copies):
        a, b = pick(), pick()
        out.append((a[r.integers(len(a)) :] + b[: r.integers(len(b)) + 1], "unknown", int(r.integers(FOLDS))))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _descent(x: np.ndarray, target: np.ndarray, steps: int, rate: float, shrink: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by proximal gradient steps."""
    w, b = np.zeros((x.shape[1], target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
    for _ in range(steps):
        error = (_softmax(x @ w + b) - target) / np.float32(len(x))
        w -= rate * (x.T @ error)
        w = np.sign(w) * np.maximum(np.abs(w) - np.float32(rate * shrink), 0)
        b -= rate * error.sum(0)
    return w, b


@lru_cache(maxsize=1)
def train(steps: int = 160, rate: float = 3.0, shrink: float = 2e-4) -> dict:
    """classes (the last is unknown), bias, temperature, the vocabulary (bucket to weights per class), and accuracy on unseen statements."""
    rows = examples()
    classes = [*STATEMENTS, "unknown"]
    prosaic = {bucket(g) for p in PROSE for g in tokens(p)}  # words of plain prose are no features; pairs may be
    known = sorted({bucket(g) for words, _, _ in rows for g in grams(words)} - prosaic)
    at = {b: k for k, b in enumerate(known)}
    x = np.zeros((len(rows), len(known)), np.float32)
    for k, (words, _, _) in enumerate(rows):
        x[k, [at[b] for b in {bucket(g) for g in grams(words)} if b in at]] = 1
    y, fold = np.array([classes.index(c) for _, c, _ in rows]), np.array([f for _, _, f in rows])
    target = np.eye(len(classes), dtype=np.float32)[y]
    unseen = np.zeros((len(rows), len(classes)))
    for f in range(FOLDS):
        w, b = _descent(x[fold != f], target[fold != f], steps // 2, rate, shrink)
        unseen[fold == f] = x[fold == f] @ w + b
    losses = {t: -np.log(np.maximum(_softmax(unseen / t)[np.arange(len(rows)), y], 1e-12)).mean() for t in np.geomspace(0.1, 10, 60)}
    w, b = _descent(x, target, steps, rate, shrink)
    used = np.flatnonzero(np.abs(w).sum(1) > 0)
    return {"classes": classes, "bias": b, "temperature": float(min(losses, key=losses.get)), "weights": {known[k]: w[k] for k in used}, "accuracy": float((unseen.argmax(1) == y).mean())}


def _numbers(values, kind: str) -> str:
    """SQL for a constant array."""
    return f"cast(split('{','.join(map(str, values))}', ',') AS array<{kind}>)"


def gates() -> tuple[list[str], str]:
    """Words of which a text with any template's name holds one, and a pattern of the names' pairs."""
    prosaic = {w for p in PROSE for w in tokens(p)}
    names = [tokens(re.search(r"[{](.*)[}]", t)[1]) for own in STATEMENTS.values() for t in own]
    anchors = {max(name, key=lambda w: (w not in prosaic, len(w), w)) for name in names}
    after: dict[str, set[str]] = {}
    for name in names:
        for a, b in zip(name, name[1:]):
            after.setdefault(a, set()).add(b)
    pairs = "|".join(f"{re.escape(a)}[^a-z0-9]+(?:{'|'.join(map(re.escape, sorted(b)))})" for a, b in sorted(after.items()))
    return sorted(anchors), f"(?<![a-z0-9])(?:{pairs})"


def _strings(values) -> str:
    return "array(" + ",".join(f"'{v}'" for v in values) + ")"


def licence_paragraphs(docs: DataFrame, keep: list[str], model: dict | None = None, name: str = "licences") -> DataFrame:
    """Columns ``keep`` and, as ``name``, an array of (paragraph, family, probability, line), a row for each family confirmed in a paragraph."""
    model = model or train()
    n, listed = len(model["classes"]), sorted(model["weights"])
    slot = np.zeros(BUCKETS, int)
    slot[listed] = np.arange(len(listed)) + 1
    flat = [repr(float(round(v, 6))) for b in listed for v in model["weights"][b]]
    slots, table_sql, bias = _numbers(slot, "int"), _numbers(flat, "double"), _numbers([repr(float(v)) for v in model["bias"]], "double")
    names = _strings(model["classes"])
    forms = "array(" + ",".join("array(" + ",".join(f"struct({_strings(p)} AS p, {_strings(m)} AS m)" for p, m in own) + ")" for own in templates().values()) + ")"
    words = lambda text: f"regexp_extract_all(lower({text}), r'{TOKEN}', 0)"
    let = lambda v, value, body: f"element_at(transform(array({value}), {v} -> {body}), 1)"
    pairs = "transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i]))"
    pair_list = f"if(size(w) > 1, {pairs}, cast(array() AS array<string>))"
    place = lambda g: f"element_at({slots}, cast(crc32(cast({g} AS binary)) % {BUCKETS} AS int) + 1)"
    hits = f"array_distinct(filter(transform(concat(w, g), x -> {place('x')}), k -> k > 0))"
    logits = f"transform(sequence(1, {n}), f -> aggregate(h, element_at({bias}, f), (s, k) -> s + element_at({table_sql}, (k - 1) * {n} + f)) / {model['temperature']!r}D)"
    chances = let("z", logits, let("m", "array_max(z)", let("e", "transform(z, v -> exp(v - m))", "transform(e, v -> v / aggregate(e, 0D, (s, u) -> s + u))")))
    shared = f"exists(element_at({forms}, c), t -> size(array_intersect(g, t.p)) >= {CONFIRM}D * least(size(array_distinct(g)), size(t.p)) and size(array_except(t.m, g)) = 0)"
    judged = let("q", chances, let("c", "cast(array_position(q, array_max(q)) AS int)", f"if(c < {n} and element_at(q, c) >= {LEAST_PROBABILITY}D, if({shared}, struct(s.o AS o, element_at({names}, c) AS family, element_at(q, c) AS probability), null), null)"))
    of_words = let("g", pair_list, let("h", hits, f"if(size(h) > 0, {judged}, null)"))
    places = f"if(size(v) > {SPAN}, sequence({STEP - SPAN}, size(v) - 1, {STEP}), array(0))"
    windows = f"transform({places}, (o, k) -> struct(if(size(v) > {SPAN}, slice(v, greatest(o, 0) + 1, {SPAN} + least(o, 0)), v) AS w, if(size(v) > {SPAN}, i * 1000000000L + k, -1L) AS o))"
    clauses = f"flatten(transform(split(y.p, r'{CLAUSE}'), (u, i) -> {let('v', words('u'), windows)}))"
    alone = "array(struct(y.w AS w, -1L AS o))"
    spans = let("r", clauses, f"if(size(r) > 1, concat({alone}, filter(r, v -> size(v.w) > 1)), {alone})")
    judgements = lambda spans: f"filter(transform({spans}, s -> {let('w', 's.w', of_words)}), x -> x is not null)"
    found = let("b", judgements(spans), "filter(b, x -> x.o < 0 or exists(b, y -> abs(x.o - y.o) = 1 and y.o >= 0 and x.family = y.family))")
    each = let("a", found, "transform(array_distinct(transform(a, x -> x.family)), f -> struct(y.p AS paragraph, f AS family, array_max(transform(filter(a, x -> x.family = f), x -> x.probability)) AS probability, y.l AS line))")
    # lines with a feature, what each gives alone, then what two in a row give that neither does
    anchors, gate = gates()
    around = "lower(concat(coalesce(right(get(a, l - 1), 64), ''), ' ', p, ' ', coalesce(left(get(a, l + 1), 64), '')))"
    marked = let("a", "split(coalesce(cast(text AS string), ''), '\\n')", f"filter(transform(a, (p, l) -> if(rlike({around}, r'{gate}'), struct(p AS p, l AS l, {words('p')} AS w), null)), x -> x is not null)")
    joined = f"array(struct(concat(slice(x.w, greatest(size(x.w) - {SPAN - 1}, 1), {SPAN}), slice(y.w, 1, {SPAN})) AS w, -1L AS o))"
    own = lambda k: f"transform(d[{k}], z -> z.family)"
    both = f"transform(filter({judgements(joined)}, j -> not array_contains({own('k')}, j.family) and not array_contains({own('k + 1')}, j.family)), j -> struct(concat(x.p, ' ', y.p) AS paragraph, j.family AS family, j.probability AS probability, x.l AS line))"
    wrapped = f"flatten(transform(t, (x, k) -> if(k + 1 < size(t) and t[k + 1].l = x.l + 1, {let('y', 't[k + 1]', both)}, cast(array() AS array<struct<paragraph: string, family: string, probability: double, line: int>>))))"
    found = let("t", marked, let("d", f"transform(t, y -> {each})", f"concat(flatten(d), {wrapped})"))
    nothing = "cast(array() AS array<struct<paragraph: string, family: string, probability: double, line: int>>)"
    result = let("lt", "lower(cast(text AS string))", f"if({' OR '.join(f'contains(lt, {a!r})' for a in anchors)}, {found}, {nothing})")
    return docs.select(*keep, F.expr(result).alias(name))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its families in order, licence paragraphs, and the highest probability."""
    found = licence_paragraphs(table(spark, sf_dir, "documents"), ["doc_id"])
    families = F.array_join(F.array_sort(F.array_distinct(F.expr("transform(licences, x -> x.family)"))), ",")
    return found.select("doc_id", families.alias("families"), F.expr("size(array_distinct(transform(licences, x -> x.line)))").cast("long").alias("n_paragraphs"), F.expr("array_max(transform(licences, x -> x.probability))").alias("probability"))
