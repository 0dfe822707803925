import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import op2_line_crf as L
from lodestone.llm import op6_licences as C
from lodestone.llm import op7_quality as Q
from lodestone.llm import op10_toxicity as T

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def truth(tables):
    return {r.doc_id: (r.quality, r.toxic) for r in tables[1].collect()}


def test_quality_held_out(spark, truth):
    rows = [r for r in Q.op7_quality(spark, SF).collect() if r.held_out and r.doc_id in truth]
    right = np.mean([r.predicted == truth[r.doc_id][0] for r in rows])
    assert len(rows) > 500 and right > 0.98 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_labels_of_the_held_out_fold_do_not_matter(spark, tables):
    docs, labels = tables
    docs = docs.where("doc_id < 1500")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.train(docs, labels, 300, 300), Q.train(docs, turned, 300, 300)
    assert all((x == y).all() for x, y in zip(a["params"], b["params"]))


def test_prior():
    r = np.random.default_rng(0)
    good = lambda n: r.normal(0, 1, (n, Q.N_FEATURES))
    bad = lambda n: r.normal(0, 1, (n, Q.N_FEATURES)) + np.r_[4.0, np.zeros(Q.N_FEATURES - 1)]
    assert abs(Q.estimate_prior(good(2000), np.vstack([good(1400), bad(600)])[r.permutation(2000)]) - 0.7) < 0.08


def test_lines_held_out(spark, truth):
    rows = [r for r in L.op2_line_crf(spark, SF).collect() if r.doc_id in truth and not r.base_failed]
    clean, junk = [r for r in rows if truth[r.doc_id][0] == 1], [r for r in rows if truth[r.doc_id][0] == 0]
    assert np.mean([r.kept for r in clean]) > 0.99 and np.mean([r.kept for r in junk]) < 0.1


def test_field_decodes_like_brute_force():
    import itertools

    r = np.random.default_rng(1)
    for n in (1, 2, 6):
        field, x = L.LineField(r.normal(size=(L.N_FEATURES, 2)), r.normal(size=(2, 2))), r.normal(size=(n, L.N_FEATURES))
        e = x @ field.emit
        value = lambda p: sum(e[k, s] for k, s in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))
        assert abs(value(field.decode(x)) - max(map(value, itertools.product((0, 1), repeat=n)))) < 1e-9


def test_field_learns_transitions():
    r = np.random.default_rng(2)
    sequences = []
    for _ in range(60):
        y = np.repeat(r.integers(0, 2, 4), r.integers(2, 6, 4))
        x = r.normal(size=(len(y), L.N_FEATURES))
        x[:, 0] += 1.2 * (2 * y - 1)
        sequences.append((x, y))
    field = L.LineField.fit(sequences)
    assert field.move[0, 0] + field.move[1, 1] > field.move[0, 1] + field.move[1, 0] and np.mean(np.concatenate([np.array(field.decode(x)) == y for x, y in sequences])) > 0.9


def brute_repeats(words, w=5):
    seen = {}
    for k in range(len(words) - w + 1):
        seen.setdefault(tuple(words[k : k + w]), []).append(k)
    return len({k + j for places in seen.values() if len(places) > 1 for k in places for j in range(w)})


def test_base_counts():
    r = np.random.default_rng(3)
    for n, v in ((0, 3), (4, 2), (60, 2), (300, 6), (400, 5000)):
        words = [f"w{k}" for k in r.integers(0, v, n)]
        words = words + words[: n // 3]
        assert L.repeated_window_words([w.encode() for w in words]) == brute_repeats(words)
    big = [f"w{k}" for k in range(9000)] * 2
    assert L.repeated_window_words([w.encode() for w in big]) == 18000
    lines, repeated = L.lines_of("a b\n\n a b\na b\n \t\nx#|")
    assert repeated == [False, False, True, False] and L.base_counts("a b\n\n a b\na b\n \t\nx#|", repeated) == (7, 9, 2, 1, 0)


def test_toxicity_held_out(spark, truth):
    rows = [r for r in T.op10_toxicity(spark, SF).collect() if r.held_out and r.doc_id in truth]
    toxic, clean = [r for r in rows if truth[r.doc_id][1] == 1], [r for r in rows if truth[r.doc_id][1] == 0]
    assert np.mean([r.predicted for r in toxic]) > 0.85 and np.mean([r.predicted for r in clean]) < 0.05


def test_gradient():
    names = pa.array(["idiot", "the", "of", "né", "x1", ",,"])
    words, r = T.Words(names), np.random.default_rng(0)
    m = {k: v.astype(np.float64) for k, v in T.fresh(1).items()}
    numbers, y = r.integers(0, 7, (5, T.WINDOW)), np.array([1, 0, 1, 0, 1.0])
    numbers[2, 10:] = 6
    _, g = T.loss_gradient(m, words, numbers, y)
    for k in m:
        flat = m[k].reshape(-1)
        places = np.flatnonzero(np.abs(g[k]).ravel() > 1e-6)
        for i in r.choice(places, min(3, len(places)), replace=False):
            was, e = flat[i], 1e-2
            flat[i] = was + e
            up = T.loss_gradient(m, words, numbers, y)[0]
            flat[i] = was - e
            down = T.loss_gradient(m, words, numbers, y)[0]
            flat[i] = was
            assert abs((up - down) / 2 / e - g[k].ravel()[i]) < 3e-4 + 0.05 * abs(g[k].ravel()[i])


def test_windows_cover_every_word():
    for n in (0, 1, 23, 24, 25, 40, 41, 100):
        starts = T.window_starts(n)
        assert {k for s in starts for k in range(s, min(n, s + T.WINDOW))} == set(range(n)) and all(b - a <= T.STRIDE for a, b in zip(starts, starts[1:]))


def test_a_word_is_one_whatever_its_slice():
    a, b = T.Words(pa.array(["zeta", "naïve,", "of"])), T.Words(pa.array(["x", "of", "naïve", "zeta"]))
    assert a.word.tolist() == [b.word[3], b.word[2], b.word[1]]
    v = np.random.default_rng(0).normal(size=(T.TRIGRAMS, 3)).astype(np.float32)
    assert np.allclose(a.char_sums(v), b.char_sums(v)[[3, 2, 1]])


@pytest.mark.parametrize("name", ["quality", "lines", "toxicity", "licences"])
def test_odd_rows(spark, odd, none, name):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (5, 0, 1), (5, 0, 1), (8, 1, 0), (9, 0, 1), (7, None, None), (None, 1, 1), (3, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for docs in (odd, none):
        for own in (labels, no_labels):
            if name == "quality":
                out = Q.score(docs, Q.train(docs, own), ["doc_id"])
            elif name == "lines":
                out = L.label_documents(docs, L.train(docs, own), ["doc_id", "kept"], "_")
            elif name == "toxicity":
                out = T.score(docs, T.train(docs, own), ["doc_id"])
            else:
                out = C.licence_paragraphs(docs, ["doc_id", "score"])
            assert out.count() == docs.count()
    if name == "toxicity":
        assert {r.score for r in T.score(odd, None, ["doc_id"]).collect()} == {0.0}


def test_licences(spark):
    cases = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-nc", "The bar lost its licence to sell wine in May.": None, "the cat sat on the mat": None, "": None, "MIT": None}
    docs = spark.createDataFrame([(k, f"some words here\n{t}\nmore of them") for k, t in enumerate(cases)], "doc_id long, text string")
    rows = {r.doc_id: [x.family for x in r.licences] for r in C.licence_paragraphs(docs, ["doc_id"]).collect()}
    assert [rows[k] for k in range(len(cases))] == [[f] if f else [] for f in cases.values()]


def test_licence_rule_equals_python(spark):
    """The SQL score against the same sum in Python."""
    model = C.train()
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    words = C.tokens(text)
    z = (model["bias"] + sum(model["weights"][b] for b in {C.bucket(g) for g in C.grams(words)} & set(model["weights"]))) / model["temperature"]
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    found = C.licence_paragraphs(spark.createDataFrame([(1, text)], "doc_id long, text string"), []).first().licences[0]
    assert found.family == model["classes"][int(p.argmax())] == "mit" and abs(found.probability - p.max()) < 1e-4


#: Statements and names that training has not seen, by family; and licences that are none of them.
UNSEEN = {
    "apache": ["This project is released under the terms of the Apache License 2.0", "Distributed under the Apache License, Version 2.0.", "Apache License", "licensed under Apache-2.0"],
    "bsd": ["This code is distributed under the terms of the BSD license.", "Distributed under the New BSD License", "BSD License", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "cc": ["Text is available under the Creative Commons Attribution-ShareAlike 3.0 license", "This article is published under CC BY 4.0 terms", "Content licensed under a Creative Commons Attribution 4.0 licence"],
    "cc-nc": ["Images are licensed under CC BY-NC 4.0 by the author", "Published under CC BY-NC-SA 4.0"],
    "gpl": ["Distributed under the terms of the GNU General Public License v2", "This software is covered by the GNU General Public License", "released under the GPL", "SPDX-License-Identifier: GPL-2.0"],
    "lgpl": ["Distributed under the GNU Lesser General Public License", "This software is covered by the GNU Lesser General Public License, version 3", "released under the LGPL"],
    "mit": ["This project is licensed under the terms of the MIT license", "MIT License", "The MIT License (MIT)", "License: MIT"],
    "mpl": ["This file is under the Mozilla Public License 2.0", "Mozilla Public License"],
    "proprietary": ["(c) 2024 Some Company. All rights reserved.", "All rights reserved worldwide."],
}
NONE = [
    "GNU Affero General Public License, version 3", "This program is distributed under the GNU Affero General Public License", "Eclipse Public License 2.0", "CC BY-ND 4.0", "Licensed under CC BY-NC-ND 4.0 by the author", "Creative Commons Attribution-NoDerivatives 4.0",
    "Licensed under the Boost Software License", "Licensed under the Universal Permissive License, Version 1.0", "Licensed under the Academic Free License version 3.0", "Do What The Fuck You Want To Public License", "Licensed under the Open Software License 3.0", "the Educational Community License, Version 2.0",
    "Licensed under the IBM Public License Version 1.0", "Python Software Foundation License Version 2", "released under the Q Public License", "The driver was released from jail in May.", "He lost his license to practise medicine.", "MIT is a university in Massachusetts.", "the general public of the free city", "version 2.0 of the plan",
]


def test_licences_not_seen_in_training(spark):
    """Recall by family and false claims on licences that are none of the families."""
    cases = [(t, f) for f, own in UNSEEN.items() for t in own] + [(t, None) for t in NONE]
    docs = spark.createDataFrame([(k, f"a line before\n{t}\nand one after") for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    found = {r.doc_id: {x.family for x in r.licences} for r in C.licence_paragraphs(docs, ["doc_id"]).collect()}
    missed = [t for k, (t, f) in enumerate(cases) if f and f not in found[k]]
    wrong = [(t, found[k]) for k, (t, f) in enumerate(cases) if found[k] - {f}]
    assert len(missed) <= 0.15 * sum(map(len, UNSEEN.values())), missed
    assert len(wrong) <= 1, wrong
    assert C.train()["accuracy"] > 0.7  # of whole statements left out, perturbed, before confirmation


def test_wrapped_licences(spark):
    texts = ["/* This program is free software: you can redistribute it and/or modify it under the terms of the GNU\n General Public License as published by the Free Software Foundation, either", "Released under the terms of the Mozilla\nPublic License, version 2.0 and others", "Released under the MIT\n\nLicense is a word", "the GNU Affero\nGeneral Public License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(x.family, x.line) for x in r.licences] for r in C.licence_paragraphs(docs, ["doc_id"]).collect()}
    assert found == {0: [("gpl", 0)], 1: [("mpl", 0)], 2: [], 3: []}


def test_licences_of_one_line(spark):
    """Two families of one line, statements in a long line, and a window's edge in a longer name."""
    fill = "the river ran down to the sea while we sat on the old bench near the wall eating bread " * 4
    cases = [("MIT license or the Apache License, Version 2.0", {"apache", "mit"}), ("Licensed under the GPL or the GNU Lesser General Public License, version 2.1.", {"gpl", "lgpl"}), (f"{fill}Released under the MIT License {fill}Licensed under the Apache License, Version 2.0 {fill}", {"apache", "mit"}), (f"{fill}Licensed under CC BY-NC 4.0 {fill}", {"cc-nc"}), (fill, set()), ("no and " * 3000 + f"no. {fill}Released under the MIT License {fill}", {"mit"})]
    cases += [(s.replace("{", "").replace("}", ""), {family}) for family, statements in C.STATEMENTS.items() for s in statements]
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(cases)], "doc_id long, text string")
    for r in C.licence_paragraphs(docs, ["doc_id"]).collect():
        assert {x.family for x in r.licences} == cases[r.doc_id][1] and len(r.licences) == len(cases[r.doc_id][1])
