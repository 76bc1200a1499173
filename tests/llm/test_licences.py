import math

import pytest

from tallyframe.llm import licences as L

PLAIN = ["The quick brown fox jumps over the lazy dog and runs to the river with the others."] * 3 + ["A library of software is a collection of programs which people may use at work."]

#: Notices as they stand in source files, wrapped and in other words than the templates; none is made by `samples`.
NOTICES = [
    ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.", "gpl-3.0"),
    (" * foo is free software; you can redistribute it and/or modify it\n * under the terms of the GNU General Public License as published by the\n * Free Software Foundation; either version 2, or (at your option)\n * any later version.", "gpl-2.0"),
    ("// Licensed to the Foundation under the Apache License, Version 2.0 (the\n// \"License\"); you may not use this file except in compliance\n// with the License.", "apache-2.0"),
    ("-- This file is part of the bar library, which is free software; you can redistribute it and/or modify\n-- it under the terms of the GNU Lesser General Public License as published by the Free\n-- Software Foundation; either version 2.1 of the License, or any later version.", "lgpl-2.1"),
    ("Our code is released under the MIT License, see LICENSE.", "mit"),
    ("/* SPDX-License-Identifier: BSD-3-Clause */", "bsd-3-clause"),
    ("Copyright (c) 2019 A. Person\nAll rights reserved.", "proprietary"),
    ("Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files, to deal in the Software without\nrestriction.", "mit"),
    ("The text and the images are licensed under CC BY-SA 4.0.", "cc-by-sa-4.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl-2.0"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.", "isc"),
]
NO_NOTICES = ["He has a driving license and a pilot license.", "The new version of the software is free of charge for any person.", "All the rights of the author were sold.", "The general public was not amused.", "We met at MIT in Boston.", "The terms of the contract were published by the foundation last year.", "Apache helicopters, version 2.0 of the game", "The copyright law of the country is old."]


@pytest.fixture(scope="module")
def model():
    return L.train(L.samples(PLAIN))


def test_held_out(model):
    held = L.samples(PLAIN, seed=77)
    guess = [L.judge_paragraph(w, model) for w, _ in held]
    assert sum((g[0] if g else L.UNKNOWN) == y for g, (_, y) in zip(guess, held, strict=True)) >= 0.95 * len(held)
    plain = [g for g, (_, y) in zip(guess, held, strict=True) if y == L.UNKNOWN]
    assert sum(g is not None for g in plain) <= 0.005 * len(plain)
    assert (abs(model.weights) > 0).mean() < 0.9  # sparse
    assert 0.01 < model.threshold < 0.99 and model.threshold not in (0.5, 0.95)
    z = [(model.probabilities(w), y) for w, y in held]
    sure = [p.max() for p, _ in z]
    right = [model.families[int(p.argmax())] == y for p, y in z]
    assert abs(sum(sure) / len(sure) - sum(right) / len(right)) < 0.06  # calibrated


def test_independent_notices(model):
    for text, family in NOTICES:
        assert [h[1] for h in L.find_licences("Some words before.\n\n" + text + "\n\nAnd more behind.", model)[1]][:1] == [family], text
    for text in NO_NOTICES:
        assert L.find_licences(text, model)[1] == [], text


def test_templates(model):
    for family, notices in L.TEMPLATES.items():
        for n in notices:
            assert L.confirms(L.words_of(n), family)
            assert [h[1] for h in L.find_licences("A line.\n" + n + "\n\nThe end.", model)[1]] == [family], n
    assert L.find_licences("You need a license to drive.\nThe conditions of the contract are met.", model) == (2, [])
    assert not L.confirms(L.words_of("The MIT is in the city."), "mit")


def test_paragraphs():
    assert list(L.paragraphs("One two\nthree.\nFour\n\n \nfive: six\n---\nseven")) == [["one", "two", "three"], ["four"], ["five", "six"], ["seven"]]
    assert list(L.paragraphs("")) == list(L.paragraphs(" \n--\n")) == []


def plain_scores(model, words):
    """Every n-gram of the paragraph looked up by itself."""
    grams = set(words) | {" ".join(words[i : i + 2]) for i in range(len(words) - 1)}
    z = [sum([float(model.weights[model.index[g]][k]) for g in grams if g in model.index], float(model.bias[k])) / model.temperature for k in range(len(model.families))]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def plain_scan(model, text):
    out = []
    for n, words in enumerate(L.paragraphs(text)):
        p = plain_scores(model, words)
        rows = []
        for k, f in enumerate(model.families):
            if k and 1 - p[0] >= model.threshold and (p[k] >= 0.05 or p[k] == max(p[1:])):
                pairs = {tuple(words[i : i + 2]) for i in range(len(words) - 1)}
                for t in L.TEMPLATES[f]:
                    w = L.words_of(t)
                    mine = {tuple(w[i : i + 2]) for i in range(len(w) - 1)}
                    share = max(len(mine & pairs) / len(mine), len(mine & pairs) / len(pairs) if len(words) >= 6 else 0)
                    if share >= 0.6:
                        rows.append((len(mine & pairs), share, p[k], f))
        if rows:
            out.append((n, max(rows)[3]))
    return out


def test_brute_force(spark):
    d = "/root/testdata/sf0.001"
    model = L.default_model(spark.read.parquet(f"{d}/benchmark.parquet"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in L.op3_licence_scan(spark, d).collect():
        want = plain_scan(model, texts[r.doc_id])
        assert [(x.paragraph, x.family) for x in r.licences] == want and r.n_licensed == len(want)
    for text, _ in NOTICES:
        assert [x[:2] for x in L.find_licences(text, model)[1]] == plain_scan(model, text)


def test_table(spark, model, edge, empty):
    rows = edge.select("doc_id", "text").union(spark.createDataFrame([(900, "x\n\nReleased under the MIT License."), (901, "y " * 5000 + "\n\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.")], "doc_id long, text string"))
    out = {r.doc_id: r for r in L.scan_licences(rows, model).collect()}
    assert out[900].families == "mit" and out[900].licences[0].paragraph == 1 and out[900].n_paragraphs == 2
    assert out[901].families == "cc-by-nc-4.0,mit" and out[901].n_licensed == 2
    assert not any(r.n_licensed for i, r in out.items() if i is None or i < 900)
    assert L.scan_licences(empty, model).count() == 0


def test_query_finds_the_lines(spark):
    d = "/root/testdata/sf0.01"
    known = {n: f for f, notices in L.TEMPLATES.items() for n in notices}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in L.op3_licence_scan(spark, d).collect():
        want = {known[x] for x in texts[r.doc_id].split("\n") if x in known}
        assert want <= set(r.families.split(",")) | {""}
        if "licen" not in texts[r.doc_id].lower() and "rights reserved" not in texts[r.doc_id].lower():
            assert r.families == ""
