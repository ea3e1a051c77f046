import re

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from corpusloom.llm import licenses as L
from corpusloom.llm import queries

HELD_OUT = {
    "apache": "Copyright 2024 A. Person. Licensed under the Apache License, Version 2.0, see below.",
    "mit": "The whole text is released under the MIT License by its authors.",
    "gpl": "This program is licensed under the GNU General Public License, version 3 or later.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc": "Text and images: licensed under CC BY-NC 4.0.",
    "cc-by-sa": "Text and images: licensed under CC BY-SA 4.0.",
    "reserved": "Copyright 2024 Someone Else. All rights reserved.",
}


@pytest.fixture(scope="module")
def classifier(spark):
    return L.train(spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_held_out_notices(spark, classifier):
    rows = spark.createDataFrame(list(HELD_OUT.items()), "wanted string, paragraph string")
    found = {r["wanted"]: (r["family"], r["confirmed"]) for r in classifier.predict(rows).collect()}
    assert found == {k: (k, True) for k in HELD_OUT}


def test_plain_text_is_none(spark, classifier, texts):
    plain = [(x,) for _, t, _ in texts for x in (t or "").split("\n") if "icense" not in x and "rights" not in x]
    rows = spark.createDataFrame(plain, "paragraph string")
    found = classifier.predict(rows)
    assert found.where(F.col("confirmed")).count() == 0
    assert found.where(F.col("family") != L.NONE).count() <= max(1, len(plain) * 0.01)


def test_unconfirmed_is_unknown(spark, classifier):
    docs = spark.createDataFrame(
        [(1, "plain line here\n" + HELD_OUT["mit"]), (2, "Released under the Foobar Public License 2.0 of my company"), (3, None), (4, ""), (None, HELD_OUT["gpl"])],
        "doc_id bigint, text string",
    )
    rows = L.scan(docs.unionByName(docs).unionByName(docs.where("doc_id = 1")), classifier).collect()
    found = {r["id"]: r for r in rows}
    # Repeated rows have the same result each.
    assert sorted(str(r["id"]) for r in rows) == ["1", "1", "1", "2", "2", "3", "3", "4", "4", "None", "None"]
    assert len(set(map(str, rows))) == len(found) == 5
    assert (found[1]["n_paragraphs"], found[1]["n_notices"]) == (2, 1)
    assert found[1]["families"] == ["mit"] and found[None]["families"] == ["gpl"]
    assert found[2]["families"] == [] and found[2]["n_notices"] == 0
    assert (found[3]["n_paragraphs"], found[4]["n_paragraphs"]) == (0, 0)


def test_odd_rows_and_empty_tables(odd, empty, clashing, classifier):
    found = L.scan(clashing(odd), classifier)
    assert sorted(str(r["id"]) for r in found.collect()) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert L.scan(empty).count() == 0


def plain_verdict(classifier, features, paragraph):
    """Softmax of the fitted weights over a paragraph's features, and the family's templates held against its words."""
    model = classifier.model
    logits = model.coefficientMatrix.toArray()[:, features.indices].sum(axis=1) + model.interceptVector.toArray()
    chance = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
    family = classifier.families[1 + int(np.argmax(chance[1:]))]
    cut = lambda text: re.findall(r"[^\W_]+(?:-[^\W\d_]+)*", text.lower())
    words = cut(paragraph)
    if len(words) < L.MIN_WORDS or 1 - chance[0] < classifier.threshold:
        return L.NONE, False
    own = set(zip(words, words[1:]))
    shares = [len(own & s) / len(s) for s in (set(zip(w, w[1:])) for w in map(cut, L.TEMPLATES[family]))]
    return family, max(shares) >= L.CONFIRMED


def test_against_plain_scorer(spark, classifier, texts):
    lines = {x for _, t, _ in texts for x in (t or "").split("\n")} | set(HELD_OUT.values()) | {p for _, p in L.notices()}
    lines |= {"GNU Library General Public License version 2", "Released under the Foobar Public License 2.0 of my company"}
    rows = spark.createDataFrame([(x,) for x in sorted(lines)], "paragraph string")
    features = {r["paragraph"]: r["features"] for r in L._featured(rows).select("paragraph", "features").collect()}
    found = {r["paragraph"]: (r["family"], r["confirmed"]) for r in classifier.predict(rows).collect()}
    assert found == {x: plain_verdict(classifier, features[x], x) for x in lines}


def test_one_number_is_calibrated_and_decides(spark, classifier):
    """A notice whose probability is spread over several families passes if together they reach the threshold."""
    rows = spark.createDataFrame([("GNU Library General Public License version 2",)], "paragraph string")
    features = L._featured(rows).first()["features"]
    chance = classifier.model.predictProbability(features)
    strict = L.Classifier(classifier.families, classifier.model, 1 - chance[0] - 1e-9)
    assert max(chance[1:]) < strict.threshold
    got = strict.predict(rows).first()
    assert got["family"] != L.NONE and abs(got["probability"] - (1 - chance[0])) < 1e-9


def test_sample_does_not_depend_on_layout(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('plain words of line number ', id) AS text")
    taken = []
    monkeypatch.setattr(L, "_plain_lines", lambda d, c: taken.append(sorted(map(str, d.collect()))) or d.selectExpr("text AS paragraph"))
    monkeypatch.setattr(L, "CALIBRATION_ROWS", 1000)
    for layout in (docs.coalesce(1), docs.repartition(7), docs.repartition(3, "text")):
        L.train(layout, sample_rows=200)
    assert taken[0] == taken[1] == taken[2] and 0 < len(taken[0]) < 400


def test_query_finds_planted_notices(spark, texts):
    """The notices in the table are a handful of fixed lines."""
    planted = {
        "Licensed under CC BY-NC 4.0": "cc-by-nc",
        "Licensed under the Apache License, Version 2.0": "apache",
        "licensed under the GNU General Public License, version 3": "gpl",
        "Released under the MIT License": "mit",
        "All rights reserved": "reserved",
    }
    found = {r["doc_id"]: r["families"] for r in queries.op7_licenses(spark, SMALL).collect()}
    for d, t, _ in texts:
        wanted = sorted({f for k, f in planted.items() if k in t})
        assert found[d] == ",".join(wanted), t[-200:]


WRAPPED = {
    "mit": """The MIT License (MIT)

Copyright (c) 2024 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell""",
    "bsd": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 *
 * 1. Redistributions of source code must retain the above copyright""",
    "apache": """# Licensed under the Apache
# License, Version 2.0 (the "License");
# you may not use this file except
# in compliance with the License.""",
    "cc-by-nc": """This work is licensed under a Creative Commons Attribution-
NonCommercial 4.0 International License""",
}


def test_wrapped_notices(spark, classifier, texts):
    """One notice each, within plain text, as the file's only text, and word by word."""
    plain = next(t for _, t, _ in texts if t and t.count("\n") > 3 and "icense" not in t and "rights" not in t)
    rows = []
    for k, text in enumerate(WRAPPED.values()):
        rows += [(10 * k, text), (10 * k + 1, f"{plain}\n{text}\n{plain}"), (10 * k + 2, text.replace("\n", "\r\n"))]
    narrow = L.TEMPLATES["mit"][3].replace(" ", "\n")
    rows += [(900, narrow), (901, L.TEMPLATES["mit"][3].replace(" ", "\n\n")), (902, plain)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["id"]: (r["families"], r["n_notices"]) for r in L.scan(docs, classifier).collect()}
    wanted = {10 * k + j: ([name], 1) for k, name in enumerate(WRAPPED) for j in range(3)}
    assert found == wanted | {900: (["mit"], 1), 901: ([], 0), 902: ([], 0)}


def test_wrapped_lines_are_no_examples_of_none(spark):
    docs = spark.createDataFrame([(WRAPPED["mit"] + "\n\nplain words after it",)], "text string")
    left = [r["paragraph"] for r in L._plain_lines(docs, "text").collect()]
    assert "plain words after it" in left and "The MIT License (MIT)" in left
    assert not any("Software" in x or "sublicense" in x for x in left)


def test_a_few_licence_like_lines_do_not_set_the_threshold(spark):
    """Eight in 16,000 lines are fewer than FALSE_ALARMS, also where a smaller sample happens to hold some of them."""
    likely = "Your license to this software is public software licensed to any person, by person and author {}"
    rows = [(k, "\n".join(f"plain line {k} {j} of words about weather and food" for j in range(8))) for k in range(2000)]
    rows += [(5000 + k, likely.format(k)) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert L.train(docs).threshold == L.LEAST_PROBABILITY


def test_all_paragraphs_are_trained_or_calibrated_on(spark, monkeypatch):
    """Of 8,000 different lines, three quarters reach the fit, not three quarters of a bounded sample."""
    fitted = []

    class Recorded(L.LogisticRegression):
        def fit(self, dataset, params=None):
            fitted.append(dataset.where("label = 0").count())
            return super().fit(dataset, params)

    monkeypatch.setattr(L, "LogisticRegression", Recorded)
    docs = spark.range(8000).selectExpr("id AS doc_id", "concat('plain words of line ', id, ' and ', id * 7 + 1) AS text")
    L.train(docs.unionByName(docs.where("doc_id < 2000")))
    assert all(5800 < n < 6200 for n in fitted) and fitted


def test_features_left_out_at_first_change_nothing(spark, monkeypatch):
    """Paragraphs with frequent words that no notice has need more than the notices' features."""
    rows = [(k, f"weather and food {'of the license' if k % 3 else 'by any person'} in line {k} {k * 7}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    named, missed = [], L._missed
    full = L.train(docs).model.coefficientMatrix.toArray()
    monkeypatch.setattr(L, "_missed", lambda *a: named.append(missed(*a)) or named[-1])
    monkeypatch.setattr(L, "SCREEN_FROM", 0)
    screened = L.train(docs).model.coefficientMatrix.toArray()
    assert len(named) > 1 and named[0] and not named[-1]
    strong = np.abs(full).max(axis=0) > 0.3
    assert strong[list(named[0])].any()
    assert np.abs(full - screened)[:, strong].max() < 0.3 and np.abs(screened)[:, ~strong].max() < 0.6


def test_rank_from_top(spark):
    values = [0.1, 0.5, 0.5001, 0.50010001, 0.7, 0.7, 0.7, 0.9, 0.9000000001, 1.0]
    rows = spark.createDataFrame([(x,) for x in values * 2], "p double")
    above = sorted((x for x in values * 2 if x > 0.5), reverse=True)
    for rank in range(1, len(values) * 2 + 1):
        assert L._from_top(rows, rank, 0.5) == (above[rank - 1] if rank <= len(above) else 0.5)
    assert L._from_top(rows.limit(0), 1, 0.5) == 0.5


def test_features_to_begin_with_come_from_a_trial(spark, monkeypatch):
    """Of 2,250 paragraphs some 1,000 are tried; all are then fitted once, and the pass over all names no more."""
    rows = [(k, f"weather and food {'of the license' if k % 3 else 'by any person'} in line {k} {k * 7}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    fits, named, fitted, missed = [], [], L._regression, L._missed
    monkeypatch.setattr(L, "_regression", lambda p, e, used: fits.append((e.count(), used)) or fitted(p, e, used))
    monkeypatch.setattr(L, "_missed", lambda *a: named.append(missed(*a)) or named[-1])
    monkeypatch.setattr(L, "SCREEN_FROM", 0)
    monkeypatch.setattr(L, "TRIAL_ROWS", 1000, raising=False)
    L.train(docs)
    assert named == [set()] and len(fits) == 2
    (tried, first), (n, used) = fits
    assert 800 < tried < 1200 and first is None and 2100 < n < 2400 and used


def test_features_need_no_function_outside_of_spark_sql(spark, texts):
    docs = spark.createDataFrame([(d, t) for d, t, _ in texts[:20]], "doc_id bigint, text string")
    parts = L._parts(docs, F.col("text"), F.col("doc_id").alias("id"))
    assert "UDF" not in parts._jdf.queryExecution().optimizedPlan().toString()


def test_features_are_the_words_and_pairs(spark, tmp_path):
    """The same on both ways to a vector, with words repeated, alone, and none."""
    lines = ["the Same the same THE", "one", "", "Ärger-los ñandú 7a-b2 ΟΔΟΣ ΟΔΟΣ.Α İx x_y", None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, paragraph string")
    found = {r["k"]: r["features"] for r in L._featured(rows).collect()}
    numbered = L._featured(rows).select("k", "numbers")
    assert {r["k"]: r["features"] for r in L._stored(numbered, str(tmp_path / "rows")).collect()} == found
    words = {r["k"]: r["w"] for r in rows.select("k", L.tokens(F.col("paragraph")).alias("w")).collect()}
    lowered = {r["k"]: r["x"] for r in rows.select("k", F.lower(F.coalesce("paragraph", F.lit(""))).alias("x")).collect()}
    for k, x in lowered.items():
        assert words[k] == re.findall(r"[^\W_]+(?:-[^\W\d_]+)*", x)
        grams = {(w,) for w in words[k]} | set(zip(words[k], words[k][1:]))
        assert len(found[k].indices) == len(grams) and set(found[k].values) <= {1.0}


def test_one_pair_is_like_a_template_of_two(spark):
    """Against all templates one by one, with hits that suffice alone, twice the same, and too few."""
    cases = [["all rights"], ["of the"], ["of the", "of the"], ["under the", "the mit"], [], ["licensed under", "cc by", "by 4"]]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, hits array<string>")
    for r in rows.select("*", L._like(F.col("hits")).alias("found")).collect():
        shares = [(name, len(set(r["hits"]) & set(p)) / len(p)) for name, _, p in L._template_pairs()]
        assert sorted(map(tuple, r["found"])) == sorted(x for x in shares if x[1] >= L.LIKE_A_TEMPLATE)


def test_fits_after_a_screen_get_the_features_in_use_only(spark, monkeypatch):
    """Also the trial, so that the driver's arrays don't have a number for each of all features and classes."""
    sizes = []

    class Recorded(L.LogisticRegression):
        def fit(self, dataset, params=None):
            sizes.append(dataset.first()[self.getFeaturesCol()].size)
            return super().fit(dataset, params)

    monkeypatch.setattr(L, "LogisticRegression", Recorded)
    monkeypatch.setattr(L, "SCREEN_FROM", 0)
    monkeypatch.setattr(L, "TRIAL_ROWS", 1000)
    rows = [(k, f"weather and food {'of the license' if k % 3 else 'by any person'} in line {k} {k * 7}") for k in range(3000)]
    trained = L.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert len(sizes) >= 2 and max(sizes) < L.FEATURES / 4
    # The whole vectors' verdicts are those of the weights spread over all features.
    lines = sorted({p for _, p in L.notices()} | set(HELD_OUT.values()) | {x for _, x in rows[:50]} | {"", "words that no notice has"})
    asked = spark.createDataFrame([(x,) for x in lines], "paragraph string")
    features = {r["paragraph"]: r["features"] for r in L._featured(asked).collect()}
    found = {r["paragraph"]: (r["family"], r["confirmed"]) for r in trained.predict(asked).collect()}
    assert found == {x: plain_verdict(trained, features[x], x) for x in lines}
