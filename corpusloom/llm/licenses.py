"""Licence scans with a trained paragraph classifier.

Lines are paragraphs. Words and word pairs are hashed to sparse features, and a
multinomial logistic regression with an L1 penalty tells licence families apart
from text that is none. It is trained on notices of each family, whole and in
part, and on the corpus's own paragraphs: three quarters of all different ones
that hold no notice. They weigh ``PLAIN_WEIGHT`` together, so that notices don't
vanish in a large corpus. All others are held out: the least probability of being
a licence at all, 1 - P(none), is set so that about ``FALSE_ALARMS`` of these reach
it. The same number decides; the family is the likeliest one. What passes is
confirmed by comparison with the family's templates: a notice must hold most of
a template's word pairs. What passes and isn't confirmed counts as unknown.

The L1 penalty leaves most features without a weight. From ``SCREEN_FROM``
paragraphs the fit therefore begins with the features of notices, and paragraphs
that agree in these are one weighted row. A pass over all features of all
paragraphs then shows which others the penalty wouldn't hold at zero; they are
added, and the fit is repeated until there is none. From twice ``TRIAL_ROWS``, the
same on some of the paragraphs says beforehand which to add. Vectors are cut to
the features in use before a fit: the driver holds dozens of arrays with a number
for each feature and class.

Notices are often wrapped. Lines without a blank one between them are also read
as one run of words: a passage over line ends that holds ``LIKE_A_TEMPLATE`` of
a template's word pairs is a paragraph besides its lines, scored and confirmed
like these. Passages that share lines are one notice; what a line alone shows
isn't counted again for a passage around it.

Paragraphs are held out by a hash of their text, so the classifier doesn't depend
on files and partitions. A caller may train on a sample of the documents, drawn
by a hash of id and text; ``scan`` doesn't.

Defined results: a null or empty text has no paragraphs and no licence. Every row
has a result row, repeated rows the same one each. Null ids are ids like any
other. Empty tables give empty results. Only the columns asked for are read.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VarianceThresholdSelector, VarianceThresholdSelectorModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpusloom.llm.common import SPACES, bind, unit_draw
from corpusloom.session import delete_path, materialize, new_path

FEATURES = 1 << 13
# The corpus's paragraphs weigh as much as so many notices, or one each if they are fewer.
PLAIN_WEIGHT = 3000
PENALTY = 2e-4
L1_SHARE = 0.5
# With fewer paragraphs all features are fitted at once.
SCREEN_FROM = 50_000
# From twice as many paragraphs, about so many show which features to begin with: those that are pulled by this share
# of what the penalty holds.
TRIAL_ROWS = 50_000
TRIAL_SHARE = 0.75
ROWS_PER_TASK = 100_000
# Held-out paragraphs aimed at if a caller asks for a sample.
CALIBRATION_ROWS = 32_000
FALSE_ALARMS = 0.001
LEAST_PROBABILITY = 0.5
CONFIRMED = 0.75
# Share of a template's word pairs from which text is no example of none, and a passage over line ends is looked at.
LIKE_A_TEMPLATE = 0.3
MIN_WORDS = 3
NONE = "none"
SEED = 5

# Usual notices of each family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache License 2.0",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "cc-by-nd": (
        "Licensed under CC BY-ND 4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    ),
    "cc0": (
        "Released under CC0 1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "This work has been dedicated to the public domain under CC0 1.0 Universal",
    ),
    "reserved": ("All rights reserved", "Copyright 2020 by the author. All rights reserved"),
}
# Words around notices, for training.
BEFORE = ("", "Copyright 2021 The Authors.", "This text is", "Note:", "(c) 2019 Contributors")
AFTER = ("", "See LICENSE for details.", "No warranty is given.", "http://example.org")


def tokens(paragraph: Column) -> Column:
    lowered = F.lower(F.coalesce(paragraph, F.lit("")))
    return F.regexp_extract_all(lowered, F.lit(r"[a-z\p{L}\p{N}]++(?:-[\p{L}]++)*+"), F.lit(0))


def _numbers_of(words: Column) -> Column:
    """The features of the words and of the pairs of neighbouring ones, with repeats."""

    def made(w: Column) -> Column:
        # The hash of the last word and of nothing after it is that of the word.
        pairs = F.transform(w, lambda x, i: F.hash(x, F.get(w, i + 1)).bitwiseAND(FEATURES - 1))
        return F.concat(F.transform(w, lambda x: F.hash(x).bitwiseAND(FEATURES - 1)), pairs)

    return bind(words, made)


def _hits(words: Column) -> Column:
    """The pairs of neighbouring words, joined by a space, that any template has."""
    every = sorted({p for _, _, distinct in _template_pairs() for p in distinct})
    firsts, seconds = (sorted({p.split(" ")[k] for p in every}) for k in range(2))

    def made(w: Column) -> Column:
        def hit(x: Column, i: Column) -> Column:
            following = F.get(w, i + 1)
            pair = F.concat(x, F.lit(" "), following)
            return F.when(x.isin(firsts) & following.isin(seconds), F.when(pair.isin(every), pair))

        return F.array_compact(F.transform(w, hit))

    return bind(words, made)


def _featured(rows: DataFrame) -> DataFrame:
    """Adds ``numbers`` and the vector ``features`` for the column ``paragraph``."""
    words = tokens(F.col("paragraph"))
    return _vectors(rows.withColumn("numbers", F.sort_array(F.array_distinct(_numbers_of(words)))))


def _vectors(rows: DataFrame) -> DataFrame:
    """Adds the vector ``features`` for ``numbers``."""
    grams = "numbers as strings"
    named = CountVectorizerModel.from_vocabulary([str(k) for k in range(FEATURES)], inputCol=grams, outputCol="features", binary=True)
    return named.transform(rows.withColumn(grams, F.col("numbers").cast("array<string>"))).drop(grams)


def _stored(rows: DataFrame, path: str) -> DataFrame:
    """Writes ``rows`` and reads them back, with the vector ``features`` for ``numbers``.

    The struct that is written has the form in which vectors are stored.
    """
    ones = F.array_repeat(F.lit(1.0), F.size("numbers"))
    vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(FEATURES).alias("size"), F.col("numbers").alias("indices"), ones.alias("values"))
    kept = rows.drop("numbers")
    rows.select(*kept.columns, vector.alias("features")).write.parquet(path)
    return rows.sparkSession.read.schema(StructType([*kept.schema, StructField("features", VectorUDT())])).parquet(path)


def _of_templates(pairs: Column) -> Column:
    """The pairs that any template has."""
    every = sorted({p for _, _, distinct in _template_pairs() for p in distinct})
    return F.filter(pairs, lambda x: x.isin(every))


def _like(hits: Column) -> Column:
    """Family and share of the templates of whose pairs at least ``LIKE_A_TEMPLATE`` are among the hits."""

    # For most templates one pair isn't enough.
    alone = sorted({p for _, _, distinct in _template_pairs() for p in distinct if 1 / len(distinct) >= LIKE_A_TEMPLATE})

    def compared(seen: Column) -> Column:
        share = lambda t: F.size(F.array_intersect(t["pairs"], seen)) / F.size(t["pairs"])
        known = F.transform(_known(), lambda t: F.struct(t["family"].alias("family"), share(t).alias("share")))
        enough = (F.size(F.array_distinct(seen)) > 1) | F.exists(seen, lambda x: x.isin(alone))
        return F.when((F.size(seen) > 0) & enough, F.filter(known, lambda x: x["share"] >= LIKE_A_TEMPLATE))

    none = F.array().cast("array<struct<family:string,share:double>>")
    return F.coalesce(bind(hits, compared), none)


def _cut(words: Column) -> Column:
    """What is kept of a paragraph's words."""
    made = lambda w: F.struct(
        _numbers_of(w).alias("numbers"), _hits(w).alias("hits"), (F.size(w) >= MIN_WORDS).alias("long")
    )
    return bind(words, made)


def _described(rows: DataFrame) -> DataFrame:
    """Replaces ``cut`` by ``numbers`` of features, ``long`` and ``shares``, the templates that the words are like."""
    kept = [c for c in rows.columns if c != "cut"]
    none = F.array().cast("array<int>")
    # Compiled here, outside of any lambda.
    numbers = F.sort_array(F.array_distinct(F.coalesce("cut.numbers", none)))
    long = F.coalesce("cut.long", F.lit(False))
    return rows.select(*kept, numbers.alias("numbers"), long.alias("long"), _like(F.col("cut.hits")).alias("shares"))


def _template_pairs() -> list[tuple[str, int, list[str]]]:
    """Every template's family, number of words and different word pairs."""
    rows = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            w = re.findall(r"[^\W_]+(?:-[^\W\d_]+)*", text.lower())
            rows.append((name, len(w), list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))))
    return rows


def _known() -> Column:
    """Every template's family, number of words, pairs needed to be like it, and different word pairs, as one constant."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("family"),
                F.lit(n).alias("n"),
                F.lit(next(d for d in range(len(distinct) + 1) if d / len(distinct) >= LIKE_A_TEMPLATE)).alias("need"),
                F.array(*map(F.lit, distinct)).alias("pairs"),
            )
            for name, n, distinct in _template_pairs()
        ]
    )


def _by_line(docs: DataFrame, text: Column, *kept: Column) -> DataFrame:
    """``kept``, the arrays ``lines``, ``line_words`` and ``line_hits``, and the passages over line ends."""
    lines = docs.select(*kept, F.split(text, "\n", -1).alias("lines"))
    words = lines.withColumn("line_words", F.transform("lines", tokens))
    return _with_passages(words.withColumn("line_hits", F.transform("line_words", _hits)))


def _with_passages(rows: DataFrame) -> DataFrame:
    """Adds ``passages``: ``(first, last, words, share)`` for places where words across line ends are like a template.

    From each word pair that a template has, the words up to twice the template's
    length are compared; the best template counts. A blank line ends a run of
    words. A word that is split at a hyphen is one. Templates are left out whose
    words can't reach over the line end, or that have too few pairs ahead. Texts
    that as a whole hold too few pairs of each template have no such place.
    """
    every = sorted({p for _, _, distinct in _template_pairs() for p in distinct})
    firsts = sorted({p.split(" ")[0] for p in every})
    longest = 2 * max(n for _, n, _ in _template_pairs())

    def split_after(i: Column) -> Column:
        w = F.get("line_words", i)
        return (i >= 0) & F.rtrim(F.get("lines", i), F.lit(SPACES)).endswith("-") & (F.size(w) > 1) & (F.size(F.get("line_words", i + 1)) > 0)

    def placed(w: Column, i: Column) -> Column:
        """A line's words with its number, and a null at its end if it has none."""
        own = F.slice(w, F.lit(1), F.size(w) - F.coalesce(split_after(i), F.lit(False)).cast("int"))
        before = F.get("line_words", i - 1)
        whole = F.concat(F.array(F.concat(F.get(before, F.size(before) - 1), F.lit("-"), F.get(own, F.lit(0)))), F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))))
        own = F.when(F.coalesce(split_after(i - 1), F.lit(False)), whole).otherwise(own)
        nothing = F.struct(F.lit(None).cast("string").alias("w"), i.alias("line"), F.lit(0).alias("left"))
        return F.when(F.size(w) == 0, F.array(nothing)).otherwise(
            bind(own, lambda o: F.transform(o, lambda x, j: F.struct(x.alias("w"), i.alias("line"), (F.size(o) - 1 - j).alias("left"))))
        )

    def hits(all_words: Column) -> Column:
        """Pairs that any template has, in order."""

        def hit(x: Column, k: Column) -> Column:
            following = F.get(all_words, k + 1)
            pair = F.concat(x["w"], F.lit(" "), following["w"])
            made = F.struct(k.alias("k"), pair.alias("pair"), x["line"].alias("line"), following["line"].alias("end"), x["left"].alias("left"))
            return F.when(x["w"].isin(firsts) & pair.isin(every), made)

        return F.array_compact(F.transform(all_words, hit))

    def found(all_hits: Column) -> Column:
        def best(h: Column, j: Column) -> Column:
            near = F.slice(all_hits, j + 1, F.lit(longest))

            def compared(t: Column) -> Column:
                inside = F.filter(near, lambda x: (x["k"] < h["k"] + 2 * t["n"]) & F.array_contains(t["pairs"], x["pair"]))
                return bind(
                    inside,
                    lambda seen: F.struct(
                        (F.size(F.array_distinct(F.transform(seen, lambda x: x["pair"]))) / F.size(t["pairs"])).alias("share"),
                        (-F.element_at(seen, -1)["k"]).alias("to"),
                        h["line"].alias("first"),
                        F.element_at(seen, -1)["end"].alias("last"),
                        h["k"].alias("k"),
                    ),
                )

            def possible(t: Column) -> Column:
                stop = h["k"] + 2 * t["n"]
                enough = F.coalesce(F.get(all_hits, j + t["need"] - 1)["k"] < stop, F.lit(False))
                return (h["left"] < 2 * t["n"]) & enough & F.array_contains(t["pairs"], h["pair"])

            like = F.transform(F.filter(_known(), possible), compared)
            return F.array_max(F.filter(like, lambda x: (x["share"] >= LIKE_A_TEMPLATE) & (x["first"] < x["last"])))

        # Without two lines that have hits, or one pair over a line end, there is no passage.
        several = F.exists(all_hits, lambda x: x["end"] > F.get(all_hits, F.lit(0))["line"])
        none = F.array().cast("array<struct<share:double,to:int,first:int,last:int,k:int>>")
        return F.when(several, F.array_compact(F.transform(all_hits, best))).otherwise(none)

    def over_end(w: Column, i: Column) -> Column:
        last = F.get(w, F.size(w) - 1)
        return F.when(last.isin(firsts), F.concat(last, F.lit(" "), F.get(F.get("line_words", i + 1), F.lit(0))))

    ends = _of_templates(F.array_compact(F.transform("line_words", over_end)))
    hyphens = F.exists(F.transform("lines", lambda x, i: F.coalesce(split_after(i), F.lit(False))), lambda x: x)
    possible = hyphens | (F.size(_like(F.concat(F.flatten("line_hits"), ends))) > 0)
    nothing = F.array().cast("array<struct<w:string,line:int,left:int>>")
    located = rows.withColumn("placed", F.when(possible, F.flatten(F.transform("line_words", placed))).otherwise(nothing))
    passages = bind(hits(F.col("placed")), found)

    def cut(x: Column) -> Column:
        words = F.transform(F.slice("placed", x["k"] + 1, 2 - x["to"] - x["k"]), lambda y: y["w"])
        return F.struct(x["first"].alias("first"), x["last"].alias("last"), F.array_compact(words).alias("words"), x["share"].alias("share"))

    return located.withColumn("found", passages).withColumn("passages", F.transform("found", cut)).drop("placed", "found")


def _beside() -> Column:
    """For each line, whether no blank line separates it from a wrapped notice."""
    blank = F.filter(F.transform("line_words", lambda w, j: F.when(F.size(w) == 0, j)), lambda j: j.isNotNull())
    wrapped = F.filter("passages", lambda p: p["share"] >= CONFIRMED)

    def near(notices: Column, blanks: Column) -> Column:
        def one(i: Column) -> Column:
            return F.exists(
                notices,
                lambda p: ~F.exists(blanks, lambda b: ((b > i) & (b < p["first"])) | ((b < i) & (b > p["last"]))),
            )

        return F.transform("lines", lambda x, i: one(i))

    return bind(wrapped, lambda notices: bind(blank, lambda blanks: near(notices, blanks)))


def _plain_lines(docs: DataFrame, text_col: str) -> DataFrame:
    """The lines as ``paragraph``, without those of a run of lines in which a wrapped notice stands."""
    rows = _by_line(docs, F.col(text_col)).withColumn("beside", _beside())
    lines = rows.select(F.explode(F.arrays_zip("lines", "beside")).alias("line"))
    return lines.where(~F.col("line.beside")).select(F.col("line.lines").alias("paragraph"))


def _place(paragraph: Column) -> Column:
    return F.xxhash64(paragraph)


def _held_out(paragraph: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), paragraph), F.lit(4)) == 0


def _parts(docs: DataFrame, text: Column, *kept: Column) -> DataFrame:
    """Lines, and passages over line ends, with ``kept`` and what is needed to train and to judge.

    ``plain`` are lines that are examples of none.
    """
    rows = _by_line(docs, text, *kept).withColumn("beside", _beside())
    own = [c for c in rows.columns if c not in ("lines", "line_words", "line_hits", "passages", "beside")]

    def part(first: Column, last: Column, cut: Column, blank: Column, far: Column, line: Column) -> Column:
        return F.struct(
            first.alias("first"),
            last.alias("last"),
            cut.alias("cut"),
            blank.alias("blank"),
            far.alias("far"),
            _place(line).alias("place"),
            _held_out(line, SEED).alias("held_out"),
        )

    def line_part(x: Column, i: Column) -> Column:
        words, hits = x["line_words"], x["line_hits"]
        cut = F.struct(_numbers_of(words).alias("numbers"), hits.alias("hits"), (F.size(words) >= MIN_WORDS).alias("long"))
        return part(i, i, cut, F.trim(x["lines"]) == "", ~x["beside"], x["lines"])

    def over_part(p: Column) -> Column:
        return part(p["first"], p["last"], _cut(p["words"]), F.lit(True), F.lit(False), F.lit(""))

    lines = F.transform(F.arrays_zip("lines", "line_words", "line_hits", "beside"), line_part)
    parts = rows.select(*own, F.explode_outer(F.concat(lines, F.transform("passages", over_part))).alias("part"))
    plain = F.coalesce(F.col("far") & F.col("long") & (F.size("shares") == 0), F.lit(False))
    return _described(parts.select(*own, "part.*")).withColumn("plain", plain).drop("far")


def _licence(chance: Column) -> Column:
    """The probability of being a licence of any family; the first class is none."""
    return 1.0 - F.get(chance, F.lit(0))


@dataclass
class Screened:
    """A fit on the features in use, for vectors of all features."""

    cut: VarianceThresholdSelectorModel
    fitted: LogisticRegressionModel

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.fitted.transform(self.cut.transform(rows)).drop(self.cut.getOutputCol())

    @property
    def coefficientMatrix(self) -> DenseMatrix:
        weights = np.zeros((self.fitted.numClasses, FEATURES))
        weights[:, self.cut.selectedFeatures] = self.fitted.coefficientMatrix.toArray()
        return DenseMatrix(*weights.shape, weights.ravel(order="F"))

    @property
    def interceptVector(self) -> DenseVector:
        return self.fitted.interceptVector


@dataclass
class Classifier:
    families: list[str]
    model: LogisticRegressionModel | Screened
    threshold: float

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``family`` (or none), ``probability`` of any and ``confirmed`` for the column ``paragraph``."""
        judged = self.judge(_vectors(_described(rows.withColumn("cut", _cut(tokens(F.col("paragraph")))))))
        return judged.select(*rows.columns, "family", "probability", "confirmed")

    def judge(self, rows: DataFrame) -> DataFrame:
        """The same for the columns ``features``, ``long`` and ``shares``."""
        chance = self.model.transform(rows).withColumn("chance", vector_to_array("probability"))
        names = F.array(*[F.lit(x) for x in self.families[1:]])
        licences = F.slice("chance", 2, len(self.families) - 1)
        best = F.get(names, (F.array_position(licences, F.array_max(licences)) - 1).cast("int"))
        passed = F.col("long") & (_licence(F.col("chance")) >= self.threshold)
        found = chance.withColumn("family", F.when(passed, best).otherwise(NONE)).withColumn("probability", _licence(F.col("chance")))
        confirmed = F.exists("shares", lambda x: (x["family"] == F.col("family")) & (x["share"] >= CONFIRMED))
        return found.select(*rows.columns, "family", "probability", confirmed.alias("confirmed"))


def notices() -> list[tuple[str, str]]:
    """Training rows: ``(family, paragraph)`` of every template in various surroundings, and its longer parts."""
    rows = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = text.split()
            parts = [text] if len(words) < 10 else [text, " ".join(words[: len(words) * 3 // 4]), " ".join(words[len(words) // 4 :])]
            rows += [(family, f"{b} {part} {a}".strip()) for part in parts for b in BEFORE for a in AFTER]
    return rows


def train(
    docs: DataFrame, text_col: str = "text", sample_rows: int | None = None, seed: int = SEED, id_col: str = "doc_id"
) -> Classifier:
    """Fits on notices and on three quarters of the paragraphs without one; calibrates on the others.

    With ``sample_rows`` only a part of the documents is read, which gives about
    so many paragraphs and a quarter of ``CALIBRATION_ROWS``.
    """
    if sample_rows is not None:
        part = (sample_rows + CALIBRATION_ROWS) / 4 / max(docs.count(), 1)
        docs = docs.where(unit_draw(F.lit(seed), F.col(id_col), F.col(text_col)) < part)
    lines = _plain_lines(_spread(docs.select(text_col)), text_col)
    line = F.col("paragraph")
    rows = _described(lines.select(_place(line).alias("place"), _held_out(line, seed).alias("held_out"), _cut(tokens(line)).alias("cut")))
    plain = rows.where(F.col("long") & (F.size("shares") == 0)).drop("long", "shares")
    return _fit(_stored(plain, new_path(docs.sparkSession, "plain-paragraphs")))


def _spread(docs: DataFrame) -> DataFrame:
    """Repartitions a table that is read by fewer tasks than there are cores."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _fit(plain: DataFrame) -> Classifier:
    """Classifier from all rows ``(place, held_out, features)``, of which those with the same text count once."""
    spark = plain.sparkSession
    families = [NONE, *TEMPLATES]
    labels = {name: float(k) for k, name in enumerate(families)}
    positive = _featured(_frame(spark, [(labels[f], p) for f, p in notices()])).select("label", "numbers")
    positive = _stored(positive, new_path(spark, "licence-notices"))
    examples = plain.where(~F.col("held_out"))
    n = examples.count()
    if n < SCREEN_FROM:
        model, _, _ = _fitted(positive, examples, None)
        return Classifier(families, model, _threshold(model, plain.where("held_out")))
    used = _numbers(positive)
    if n >= 2 * TRIAL_ROWS:
        # Only where to begin; the fit and the pass after it are over all.
        trial = materialize(examples.where(unit_draw(F.lit(SEED), F.col("place")) < TRIAL_ROWS / n), "licence-trial")
        pull = _pull(*_regression(positive, trial, None), trial)
        used |= {int(k) for k in (pull > TRIAL_SHARE * PENALTY * L1_SHARE).nonzero()[0]}
    while True:
        model, weight, total = _regression(positive, examples, used)
        missed = _missed(model, examples, used, weight, total)
        if not missed:
            break
        used |= missed
    return Classifier(families, model, _threshold(model, plain.where("held_out")))


def _numbers(rows: DataFrame) -> set[int]:
    """The features that any of the rows has."""
    found = rows.select(F.explode(F.unwrap_udt("features")["indices"]).alias("number")).distinct()
    return {r["number"] for r in found.collect()}


def _regression(positive: DataFrame, examples: DataFrame, used: set[int] | None) -> tuple[Screened, float, float]:
    """The fit on the features in use, the weight of an example, and that of all rows together.

    If None, all are fitted: first the notices' features, then also those that the penalty doesn't hold at zero.
    """
    if used is not None:
        return _fitted(positive, examples, used)
    used = _numbers(positive)
    while True:
        model, weight, total = _fitted(positive, examples, used)
        others = _not_held(model, examples, used, weight, total)
        if not others:
            return model, weight, total
        used |= others


def _cut_to(spark: SparkSession, used: set[int]) -> VarianceThresholdSelectorModel:
    """Cuts ``features`` to those in use: what differs between a row that has them and one that has none."""
    path = new_path(spark, "licence-features")
    both = F.array(F.from_json(F.lit(json.dumps(sorted(used))), "array<int>"), F.array().cast("array<int>"))
    rows = _stored(spark.range(1).select(F.explode(both).alias("numbers")), path)
    cut = VarianceThresholdSelector(featuresCol="features", outputCol="features in use", varianceThreshold=0.0).fit(rows)
    delete_path(spark, path)
    return cut


def _fitted(
    positive: DataFrame, examples: DataFrame, used: set[int] | None
) -> tuple[LogisticRegressionModel | Screened, float, float]:
    """The fit on the features in use (all at once, if None), the weight of an example, and that of all rows together.

    Different texts that agree in the features in use are one row.
    """
    spark = examples.sparkSession
    numbers = F.unwrap_udt("features")["indices"]
    numbers = numbers if used is None else F.filter(numbers, lambda x: x.isin(sorted(used)))
    rows = examples.select("place", numbers.alias("numbers")).distinct().groupBy("numbers").agg(F.count("*").alias("copies"))
    path = new_path(spark, "licence-training")
    stored = _stored(rows, path)
    n_rows, n = stored.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    weight = min(1.0, PLAIN_WEIGHT / max(n, 1))
    plain = stored.select(F.lit(0.0).alias("label"), "features", (F.col("copies") * weight).alias("weight"))
    notes = positive.withColumn("weight", F.lit(1.0))
    table = notes.unionByName(plain).coalesce(max(2, -(-n_rows // ROWS_PER_TASK)))
    fit = LogisticRegression(
        family="multinomial", maxIter=40, regParam=PENALTY, elasticNetParam=L1_SHARE, standardization=False, weightCol="weight"
    )
    if used is None:
        model = fit.fit(table)
    else:
        cut = _cut_to(spark, used)
        model = Screened(cut, fit.setFeaturesCol(cut.getOutputCol()).fit(cut.transform(table).drop("features")))
    total = n * weight + notes.count()
    delete_path(spark, path)
    return model, weight, total


def _pull(model: Screened, weight: float, total: float, examples: DataFrame) -> np.ndarray:
    """For each feature, the mean over all rows of the probability of a licence where an example has the feature."""
    scored = model.transform(examples).select("features", _licence(vector_to_array("probability")).alias("p"))
    sums = scored.select(Summarizer.metrics("sum").summary(F.col("features"), F.col("p")).alias("found")).first()["found"]["sum"]
    return sums.toArray() * weight / total


def _missed(model: Screened, examples: DataFrame, used: set[int], weight: float, total: float) -> set[int]:
    """``_not_held`` over all examples."""
    return _not_held(model, examples, used, weight, total)


def _not_held(model: Screened, examples: DataFrame, used: set[int], weight: float, total: float) -> set[int]:
    """Features not in use that the L1 penalty may not hold at zero, or none if it holds all.

    The loss changes with a weight of such a feature by no more than ``_pull``;
    only examples have it. If that is below the penalty for every feature, zero is
    right for all. Otherwise those above half of it are named. Copies of a
    text are summed here too, which can only name more.
    """
    pull = _pull(model, weight, total, examples)
    pull[sorted(used)] = 0.0
    limit = PENALTY * L1_SHARE
    return set() if pull.max() <= limit else {int(k) for k in (pull > limit / 2).nonzero()[0]}


def _threshold(model: LogisticRegressionModel | Screened, held_out: DataFrame) -> float:
    """The ``1 - FALSE_ALARMS`` quantile over all different held-out texts, ``LEAST_PROBABILITY`` at least."""
    scored = model.transform(held_out).select("place", _licence(vector_to_array("probability")).alias("p"))
    chances = materialize(scored.groupBy("place").agg(F.max("p").alias("p")), "licence-chances")
    n = chances.count()
    return _from_top(chances, n - math.ceil((1 - FALSE_ALARMS) * n) + 1, LEAST_PROBABILITY)


def _from_top(chances: DataFrame, rank: int, least: float) -> float:
    """The ``p`` of that rank from the top, or ``least`` if it isn't above that.

    Some thousand bins are counted; the one that holds the rank is divided again.
    """
    low, high = least, 1.0
    above = chances.where(F.col("p") > least)
    while True:
        bin_of = F.floor((F.col("p") - low) / (high - low) * 1024)
        inside = above.where(F.col("p").between(low, high)).groupBy(bin_of.alias("bin"))
        bins = inside.agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high")).collect()
        for b in sorted(bins, key=lambda r: -r["bin"]):
            if rank <= b["n"]:
                break
            rank -= b["n"]
        else:
            return least
        if b["low"] == b["high"]:
            return b["low"]
        low, high = b["low"], b["high"]


def _frame(spark: SparkSession, rows: list[tuple[float, str]]) -> DataFrame:
    """A small table of fixed rows, sent as one constant."""
    text = json.dumps([{"label": x, "paragraph": p} for x, p in rows])
    values = F.from_json(F.lit(text), "array<struct<label:double,paragraph:string>>")
    return spark.range(1).select(F.inline(values))


def scan(docs: DataFrame, classifier: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, th, n_paragraphs, n_notices, n_unknown, families)`` of every row (``th``: its text's hash)."""
    text = F.col(text_col)
    own = (F.col(id_col).alias("id"), F.xxhash64(text).alias("th"))
    if classifier is None:
        # Training and scan read the same paragraphs, so they are made once.
        parts = _stored(_parts(_spread(docs.select(id_col, text_col)), text, *own), new_path(docs.sparkSession, "licence-paragraphs"))
        classifier = _fit(parts.where("plain").select("place", "held_out", "features"))
    else:
        parts = _vectors(_parts(docs, text, *own))
    found = classifier.judge(parts)
    mark = F.struct("first", "last", "family", "confirmed")
    marked = found.groupBy("id", "th").agg(
        F.count(F.when(~F.col("blank"), 1)).alias("n_paragraphs"),
        # Rows that agree in id and text share these marks, and are told apart again at the end.
        # A null text has no line at all.
        F.count(F.when(F.col("first").isNull() | ((F.col("first") == 0) & (F.col("last") == 0)), 1)).alias("copies"),
        F.sort_array(F.collect_set(F.when(F.col("family") != NONE, mark))).alias("marks"),
    )
    return _counted(marked)


def _overlap(a: Column, b: Column) -> Column:
    return (a["first"] <= b["last"]) & (b["first"] <= a["last"])


def _is_line(x: Column) -> Column:
    return x["first"] == x["last"]


def _runs(passages: Column) -> Column:
    """Number of groups of passages that share lines, family by family."""
    start = F.struct(F.lit("").alias("family"), F.lit(-1).alias("last"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        joins = (x["family"] == acc["family"]) & (x["first"] <= acc["last"])
        return F.struct(
            x["family"].alias("family"),
            F.when(joins, F.greatest(acc["last"], x["last"])).otherwise(x["last"]).alias("last"),
            (acc["n"] + F.when(joins, 0).otherwise(1)).alias("n"),
        )

    ordered = F.sort_array(F.transform(passages, lambda x: F.struct(x["family"], x["first"], x["last"])))
    return F.aggregate(ordered, start, step, lambda acc: acc["n"])


def _counted(marked: DataFrame) -> DataFrame:
    """Notices and unknown ones among the marks of each text, those over several lines besides single lines."""

    def chosen(keep) -> Column:
        return F.filter("marks", keep)

    parts = marked.select(
        "*",
        chosen(lambda x: _is_line(x) & x["confirmed"]).alias("notice_lines"),
        chosen(lambda x: _is_line(x) & ~x["confirmed"]).alias("other_lines"),
        chosen(lambda x: ~_is_line(x) & x["confirmed"]).alias("over"),
        chosen(lambda x: ~_is_line(x) & ~x["confirmed"]).alias("other_over"),
    )
    alone = F.filter(
        "over", lambda p: ~F.exists("notice_lines", lambda x: _overlap(p, x) & (x["family"] == p["family"]))
    )
    parts = parts.withColumn("alone", alone)
    unknown_lines = F.filter("other_lines", lambda x: ~F.exists("alone", lambda p: _overlap(p, x)))
    unknown_over = F.filter(
        "other_over",
        lambda p: ~F.exists(F.concat("notice_lines", "other_lines", "over"), lambda x: _overlap(p, x)),
    )
    # Passages that aren't confirmed have no family of their own.
    unnamed = F.transform(unknown_over, lambda p: p.withField("family", F.lit(NONE)))
    families = F.transform(F.concat("notice_lines", "alone"), lambda x: x["family"])
    return parts.select(
        "id",
        "th",
        F.expr("n_paragraphs div copies").alias("n_paragraphs"),
        (F.size("notice_lines") + _runs(F.col("alone"))).alias("n_notices"),
        (F.size(unknown_lines) + _runs(unnamed)).alias("n_unknown"),
        F.sort_array(F.array_distinct(families)).alias("families"),
        F.sequence(F.lit(1), "copies").alias("copies"),
    ).withColumn("copies", F.explode("copies")).drop("copies")
