"""Licence scans: a trained classifier of passages, in DataFrame and ML functions of Spark only.

A text is cut into passages at blank lines and sentence ends; a passage of several lines is judged whole (lines that were wrapped) and
line by line. Passages are bags of word 1-, 2- and 3-grams of a fixed vocabulary
(those of the templates), and a multinomial logistic regression over these sparse counts gives each licence family, and the
class of other texts, a probability. A second regression, on the log-odds of the best family over training passages that the
first has not seen, calibrates it. There are two more classes: other texts, and licences that are none of the families. Where other texts win, a passage
is none. Else it has the licence of its family if that is sure (0.5 at least) and confirmed: as many of its 2-grams must be a template's, or of
the template's its own, as CONFIRMED says. What is a licence to the model but not sure, not confirmed or of no family is unknown.

Only passages that share vocabulary with the licences are classified: at least 2 of their 2-grams and a share of OVERLAP, or enough of some template to be confirmed. By
definition others are none. The count is tested first: each template, and each passage that is compared by its own 2-grams, has at least 3 of these, so at least 2
must be shared; and a line's 2-grams are all those of its passage. No text leaves its row's task but the few passages that are classified.

Training takes the fixed templates, cut into windows, the fixed texts of other kinds, and at most NEGATIVES distinct passages of the
corpus that share too little to be classified (those with the least hashes, of about 8 * NEGATIVES documents chosen by hash); it learns nothing else from the corpus.

Defined cases: null and empty texts have no passages and the licence "none". Texts are read whole. A document with several licences
names all, sorted; repeated passages count each time. Repeated rows are judged each for itself; a null doc_id stays. Of families that are
equally likely the first in order is the best. Columns named as those of the result are replaced. Where a passage of several lines is confirmed whole, its
lines count only for other licences; where not, each line counts, and the whole (as unknown) only if no line does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import table, thinned

#: Public licences' notices and sentences by which each is known.
TEMPLATES = {
    "agpl-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0-1.0": [
        "Released under CC0 1.0 into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "This document is proprietary and confidential. All rights reserved.",
    ],
}
OTHER = "other"
#: Licences of no family, and texts with the same words that are no licences.
UNLISTED = [
    "Licensed under a custom license.", "Released under the terms of an unknown license.", "See the license file for details.", "This work is licensed under the terms stated elsewhere.",
    "This code may be used, copied, modified and sold by anyone for any purpose at no cost.", "Permission to use, copy, modify and distribute this software for any purpose with or without fee is hereby granted.",
    "This software is provided as is, without any express or implied warranty.", "You are free to use this work for any purpose, provided that you give credit to the author.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this document.", "This data may be used for research purposes only and may not be sold.", "Free for personal use, commercial use requires a license from the author.",
    "Anyone is free to copy, modify, publish, use, compile, sell or distribute this software.", "Use of this software is governed by the terms of the vendor's license agreement.",
]
OTHERS = [
    "His driver's license was revoked after the accident.", "The restaurant lost its liquor license last year.", "The copyright office opened a new building.", "She asked for permission to leave the room.",
    "No warranty was given for the used car.", "The shop sells licensed toys and games.", "The redistribution of wealth is a topic of public debate.", "The statue is in the public domain of the city.",
    "You may not use this door except in an emergency.", "The permission slip was signed by the teacher.", "Copyright law protects original works of authors.", "The pilot held a commercial license, version unknown.",
    "The room may be used by anyone for any purpose at no cost.", "He sold modified copies of the painting to a person of the city.",
]
NEGATIVES, CONFIRMED, OVERLAP = 1_000, 0.6, 0.4
FAMILIES = (OTHER, *sorted(TEMPLATES), "unknown")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def passages(text: Column) -> Column:
    return F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"\n\s*\n\s*|(?<=[.!?;])\s+")


def words_of(passage: Column) -> Column:
    return F.array_remove(F.split(passage, r"[^a-z0-9.\u0080-￿]+|\.+(?![a-z0-9])|(?<![a-z0-9])\.+"), "")


def grams(words: Column, n: int) -> Column:
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - n + 1, F.lit(0))), lambda w, i: F.array_join(F.slice(words, i + 1, n), " "))


def pairs(words: Column) -> Column:
    """The distinct 2-grams."""
    return F.array_distinct(grams(words, 2))


def _template_pairs() -> list[list[str]]:
    """Each fixed template's distinct 2-grams, by the rules of words_of; those of licences of no family come last."""
    word = re.compile(r"[^a-z0-9.\u0080-\uffff]+|\.+(?![a-z0-9])|(?<![a-z0-9])\.+")
    out = []
    for text in (t for ts in (*TEMPLATES.values(), UNLISTED) for t in ts):
        words = [w for w in word.split(text.lower()) if w]
        out.append(sorted({f"{a} {b}" for a, b in zip(words, words[1:])}))
    return out


def shares(own: Column, shared: Column, template: Column) -> Column:
    """The likeness of a passage with the distinct 2-grams own (shared: those that any template has) to a template's."""
    share = lambda of: F.coalesce(F.try_divide(F.size(F.array_intersect(shared, template)), F.size(of)), F.lit(0.0))
    return F.greatest(share(template), F.when(F.size(own) >= 3, share(own)).otherwise(0.0))


def overlaps(own: Column, shared: Column) -> Column:
    """Whether a passage shares enough with the licences to be unknown."""
    return (F.size(shared) >= 2) & (F.size(shared) >= OVERLAP * F.size(own))


def candidates(text: Column, gated: bool = True) -> Column:
    """Of a text, an array of (passage, unit: its number, line: 0 for the whole): those that can be confirmed or share enough with the licences.
    gated: without it, all that aren't empty."""
    templates = _template_pairs()
    known = sorted({g for t in templates for g in t})
    listed = F.array(*[F.array(*[F.lit(g) for g in t]) for t in templates[: -len(UNLISTED)]])
    one_line = lambda p: F.translate(p, "\n", " ")

    def with_pairs(parts: Column) -> Column:
        own = F.transform(parts, lambda x: F.struct(x.alias("x"), words_of(x["passage"]).alias("words")))
        own = F.transform(own, lambda y: F.struct(y["x"].alias("x"), F.array_distinct(F.transform(y["words"], lambda w, i: F.concat(w, F.lit(" "), F.get(y["words"], i + 1)))).alias("own")))
        return F.transform(own, lambda y: F.struct(y["x"].alias("x"), F.array_compact(y["own"]).alias("own"), F.filter(y["own"], lambda g: g.isin(known)).alias("shared")))

    def few(y: Column) -> Column:
        return F.size(y["shared"]) >= 2

    def exact(y: Column) -> Column:
        return F.when(F.size(y["shared"]) >= 2, overlaps(y["own"], y["shared"]) | F.exists(listed, lambda t: shares(y["own"], y["shared"], t) >= CONFIRMED)).otherwise(False)

    whole = F.transform(passages(text), lambda p, u: F.struct(one_line(p).alias("passage"), p.alias("raw"), u.alias("unit")))
    whole = F.filter(with_pairs(whole), few) if gated else F.transform(whole, lambda x: F.struct(x.alias("x")))
    part = lambda p, x, line: F.struct(p.alias("passage"), x["unit"].alias("unit"), line.alias("line"))
    parts = F.flatten(F.transform(F.transform(whole, lambda y: F.struct(y["x"].alias("x"), F.split(y["x"]["raw"], "\n").alias("cut"))), lambda z: F.concat(
        F.array(part(z["x"]["passage"], z["x"], F.lit(0))),
        F.when(F.size(z["cut"]) > 1, F.transform(z["cut"], lambda p, i: part(p, z["x"], i + 1))).otherwise(F.array().cast("array<struct<passage:string,unit:int,line:int>>")),
    )))
    if gated:
        return F.transform(F.filter(with_pairs(parts), exact), lambda y: y["x"])
    return F.filter(parts, lambda x: F.length(x["passage"]) > 0)


def features(words: Column) -> Column:
    return F.concat(words, grams(words, 2), grams(words, 3))


@dataclass(frozen=True)
class Model:
    """vocabulary: the templates' n-grams, as counts. classes: the regression over them. slope, intercept: its calibration."""

    vocabulary: CountVectorizerModel
    classes: LogisticRegressionModel
    slope: float
    intercept: float

    def raw(self, df: DataFrame) -> DataFrame:
        """Adds best (number of the likeliest family), p_best, p_other for passages with a column words."""
        out = self.classes.transform(self.vocabulary.transform(df.withColumn("_grams", features(F.col("words")))))
        out = out.withColumn("_p", vector_to_array("_p"))
        best = F.array_max(F.slice("_p", 2, len(FAMILIES) - 1))
        return out.withColumn("p_best", best).withColumns({"best": F.array_position(F.slice("_p", 2, len(FAMILIES) - 1), F.col("p_best")).cast("int"), "p_other": F.get("_p", F.lit(0))}).drop("_grams", "_counts", "_p", "_raw", "_best")


def _log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def training(docs: DataFrame, negatives: int = NEGATIVES) -> DataFrame:
    """(label: family number, words, whole, weight): the templates and their windows, texts of other kinds, passages of the corpus
    that are no candidates (bounded). Families weigh the same together; whole templates (which are never kept for calibration) weigh more than windows."""
    spark = docs.sparkSession
    fixed = [(FAMILIES.index(f), t) for f, ts in (*TEMPLATES.items(), ("unknown", UNLISTED)) for t in ts] + [(0, t) for t in OTHERS]
    rows = spark.createDataFrame(fixed, "label int, text string").select("label", words_of(F.translate("text", _UPPER, _LOWER)).alias("words"))
    size = F.explode(F.filter(F.array(*[F.lit(n) for n in (5, 8, 12, 18)]), lambda n: n < F.size("words")))
    cut = rows.select("label", "words", size.alias("n")).select("label", "n", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("at")).select("label", F.slice("words", F.col("at"), F.col("n")).alias("words"))
    # a window that families share tells nothing of either
    cut = cut.groupBy("words").agg(F.min("label").alias("label"), F.max("label").alias("_hi")).select(F.when(F.col("label") == F.col("_hi"), F.col("label")).otherwise(0).alias("label"), "words")
    some = thinned(docs.select("text"), F.col("text"), negatives)
    found = some.select(passages(F.col("text")).alias("_all"), F.transform(F.filter(candidates(F.col("text")), lambda x: x["line"] == 0), lambda x: x["passage"]).alias("_found"))
    plain = found.select(F.explode(F.array_except(F.transform("_all", lambda p: F.translate(p, "\n", " ")), "_found")).alias("p")).where(F.length("p") > 0).distinct().orderBy(F.xxhash64("p"), "p").limit(negatives)
    out = rows.withColumn("whole", F.lit(True)).unionByName(cut.unionByName(plain.select(F.lit(0).alias("label"), words_of(F.col("p")).alias("words"))).withColumn("whole", F.lit(False)))
    out = out.withColumn("weight", F.when(F.col("whole"), 8.0).otherwise(1.0))
    share = out.groupBy("label").agg(F.sum("weight").alias("_all"))  # one row for each family
    return out.join(F.broadcast(share), "label").withColumn("weight", 100 * F.col("weight") / F.col("_all")).drop("_all")


def learn(docs: DataFrame, negatives: int = NEGATIVES) -> Model:
    spark = docs.sparkSession
    known = spark.createDataFrame([(t,) for ts in (*TEMPLATES.values(), UNLISTED) for t in ts], "text string").select(words_of(F.translate("text", _UPPER, _LOWER)).alias("words"))
    terms = sorted(r[0] for r in known.select(F.explode(features(F.col("words"))).alias("g")).distinct().collect())  # of the fixed templates
    vocabulary = CountVectorizerModel.from_vocabulary(terms, "_grams", "_counts")
    rows = training(docs, negatives).withColumn("kept", ~F.col("whole") & (F.pmod(F.xxhash64("words"), F.lit(4)) == 0)).cache()
    fit = LogisticRegression(featuresCol="_counts", labelCol="label", weightCol="weight", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_best", family="multinomial", regParam=0.002, maxIter=60, standardization=False)
    classes = fit.fit(vocabulary.transform(rows.where("not kept").withColumn("_grams", features(F.col("words"))).select("label", "weight", "_grams")))
    model = Model(vocabulary, classes, 1.0, 0.0)
    seen = model.raw(rows.where("kept")).select((F.col("best") == F.col("label")).cast("int").alias("label"), array_to_vector(F.array(_log_odds(F.col("p_best")))).alias("x"))
    both = seen.agg(F.min("label"), F.max("label")).first()
    if both[0] == 0 and both[1] == 1:
        line = LogisticRegression(featuresCol="x", labelCol="label", regParam=0.01, maxIter=50).fit(seen)
        model = Model(vocabulary, classes, float(line.coefficients[0]), float(line.intercept))
    rows.unpersist()
    return model


def scan_licenses(docs: DataFrame, model: Model, text: str = "text", gated: bool = True) -> DataFrame:
    """One row for each passage that is classified, and one for each row without any: the columns of docs, row (a key of the input row), passage,
    family (the licence, "unknown" where the model sees a licence that it can't name for sure, or null where the passage does not count), confidence (calibrated), likeness (to the family's templates)."""
    spark = docs.sparkSession
    each = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("_c", F.explode_outer(candidates(F.col(text), gated)))
    each = each.withColumns({"passage": F.col("_c.passage"), "_unit": F.col("_c.unit"), "_line": F.col("_c.line")}).drop("_c")
    each = model.raw(each.withColumn("words", words_of(F.coalesce("passage", F.lit("")))))
    known = spark.createDataFrame([(FAMILIES.index(f), t) for f, ts in TEMPLATES.items() for t in ts], "best int, t string")
    known = known.groupBy("best").agg(F.collect_list(pairs(words_of(F.translate("t", _UPPER, _LOWER)))).alias("_templates"))  # a dozen rows
    each = each.withColumn("_own", pairs(F.col("words"))).join(F.broadcast(known), "best", "left")
    likeness = F.when(F.col("passage").isNotNull(), F.coalesce(F.array_max(F.transform("_templates", lambda t: shares(F.col("_own"), F.col("_own"), t))), F.lit(0.0)))
    vocabulary = F.filter("_own", lambda g: g.isin(sorted({g for t in _template_pairs() for g in t})))
    each = each.withColumns({"likeness": likeness, "confidence": F.when(F.col("passage").isNotNull(), 1 / (1 + F.exp(-(model.slope * _log_odds(F.col("p_best")) + model.intercept))))})
    licence = F.col("p_best") > F.col("p_other")
    sure = licence & (F.col("best") < len(FAMILIES) - 1) & (F.col("confidence") >= 0.5) & (F.col("likeness") >= CONFIRMED)
    names = F.array(*[F.lit(f) for f in FAMILIES])
    family = F.when(F.col("passage").isNotNull(), F.when(sure, F.get(names, F.col("best"))).when(licence & overlaps(F.col("_own"), vocabulary), "unknown"))
    each = each.withColumn("family", family).drop("words", "best", "p_best", "p_other", "_own", "_templates")
    unit = W.partitionBy("row", "_unit")
    of_whole = F.max(F.when((F.col("_line") == 0) & (F.col("family") != "unknown"), F.col("family"))).over(unit)
    by_line = F.count(F.when(F.col("_line") > 0, F.col("family"))).over(unit)
    each = each.withColumns({"_whole": of_whole, "_by_line": by_line})
    counts = F.when(F.col("_line") > 0, F.col("_whole").isNull() | ~F.col("family").isin("unknown") & (F.col("family") != F.col("_whole"))).otherwise((F.col("family") != "unknown") | (F.col("_by_line") == 0))
    return each.withColumn("family", F.when(counts, F.col("family"))).drop("_unit", "_line", "_whole", "_by_line")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_licenses(docs, learn(docs)).select("row", "doc_id", "family", "confidence")
    named = F.col("family") != "unknown"
    return (
        found.groupBy("row", "doc_id")
        .agg(
            F.array_join(F.array_sort(F.collect_set(F.when(named, F.col("family")))), ",").alias("licenses"),
            F.count(F.when(named, 1)).alias("n_licensed"), F.count(F.when(~named, 1)).alias("n_unknown"), F.round(F.max(F.when(named, F.col("confidence"))), 6).alias("confidence"),
        )
        .select("doc_id", F.when(F.col("n_licensed") > 0, F.col("licenses")).when(F.col("n_unknown") > 0, "unknown").otherwise("none").alias("licenses"), "n_licensed", "n_unknown", "confidence")
    )
