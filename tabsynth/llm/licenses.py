"""Licence notices by a trained paragraph classifier, confirmed against templates.

Paragraphs are lines and, for notices that are wrapped, blocks of lines between blank ones.  Where
one reaches a template, the span of words that holds most of it is classified instead of the
whole, so prose around a notice does not count (``spans``).  A multinomial logistic regression on hashed word 1- and 2-grams tells the licence families and an
unknown class apart; a second regression on held-out rows turns its margin into a calibrated
probability; a family is confirmed when the paragraph holds enough of the word pairs of one of
its templates.  What can be confirmed is always scored: to hold that share of a template's pairs,
a text must hold at least one of any set of them that is larger than the rest (``pair_filter``).

Training rows are made from the templates (words dropped, foreign words around them) and, for
the unknown class, from a bounded sample of about ``sample`` lines of the corpus and from
templates cut down to a few words."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank

# Short notices by family.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
CUE = r"(?i)\b(licen[cs]e[ds]?|permission|redistribut(e|ion)|warranties)\b"
UNKNOWN = "unknown"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where a lambda inside reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pairs_in(words: Column) -> Column:
    """``pairs_of`` for a column, also inside a lambda."""
    return once(words, lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))).otherwise(w))


def pairs_of(words: str) -> Column:
    """Neighbouring words joined by a blank; a single word is its own pair."""
    return F.expr(f"case when size({words}) > 1 then transform(sequence(0, size({words}) - 2), i -> concat({words}[i], ' ', {words}[i + 1])) else {words} end")


def templates(spark: SparkSession, listed: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    rows = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(listed)], "template int, family string, notice string")
    return rows.withColumn("words", words_of(F.col("notice"))).withColumn("pairs", F.array_distinct(pairs_of("words"))).drop("notice")


def template_pairs(spark: SparkSession) -> list[list[str]]:
    """The word pairs of each template, by its number."""
    return [r["pairs"] for r in templates(spark).select("template", "pairs").orderBy("template").collect()]


def pair_filter(parts: list[list[str]], least_coverage: float) -> str:
    """Pattern found in every lower-case text that holds ``least_coverage`` of the pairs of one of
    the lists: of each list, the longest pairs, one more than such a text may lack."""
    gap, chosen = r"[^\p{L}\p{N}]+", set()
    for pairs in parts:
        may_lack = len(pairs) - max(1, math.ceil(least_coverage * len(pairs) - 1e-9))
        chosen.update(sorted(pairs, key=lambda p: (-len(p), p))[:may_lack + 1])
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(p.replace(' ', gap) for p in sorted(chosen))})(?![\p{{L}}\p{{N}}])"


def reached(pairs: Column, parts: list[list[str]], least_coverage: float) -> Column:
    """Numbers of the templates of whose pairs at least ``least_coverage`` are among ``pairs``."""
    forms = F.array(*[F.struct(F.lit(i).alias("template"), F.array(*map(F.lit, p)).alias("parts")) for i, p in enumerate(parts)])
    return once(pairs, lambda own: F.transform(F.filter(
        forms, lambda t: F.size(F.array_intersect(t["parts"], own)) / F.size(t["parts"]) >= least_coverage), lambda t: t["template"]))


def spans(pairs: Column, at: Column, parts: list[list[str]]) -> Column:
    """Of each template numbered in ``at``, the leftmost stretch of ``pairs``, at most twice as
    long as the template, that holds most of its pairs: structs (coverage, order, template,
    start, end), end exclusive.  Of overlapping ones the best stays; ties go to the first
    template.  Every place is the start of one stretch and looks at most at the places after it
    that the stretch can hold, so long texts cost no more a word than short ones."""
    forms = F.array(*[F.struct(F.lit(i).alias("template"), F.array(*map(F.lit, p)).alias("parts")) for i, p in enumerate(parts)])

    def best(t, own):
        reach = 2 * F.size(t["parts"])
        every = F.filter(F.transform(own, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: F.array_contains(t["parts"], x["p"]))

        def stretch(places, x, k):
            inside = F.filter(F.slice(places, k + 1, reach), lambda y: y["i"] < x["i"] + reach)
            return once(inside, lambda held: F.struct(
                (F.size(F.array_distinct(F.transform(held, lambda y: y["p"]))) / F.size(t["parts"])).alias("coverage"),
                (-x["i"]).alias("left"), (-F.size(held)).alias("held"), (F.element_at(held, -1)["i"] + 1).alias("end")))
        top = once(every, lambda places: F.array_max(F.transform(places, lambda x, k: stretch(places, x, k))))
        return once(top, lambda b: F.struct(b["coverage"].alias("coverage"), (-t["template"]).alias("order"), t["template"].alias("template"),
                                            (-b["left"]).alias("start"), b["end"].alias("end")))

    def better(b, a):
        return (b["start"] < a["end"]) & (a["start"] < b["end"]) & (
            (b["coverage"] > a["coverage"]) | ((b["coverage"] == a["coverage"]) & (b["order"] > a["order"])))
    found = once(pairs, lambda own: F.transform(F.filter(forms, lambda t: F.array_contains(at, t["template"])), lambda t: best(t, own)))
    return once(found, lambda all_: F.filter(all_, lambda a: ~F.exists(all_, lambda b: better(b, a))))


def paragraphs(docs: DataFrame, parts: list[list[str]], least_coverage: float) -> DataFrame:
    """(doc_id, paragraph, n_lines, start, words, pairs, by_line) from (doc_id, text): every line
    that has a cue word or reaches a template, and every block of several lines that reaches one
    which none of its lines does; ``by_line`` are those that its lines reach.  A line or block that
    reaches templates gives a row for each of their ``spans``, from its word number ``start``."""
    maybe = pair_filter(parts, least_coverage)

    def kept(text):
        return text.rlike(CUE) | F.lower(text).rlike(maybe)

    def empty(line):
        return F.trim(F.regexp_replace(line, r"\s+", " ")) == ""
    lines, at = F.col("lines"), F.sequence(F.lit(0), F.size("lines") - 1)
    first = F.filter(at, lambda i: ~empty(F.get(lines, i)) & ((i == 0) | empty(F.get(lines, i - 1))))
    last = F.filter(at, lambda i: ~empty(F.get(lines, i)) & ((i == F.size(lines) - 1) | empty(F.get(lines, i + 1))))
    blocks = docs.where(kept(F.col("text"))).withColumn("lines", F.split("text", "\n"))
    blocks = blocks.select("doc_id", "lines", F.explode(F.arrays_zip(first.alias("first"), last.alias("last"))).alias("block"))
    blocks = blocks.select("doc_id", F.col("block.first").alias("first"), F.slice("lines", F.col("block.first") + 1, F.col("block.last") - F.col("block.first") + 1).alias("lines"))
    blocks = blocks.where(kept(F.array_join("lines", "\n"))).withColumn("none", F.array().cast("array<int>"))

    def held(text):
        """The templates that a text reaches; only texts with a pair that they need are split."""
        return F.when(F.lower(text).rlike(maybe), reached(pairs_in(words_of(text)), parts, least_coverage)).otherwise(F.col("none"))
    blocks = blocks.withColumn("held", F.transform("lines", held)).withColumn("by_line", F.array_distinct(F.flatten("held")))
    single = blocks.select("doc_id", "none", "first", F.posexplode(F.arrays_zip("lines", "held")).alias("k", "line"))
    single = single.where(F.col("line.lines").rlike(CUE) | (F.size("line.held") > 0)).select(
        "doc_id", (F.col("first") + F.col("k")).alias("paragraph"), F.lit(1).alias("n_lines"), F.col("line.lines").alias("text"), F.col("none").alias("by_line"), F.col("line.held").alias("reached"))
    whole = blocks.where("size(lines) > 1").withColumn("text", F.array_join("lines", "\n"))
    whole = whole.withColumn("reached", F.array_except(held(F.col("text")), F.col("by_line"))).where("size(reached) > 0")
    whole = whole.select("doc_id", F.col("first").alias("paragraph"), F.size("lines").alias("n_lines"), "text", "by_line", "reached")
    rows = single.unionByName(whole).withColumn("words", words_of(F.col("text"))).where("size(words) > 0")
    rows = rows.select("doc_id", "paragraph", "n_lines", "by_line", "words", F.explode_outer(F.when(
        F.size("reached") > 0, spans(pairs_of("words"), F.col("reached"), parts))).alias("span"))
    start = F.coalesce(F.col("span.start"), F.lit(0))
    part = F.when(F.col("span").isNull(), F.col("words")).otherwise(F.slice("words", start + 1, F.col("span.end") - start + 1))
    rows = rows.select("doc_id", "paragraph", "n_lines", "by_line", start.alias("start"), part.alias("words"))
    return rows.withColumn("pairs", pairs_of("words"))


def _draw(*what) -> Column:
    """A number in [0, 1) fixed by its arguments."""
    return F.pmod(F.xxhash64(*what), F.lit(1 << 30)) / F.lit(float(1 << 30))


def training_rows(spark: SparkSession, docs: DataFrame, sample: int = 4000, variants: int = 120) -> DataFrame:
    """(label, words, held): label 0 is unknown, the families follow by name."""
    forms = templates(spark).select("template", "family", "words", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))).alias("variant"))
    total = docs.count()
    drawn = docs.where(_draw(F.lit("licence sample"), F.col("doc_id")) < F.lit(min(1.0, sample / 4 / max(1, total))))
    lines = drawn.select("doc_id", F.posexplode(F.split(blank("text"), "\n")).alias("at", "line"))
    lines = lines.where(_draw(F.lit("line"), F.col("doc_id"), F.col("at")) < 0.5)
    plain = lines.select(words_of(F.col("line")).alias("words")).where("size(words) > 0")
    plain = plain.where(F.size(reached(pairs_in(F.col("words")), template_pairs(spark), 0.6)) == 0)  # cue words alone make no notice
    plain = plain.select(F.lit(UNKNOWN).alias("family"), F.slice("words", 1, 60).alias("words"))
    lost = F.filter("words", lambda w, i: _draw(F.lit("drop"), F.col("template"), F.col("variant"), i) >= 0.08)
    strange = F.transform(F.sequence(F.lit(1), (_draw(F.lit("around"), F.col("template"), F.col("variant")) * 7).cast("int") + 1),
                          lambda i: F.concat(F.lit("w"), F.xxhash64(F.col("template"), F.col("variant"), i).cast("string")))
    known = forms.select("family", F.when(F.col("variant") % 2 == 0, lost).otherwise(F.concat(lost, strange)).alias("words"))
    begin = (_draw(F.lit("cut"), F.col("template"), F.col("variant")) * F.size("words")).cast("int") + 1
    scraps = forms.where("variant % 4 = 0").select(F.lit(UNKNOWN).alias("family"), F.concat(strange, F.slice("words", begin, 2), strange).alias("words"))
    names = F.create_map(*[F.lit(x) for i, f in enumerate(_families()) for x in (f, float(i))])
    rows = known.unionByName(plain).unionByName(scraps)
    return rows.select(names[F.col("family")].alias("label"), "words", (_draw(F.lit("fold"), F.array_join("words", " ")) < 0.25).alias("held"))


def _families() -> list[str]:
    return [UNKNOWN, *sorted({f for f, _ in TEMPLATES})]


def fit(spark: SparkSession, docs: DataFrame, features: int = 1 << 14) -> PipelineModel:
    """Classifier and calibration; applied by ``score``."""
    rows = training_rows(spark, docs).withColumn("grams", F.concat("words", pairs_of("words"))).persist()
    classify = Pipeline(stages=[
        HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True),
        LogisticRegression(family="multinomial", maxIter=40, regParam=1e-3, featuresCol="features", labelCol="label"),
    ]).fit(rows.where("not held"))
    held = _margins(classify.transform(rows.where("held"))).withColumn("right", (F.col("prediction") == F.col("label")).cast("double"))
    ends = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (8.0, 1.0)], "margin double, right double")  # both outcomes are present
    calibrate = Pipeline(stages=[
        VectorAssembler(inputCols=["margin"], outputCol="margins"),
        LogisticRegression(featuresCol="margins", labelCol="right", probabilityCol="calibrated", rawPredictionCol="calibrated_raw", predictionCol="calibrated_as", maxIter=40),
    ]).fit(held.select("margin", "right").union(ends))
    rows.unpersist()
    return PipelineModel([classify, calibrate])


def _margins(scored: DataFrame) -> DataFrame:
    """Log odds of the two likeliest classes."""
    first = F.sort_array(vector_to_array("probability"), asc=False)
    return scored.withColumn("margin", F.log((first[0] + 1e-9) / (first[1] + 1e-9)))


def scan_licenses(spark: SparkSession, docs: DataFrame, least_probability: float = 0.5, least_coverage: float = 0.6) -> DataFrame:
    """One row for each line with a cue word, for each span of a line that holds most of a
    template, and for each such span of a block of several lines whose template no line has:
    doc_id, paragraph (number of the first line from 0), family, predicted, probability, coverage,
    template, confirmed, n_lines, start and n_words (the span in words of the line or block).  A
    template is looked for once in a line or block, at its best and leftmost place; of equal
    probabilities the classifier takes the first family by name.  family is the predicted one where the calibrated probability
    and the share of a template's word pairs both reach their bounds, else ``unknown``.  Null and
    empty texts have no such lines; repeated rows repeat theirs; other columns are not read."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), blank("text").alias("text"))
    classify, calibrate = fit(spark, docs).stages
    lines = paragraphs(docs, template_pairs(spark), least_coverage).withColumn("grams", F.concat("words", "pairs"))
    scored = calibrate.transform(_margins(classify.transform(lines)))
    names = F.array(*[F.lit(f) for f in _families()])
    scored = scored.select("doc_id", "paragraph", "n_lines", "start", F.size("words").alias("n_words"), "pairs", "by_line", names[F.col("prediction").cast("int")].alias("predicted"),
                           vector_to_array("calibrated")[1].alias("probability"))
    by_family = F.broadcast(templates(spark).groupBy(F.col("family").alias("predicted")).agg(F.collect_list(F.struct("template", F.col("pairs").alias("parts"))).alias("forms")))
    own = F.filter("forms", lambda t: ~F.array_contains(F.col("by_line"), t["template"]))
    compared = F.transform(own, lambda t: F.struct(
        (F.size(F.array_intersect(t["parts"], F.col("pairs"))) / F.size(t["parts"])).alias("coverage"), (-t["template"]).alias("order")))
    best = F.array_max(compared)
    out = scored.join(by_family, "predicted", "left").withColumn("best", best)
    confirmed = (F.col("probability") >= least_probability) & (F.coalesce(F.col("best.coverage"), F.lit(0.0)) >= least_coverage)
    return out.select("doc_id", "paragraph", F.when(confirmed, F.col("predicted")).otherwise(UNKNOWN).alias("family"), "predicted",
                      F.round("probability", 6).alias("probability"), F.round(F.coalesce("best.coverage", F.lit(0.0)), 6).alias("coverage"),
                      (-F.col("best.order")).alias("template"), confirmed.alias("confirmed"), "n_lines", "start", "n_words")
