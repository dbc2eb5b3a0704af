"""Operator 3: licence notices found by Dice coefficient over word bigrams.

A text is lower-cased and everything but a-z, 0-9 and line ends becomes one
space.  Its segments are its lines, its paragraphs of several lines, and the
whole text if it has several paragraphs.  A segment matches a template when
the Dice coefficient of their sets of word bigrams is at least the threshold.

A Dice coefficient of t needs sizes within a factor of t / (2 - t) of each
other, so a template is only compared with segments of sizes it can match:
the templates, listed once per size they allow, are joined on that size.
Texts, and then segments, without the two words of any guard are dropped before
that: guards are so many of a template's bigrams that no segment can match
without one.  Their words are looked for before a text is normalised, which
costs far more, and normalising only cuts words apart, so none is lost.

Only DataFrame functions are used.  Segments stay on the executor that read
the text; only matches (few) are shuffled to be summed up per document.  The
joined template list is fixed by this module or by the caller's own list and
does not grow with the corpus.

Defined results: a null text has no segments; a segment of fewer than two
words has no bigrams and never matches; rows with the same doc_id are summed
up together; several templates may match one segment, each counts; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The wording of common licence notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
THRESHOLD = 0.8


def normalise(text: str) -> str:
    """The SQL rule for one Python string; templates go through it."""
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower())
    return " ".join(kept.split())


def bigrams(text: str) -> list[str]:
    words = normalise(text).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def size_bounds(size: int, threshold: float) -> range:
    """The numbers of bigrams that a segment can have to reach the threshold with a template of this size."""
    return range(-(-int(size * threshold * 10**6) // int((2 - threshold) * 10**6)), int(size * (2 - threshold) / threshold + 1e-9) + 1)


def guards(grams: list[str], threshold: float) -> list[tuple[str, str]]:
    """Bigrams of which every matching segment has one, as (longer word, other word).

    So many of them that the others are too few for the threshold; those with
    the longest words, as they are rarest.
    """
    must_share = threshold * (min(size_bounds(len(grams), threshold)) + len(grams)) / 2
    pairs = [tuple(sorted(g.split(), key=lambda w: (-len(w), w))) for g in grams]
    pairs.sort(key=lambda p: (-len(p[0]), -len(p[1]), p))
    return pairs[: len(grams) + 1 - math.ceil(must_share - 1e-9)]


def _any_guard(text: Column, pairs: set[tuple[str, str]]) -> Column:
    """Whether text holds both words of a guard; "license" also stands for the words it is a part of."""
    stems = [w for w in sorted({a for a, _ in pairs}) if not any(v != w and v in w for v, _ in pairs)]
    by_stem: dict[str, set[str]] = {}
    for a, b in pairs:
        by_stem.setdefault(next(w for w in stems if w in a), set()).add(b)
    met = lambda bs: reduce(or_, (text.contains(b) for b in sorted(bs, key=lambda w: (-len(w), w))))
    return reduce(or_, (text.contains(w) & met(bs) for w, bs in by_stem.items()), F.lit(False))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, best (highest coefficient), n_segments: one row per document and licence found."""
    spark = docs.sparkSession
    known = [(name, grams, n) for name, text in templates if (grams := bigrams(text)) for n in size_bounds(len(grams), threshold)]
    table = spark.createDataFrame(known, "license string, template array<string>, n_grams int")
    pairs = {p for _, text in templates if (grams := bigrams(text)) for p in guards(grams, threshold)}
    least, most = min((n for _, _, n in known), default=1), max((n for _, _, n in known), default=0)

    clean = F.regexp_replace("low", r"[^a-z0-9\n]+", " ")
    paragraphs = F.filter(F.split("clean", r"\n *\n"), lambda p: p.contains("\n"))
    whole = F.when(F.col("clean").rlike(r"\n *\n"), F.array("clean")).otherwise(F.array().cast("array<string>"))
    segments = F.concat(F.split("clean", "\n"), paragraphs, whole)
    words = F.filter(F.split(F.translate("segment", "\n", " "), " "), lambda w: w != "")
    n = F.size("words")
    less = F.greatest(n - 1, F.lit(0))
    grams = F.array_distinct(F.zip_with(F.slice("words", F.lit(1), less), F.slice("words", F.lit(2), less), lambda a, b: F.concat(a, F.lit(" "), b)))
    found = (
        docs.select("doc_id", F.lower("text").alias("low"))
        .where(_any_guard(F.col("low"), pairs))
        .select("doc_id", clean.alias("clean"))
        .select("doc_id", F.explode(segments).alias("segment"))
        .where(_any_guard(F.col("segment"), pairs))
        .select("doc_id", words.alias("words"))
        .where(n >= least + 1)
        .select("doc_id", grams.alias("grams"))
        .where(F.size("grams").between(least, most))
        .withColumn("n_grams", F.size("grams"))
        .join(F.broadcast(table), "n_grams")
        .withColumn("dice", 2.0 * F.size(F.array_intersect("grams", "template")) / (F.size("grams") + F.size("template")))
        .where(F.col("dice") >= threshold)
    )
    return found.groupBy("doc_id", "license").agg(F.round(F.max("dice"), 6).alias("best"), F.count("*").alias("n_segments"))
