"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

Only DataFrame functions. A template is a standard license statement or notice, as a set of words. A block is any
run of consecutive words of a text, across line breaks, that is `SPAN` times as long as the template. A template is
found in a block that holds at least `THRESHOLD` of its distinct words, all its marks (the words that tell it from
its look-alikes) and none of the words that belong to another license.

1. One scan cuts each text into words and keeps, beside the base phrases' places, which template words it holds;
   the words themselves are kept only of texts that hold enough words of some template, and its marks (length
   filter). The result is stored.
2. Template words are ordered by how many texts of the corpus hold them, rarest first. A block that meets the
   threshold holds one of the first `n - need + 1` words of the template (prefix filter), so only the blocks around
   such words are looked at, and only where what lies around holds enough (positional filter).
3. What passes is verified: of the blocks that hold the word, the one with the largest intersection counts.

The templates are a fixed small table, so broadcasting them has a fixed bound.

Defined cases: null texts are empty: no words, no labels, score 0. Repeated rows get equal results. Very long texts
are scanned whole. An empty table gives no rows. Extra columns are ignored. Letters beyond ASCII are words' letters;
lower() maps none of them to a letter of a base phrase.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm.common import keyed, stored

THRESHOLD, SPAN = 0.8, 1.25
#: Fixed by the contract: phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Template(NamedTuple):
    label: str
    text: str
    marks: tuple[str, ...]
    without: tuple[str, ...] = ()

    @property
    def words(self) -> list[str]:
        return sorted(set(self.text.split()))

    @property
    def span(self) -> int:
        """Words of a block."""
        return -(-round(SPAN * 100 * len(self.text.split())) // 100)

    def need(self, threshold: float = THRESHOLD) -> int:
        return -(-len(self.words) * round(threshold * 1000) // 1000)


# Statements that name a license, and the standard notices' first sentences, in lower case without
# punctuation; the words that a block must hold, and those that it must not.
TEMPLATES = [
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc", "nc")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu", "general", "3"), ("lesser", "affero")),
    Template("mit", "released under the mit license", ("mit",)),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution", "binary")),
    Template("cc-by", "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0", ("commons", "attribution"), ("nc", "noncommercial", "nd", "sa")),
    Template("cc-by-nc", "this work is licensed under the creative commons attribution noncommercial 4 0 international license to view a copy of this license visit http creativecommons org licenses by nc 4 0", ("commons", "noncommercial")),
    Template("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu", "general", "2"), ("lesser", "affero", "3")),
    Template("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu", "general", "3"), ("lesser", "affero")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission", "fee", "notice")),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ("gnu", "lesser")),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission", "sublicense")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla", "mpl")),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("unencumbered",)),
]
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NO_WORDS = "cast(array() as array<string>)"


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.expr(_NO_WORDS)


def _plain(text: Column) -> Column:
    """Lower-cased words with one space between."""
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def _places(words: str, phrase: str) -> Column:
    """Where a phrase's words stand consecutively. words names a column: inside the filter it is looked up
    for every place, so it must not be an expression that would be evaluated there."""
    want = phrase.split()
    first = F.filter(F.transform(words, lambda w, i: F.when(w == want[0], i)), lambda i: i.isNotNull())

    def stands(i):
        out = F.lit(True)
        for k, w in enumerate(want[1:], 1):
            out = out & (F.get(words, i + k) == w)
        return out

    return F.filter(first, lambda i: F.coalesce(stands(i), F.lit(False)))


def _may_hold(held: Column, t: Template, threshold: float) -> Column:
    """Whether words of these may make a block of a template."""
    marks = reduce(lambda a, b: a & b, [F.array_contains(held, m) for m in t.marks])
    return marks & (F.size(F.array_intersect(held, _strings(t.words))) >= t.need(threshold))


def scanned(spark: SparkSession, docs: DataFrame, templates: list[Template], threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, id, rk, n_words, the places of each base phrase, the template words held, and the words of texts
    that may hold a template; stored. docs is keyed()."""
    vocabulary = sorted({w for t in templates for w in t.words})
    padded = docs.select("doc_id", "id", "rk", F.concat(F.lit(" "), _plain(F.col("text")), F.lit(" ")).alias("plain"))
    cut = padded.withColumn("words", F.when(F.col("plain") == "  ", F.expr(_NO_WORDS)).otherwise(F.split(F.trim("plain"), " ")))
    holds = reduce(lambda a, b: a | b, [F.col("plain").contains(f" {p} ") for p in BASE])
    listed = cut.withColumn("held", F.array_intersect("words", _strings(vocabulary))).withColumn("searched", F.when(holds, F.col("words")).otherwise(F.expr(_NO_WORDS)))
    likely = reduce(lambda a, b: a | b, [_may_hold(F.col("held"), t, threshold) for t in templates])
    places = [_places("searched", p).alias(f"at_{k}") for k, p in enumerate(BASE)]
    return stored(spark, listed.select("doc_id", "id", "rk", F.size("words").cast("long").alias("n_words"), *places, "held", F.when(likely, F.col("words")).alias("words")), "license-texts")


def _values(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of plain words, numbers and lists of words as an inline table of SQL."""

    def text(x) -> str:
        return f"cast(array({', '.join(map(text, x))}) as array<string>)" if isinstance(x, list) else f"'{x}'" if isinstance(x, str) else str(x)

    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)} AS t({', '.join(names)})")


def template_matches(spark: SparkSession, texts: DataFrame, templates: list[Template], threshold: float = THRESHOLD) -> DataFrame:
    """id, rk, label, containment and first_word of the best block of every template found in scanned() texts."""
    counted = texts.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # At most one row for each word of the templates.
    often = {r["word"]: r["n"] for r in counted.collect()}
    rows = []
    for k, t in enumerate(templates):
        ordered = sorted(t.words, key=lambda w: (often.get(w, 0), w))
        need = t.need(threshold)
        rows += [(w, k, t.label, t.words, list(t.marks), list(t.without), need, t.span) for w in ordered[: len(ordered) - need + 1]]
    index = _values(spark, rows, ["word", "template", "label", "wanted", "marks", "without", "need", "span"])
    # Of a text only what lies around the words of some prefix goes on, as far as the longest block reaches.
    reach = max(t.span for t in templates)
    first = F.array(*[F.lit(w) for w in sorted({r[0] for r in rows})])

    def near(w: Column, at: Column) -> Column:
        begin = F.greatest(at - reach + 1, F.lit(0))
        return F.when(F.array_contains(first, w), F.struct(w.alias("word"), at.alias("at"), begin.alias("from"), F.slice("words", begin + 1, at + reach - begin).alias("near")))

    hits = texts.where("words is not null").select("id", "rk", F.explode(F.filter(F.transform("words", near), lambda h: h.isNotNull())).alias("hit")).select("id", "rk", "hit.*")
    found = hits.join(F.broadcast(index), "word")
    begin = F.greatest(F.col("at") - F.col("span") + 1, F.lit(0))
    own = F.slice("near", begin - F.col("from") + 1, F.col("at") + F.col("span") - begin)
    around = found.select("id", "rk", "template", "label", "wanted", "marks", "without", "need", "span", begin.alias("begin"), own.alias("near"), (F.col("at") - begin).alias("last"))
    around = around.where((F.size(F.array_intersect("near", "wanted")) >= F.col("need")) & (F.size(F.array_intersect("near", "marks")) == F.size("marks")))

    def block(s: Column) -> Column:
        """How much the block from word s on holds; null if it lacks a mark or holds a foreign word."""
        own = F.slice("near", s + 1, F.col("span"))
        fits = (F.size(F.array_intersect(own, F.col("marks"))) == F.size("marks")) & ~F.arrays_overlap(own, F.col("without"))
        return F.struct(F.when(fits, F.size(F.array_intersect(own, F.col("wanted")))).alias("shared"), (-s - F.col("begin")).alias("place"))

    best = around.withColumn("best", F.array_max(F.transform(F.sequence(F.lit(0), F.col("last")), block))).where(F.col("best.shared") >= F.col("need"))
    return best.groupBy("id", "rk", "label").agg(F.max(F.struct((F.col("best.shared") / F.size("wanted")).alias("containment"), F.col("best.place").alias("place"))).alias("b")).select("id", "rk", "label", "b.containment", (-F.col("b.place")).alias("first_word"))


def scan_licenses(spark: SparkSession, documents: DataFrame, templates: list[Template] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    templates = templates or TEMPLATES
    texts = scanned(spark, keyed(documents), templates, threshold)
    found = template_matches(spark, texts, templates, threshold).groupBy("id", "rk").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    at = [F.col(f"at_{k}") for k in range(len(BASE))]
    places = F.concat(*at)
    labels = F.array_compact(F.array(*[F.when(F.size(a) > 0, F.lit(label)) for a, label in zip(at, BASE.values(), strict=True)]))
    both = F.array_union(labels, F.coalesce("found", F.expr(_NO_WORDS)))
    return texts.drop("words", "held").join(found, ["id", "rk"], "left").select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"), F.array_join(F.array_sort(both), ",").alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
