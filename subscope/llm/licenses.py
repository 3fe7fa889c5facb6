"""License scans by an exact set-similarity join of text blocks with license templates.

A template is a published notice, a block the words around an occurrence of one of its rare
words, as far to either side as a copy of the notice may reach; line ends, comment marks and
punctuation do not count, so a notice is found however it is wrapped. Both are sets of words,
ordered by how many texts hold a word, rarest first. A block that holds at least ``threshold``
of a template's words shares one within the template's prefix with it (prefix filter, and
the reason why only those words start a block), has enough words of the templates at all
(length filter), and the places of that word leave enough words behind it (positional
filter). What remains is compared exactly.

A bag of words is no notice yet. So a block is confirmed where the words stand within a
quarter more than the notice's length, begin with an early word of it, and hold all the words
that tell its license from others. Of confirmed places that overlap, the one that shares the
most words with its template stays.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from math import ceil
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from subscope.llm.common import numbered, staged

#: Phrases whose consecutive words give a label.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_APACHE = "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_CC = "This work is licensed under a Creative Commons {} 4.0 International License"
_GNU = "This work is licensed under the GNU {}Public License, version {}"
#: Label, license notice as published, words without which it is another license's.
TEMPLATES = (
    ("mit", "Released under the MIT License", "mit"),
    ("mit", _MIT, "charge documentation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "fee"),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache 2"),
    ("apache-2", _APACHE, "compliance apache"),
    ("cc-by", "Licensed under CC BY 4.0", "cc by"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", "cc by nd"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0", "cc by nc sa"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0", "cc by nc nd"),
    ("cc-by", _CC.format("Attribution"), "attribution"),
    ("cc-by-sa", _CC.format("Attribution-ShareAlike"), "attribution sharealike"),
    ("cc-by-nc", _CC.format("Attribution-NonCommercial"), "attribution noncommercial"),
    ("cc-by-nd", _CC.format("Attribution-NoDerivatives"), "attribution noderivatives"),
    ("cc-by-nc-sa", _CC.format("Attribution-NonCommercial-ShareAlike"), "attribution noncommercial sharealike"),
    ("cc-by-nc-nd", _CC.format("Attribution-NonCommercial-NoDerivatives"), "attribution noncommercial noderivatives"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived"),
    ("gpl-2", _GNU.format("General ", 2), "gnu general 2"),
    ("gpl-3", _GNU.format("General ", 3), "gnu general 3"),
    ("lgpl-3", _GNU.format("Lesser General ", 3), "gnu lesser 3"),
    ("agpl-3", _GNU.format("Affero General ", 3), "gnu affero 3"),
    ("gpl", _GPL, "gnu general"),
    ("gpl-2", f"{_GPL}, either version 2 of the License, or (at your option) any later version", "gnu general 2"),
    ("gpl-3", f"{_GPL}, either version 3 of the License, or (at your option) any later version", "gnu general 3"),
    ("bsd", _BSD, "redistribution binary"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse 2"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
)
THRESHOLD = 0.8
#: Anything between words: all of ASCII but 0-9 and a-z.
BETWEEN = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


@dataclass(frozen=True)
class Notice:
    """A template: its distinct words in their order, and what a place of it must hold."""

    number: int
    label: str
    words: tuple[str, ...]
    telling: tuple[str, ...]
    #: Words shared at least.
    need: int
    #: Words of a text that a place may take up.
    span: int


def notices(threshold: float = THRESHOLD, templates=TEMPLATES) -> list[Notice]:
    made = []
    for number, (label, text, telling) in enumerate(templates):
        sequence = re.findall(f"[^{BETWEEN}]+", text.lower())
        words = tuple(dict.fromkeys(sequence))
        made.append(Notice(number, label, words, tuple(telling.split()), ceil(threshold * len(words) - 1e-9), ceil(1.25 * len(sequence))))
    return made


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _phrases(norm: Column, n_words: Column) -> dict[str, Column]:
    """Places of the phrases in ``norm``, words with a single space around each."""
    numbers, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        there = F.contains(norm, F.lit(f" {phrase} "))
        pieces = F.split(norm, f" {phrase}(?= )")
        numbers.append(F.when(there, F.size(pieces) - 1).otherwise(0))
        firsts.append(F.when(there, _spaces(F.element_at(pieces, 1))))
        lasts.append(F.when(there, n_words - (_spaces(F.element_at(pieces, -1)) - 1) - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    return {
        "n_base": sum(numbers[1:], numbers[0]).cast("long"), "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"), "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _side(spark: SparkSession, known: list[Notice], place: dict[str, int]) -> DataFrame:
    """One row per word of a template's prefix, with the template; its size is that of the templates."""
    cells = []
    for notice in known:
        ranked = sorted(notice.words, key=place.get)
        for at, word in enumerate(ranked[: len(ranked) - notice.need + 1]):
            cells.append(F.struct(
                F.lit(word).alias("word"), F.lit(at).alias("at"), F.lit(notice.number).alias("template"),
                F.lit(notice.label).alias("label"), F.lit(notice.need).alias("need"), F.lit(notice.span).alias("span"),
                _strings(notice.words).alias("parts"), _strings(notice.telling).alias("telling"),
                F.array(*[F.lit(place[w]) for w in ranked]).alias("ranks"),
            ))
    return spark.range(1).select(F.inline(F.array(*cells)))


def _confirmed(block: Column) -> Column:
    """(low, nth, high, shared) of the places in ``block``, (at, word), that are the notice's.

    ``nth`` is the first word's place in the notice, ``high`` is past the last word that the
    place adds to what is shared.
    """
    heads = F.expr("slice(parts, 1, size(parts) - need + 1)")
    begins = F.filter(block, lambda h: (h["at"] <= F.col("here")) & F.array_contains(heads, h["word"]))
    inside = F.transform(begins, lambda h: F.struct(
        h["at"].alias("low"), F.array_position("parts", h["word"]).alias("nth"),
        F.filter(block, lambda x: (x["at"] >= h["at"]) & (x["at"] < h["at"] + F.col("span")) & F.array_contains("parts", x["word"])).alias("held"),
    ))
    distinct = F.transform(inside, lambda p: F.struct(
        p["low"].alias("low"), p["nth"].alias("nth"), p["held"].alias("held"), F.array_distinct(p["held"]["word"]).alias("shared"),
    ))
    enough = F.filter(distinct, lambda p: (F.size(p["shared"]) >= F.col("need")) & (F.size(F.array_except("telling", p["shared"])) == 0))
    return F.transform(enough, lambda p: F.struct(
        p["low"].alias("low"), p["nth"].alias("nth"),
        (F.get(p["held"], F.array_position(p["held"]["word"], F.element_at(p["shared"], -1)).cast("int") - 1)["at"] + 1).alias("high"),
        F.size(p["shared"]).alias("shared"),
    ))


def _best(found: DataFrame, reach: int) -> DataFrame:
    """``found`` without the places that a better one of the same text overlaps.

    Places that overlap begin less than ``reach`` words apart, so they meet in cells of that many words.
    """
    cell = F.floor(F.col("low") / F.lit(reach))
    rank = lambda t: F.struct(F.col(f"{t}.shared"), F.col(f"{t}.containment"), -F.col(f"{t}.nth"), F.col(f"{t}.low") - F.col(f"{t}.high"), -F.col(f"{t}.template"), -F.col(f"{t}.low"))
    a = found.withColumn("_cell", cell).alias("a")
    b = found.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1))).alias("b")
    beaten = (
        (F.col("a._row") == F.col("b._row")) & (F.col("a._cell") == F.col("b._cell"))
        & (F.col("b.low") < F.col("a.high")) & (F.col("a.low") < F.col("b.high")) & (rank("b") > rank("a"))
    )
    return a.join(b, beaten, "left_anti").drop("_cell")


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): licenses it names.

    Words are runs of 0-9, a-z (A-Z lower-cased) and all beyond ASCII; a null text counts
    as empty. ``base`` are the labels of phrases found word by word, with their number,
    first and last place; ``blocks`` are the places that the templates confirm, as (start,
    end, label, containment), in words, the end exclusive; of places that overlap, the one
    that shares most words stays (ties: larger containment, a start nearer to the notice's, fewer
    words taken up, earlier template, earlier start). ``score`` is 1 with a phrase, else the
    best containment, else 0. Repeated rows and rows that share a doc_id are scanned each for
    itself, other columns are ignored, an empty table gives an empty result.

    Returns doc_id, n_words, n_base, first_word, last_word, base, blocks, score.
    """
    spark = docs.sparkSession
    known = notices(threshold, templates)
    vocabulary = sorted({w for n in known for w in n.words})
    reach = max(n.span for n in known)
    lowered = F.translate(
        F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    # a text that lacks a telling word or too many others of every template has no place of any
    possible = [
        F.forall(_strings(n.telling), lambda w: F.array_contains("_known", w)) & (F.size(F.array_intersect("_known", _strings(n.words))) >= n.need)
        for n in known
    ]
    hits = F.filter(
        F.transform(F.split("_trimmed", " "), lambda w, i: F.struct(i.alias("at"), w.alias("word"))),
        lambda h: F.array_contains("_known", h["word"]),
    )
    spaced = (
        numbered(docs.select("doc_id", "text"))
        .withColumn("_trimmed", F.trim(F.regexp_replace(lowered, f"[{BETWEEN}]+", " ")))
        .withColumn("_norm", F.concat(F.lit(" "), F.col("_trimmed"), F.lit(" ")))
        .withColumn("n_words", F.when(F.col("_trimmed") == "", 0).otherwise(_spaces(F.col("_norm")) - 1).cast("long"))
        .withColumn("_known", F.array_intersect(F.split("_trimmed", " "), _strings(vocabulary)))
    )
    rows = staged(
        spaced.select(
            "doc_id", "_row", "n_words", *[c.alias(n) for n, c in _phrases(F.col("_norm"), F.col("n_words")).items()],
            F.col("_known").alias("known"), F.when(reduce(or_, possible), hits).alias("hits"),
        ),
        "license-words",
    )
    held = rows.select(F.explode("known").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    seen = {r["word"]: r["n"] for r in held.collect()}  # at most the templates' words
    place = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    as_place = F.create_map(*[x for w, k in place.items() for x in (F.lit(w), F.lit(k))])

    # blocks: the words of the templates around each word that is in a template's prefix
    rare = {w for n in known for w in sorted(n.words, key=place.get)[: len(n.words) - n.need + 1]}
    spots = F.filter(
        F.transform("hits", lambda h, i: F.struct(i.alias("nth"), h["word"].alias("word"), h["at"].alias("here"))),
        lambda a: F.array_contains(_strings(sorted(rare)), a["word"]),
    )
    around = F.transform(spots, lambda a: F.struct(
        a["word"].alias("word"), a["here"].alias("here"),
        F.slice("hits", F.greatest(F.lit(1), a["nth"] - F.lit(reach - 2)), F.lit(2 * reach)).alias("near"),
    ))
    blocks = rows.where("hits is not null").select("_row", F.inline(around))
    met = (
        blocks.join(F.broadcast(_side(spark, known, place)), "word")
        .withColumn("block", F.filter("near", lambda h: F.abs(h["at"] - F.col("here")) < F.col("span")))
        .withColumn("ranked", F.array_sort(F.transform(F.array_distinct("block.word"), lambda w: F.element_at(as_place, w))))
        .withColumn("before", F.array_position("ranked", F.element_at(as_place, F.col("word"))) - 1)
        .where(F.least(F.size("ranked") - F.col("before"), F.size("ranks") - F.col("at")) >= F.col("need"))
        .where(F.size(F.array_intersect("ranked", "ranks")) >= F.col("need"))
    )
    found = (
        met.select("_row", "template", "label", F.size("parts").alias("size"), F.inline(_confirmed(F.col("block"))))
        .select("_row", "template", "label", "low", "nth", "high", "shared", (F.col("shared") / F.col("size")).alias("containment"))
        .distinct()
    )
    one = F.struct(F.col("low").alias("start"), F.col("high").alias("end"), "label", "containment")
    by_row = _best(staged(found, "license-places"), reach).groupBy("_row").agg(
        F.array_sort(F.collect_list(one)).alias("blocks"), F.max("containment").alias("best")
    )
    nothing = F.array().cast("array<struct<start:int,end:int,label:string,containment:double>>")
    return rows.drop("known", "hits").join(by_row, "_row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base", F.coalesce("blocks", nothing).alias("blocks"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
