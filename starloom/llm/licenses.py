"""License scans: an exact set-similarity join of text lines with license notices, and the base phrases.

A notice is the set of words of a template, and a line matches when it holds at least THRESHOLD of them. Words
are ordered by how many lines of the corpus have them, rarest first. A matching line shares a word with the
template's prefix (its first n - need + 1 words), has ``need`` words at least, and from the place of the first
shared word both sides have enough words left. What passes is verified by the size of the intersection.

Notices are wrapped over lines as well, so windows of consecutive words match too, whatever stands between the words.
A window is as long as the template and a share of 1 - THRESHOLD more, and only texts that hold enough of a template's
words anywhere are searched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from starloom.llm.common import ALNUM_WORD_ANY_CASE, BETWEEN_ALNUM, count_words
from starloom.session import materialise

#: Fixed values of the contract: phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The words of common public notices (label, wording).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.9
#: The hint under which the short side is sent to all tasks; a longer template list is joined by shuffle.
BROADCAST_TEMPLATES = 10_000


def template_sets(spark, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    rows = spark.createDataFrame([(i, label, sorted(set(words.split()))) for i, (label, words) in enumerate(templates)], "t int, label string, words array<string>")
    return rows.withColumn("need", F.ceil(F.size("words") * threshold).cast("int"))


def _lowered(text: Column) -> Column:
    """Lower-cased text, for looking up ASCII words in. The Kelvin sign, the only other character whose lower case is an
    ASCII letter alone, is put aside first; so the ASCII words are those of lower-casing A-Z only."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u20ac")))


def _lines(rows: DataFrame) -> DataFrame:
    """Lines as ``id, h, line, words``."""
    lines = rows.select("id", "h", F.posexplode(F.split(_lowered(F.col("text")), "\n")).alias("line", "said"))
    return lines.select("id", "h", "line", F.split("said", BETWEEN_ALNUM).alias("words"))


def matching_lines(rows: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``id, h, line, label, containment`` of every line and template at or above the threshold; ``rows`` has ``id, h, text``."""
    sets = template_sets(rows.sparkSession, templates, threshold)
    vocabulary = sorted({w for _, words in templates for w in words.split()})

    def among(words: list[str]) -> DataFrame:
        """Lines with those of ``words`` that they hold, in the order given; exploding a single value has it computed once."""
        held = F.array_intersect(F.array(*[F.lit(w) for w in words]), F.col("words"))
        return _lines(rows).select("id", "h", "line", F.explode(F.array(held)).alias("held"))

    # Only lines with as many of the templates' words as the least need can match any.
    floor = min(-(-len(set(w.split())) * threshold // 1) for _, w in templates)
    counted = among(vocabulary).select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    terms = sets.select("t", "label", "need", F.size("words").alias("size"), F.explode("words").alias("w"))
    ranked = materialise(terms.join(counted, F.col("w") == F.col("word"), "left").select("t", "label", "need", "size", "w", F.coalesce("n", F.lit(0)).alias("n")))
    ordered = ranked.groupBy("t", "label", "need", "size").agg(F.array_sort(F.collect_list(F.struct("n", "w")))["w"].alias("ordered"))
    prefix = materialise(
        ordered.select("t", "label", "need", "size", "ordered", F.posexplode(F.slice("ordered", F.lit(1), F.col("size") - F.col("need") + 1)).alias("at", "token"))
    )
    order = [r.w for r in ranked.select("n", "w").distinct().orderBy("n", "w").collect()]  # the templates' words alone
    held = among(order).where(F.size("held") >= int(floor)).withColumnRenamed("held", "sorted")
    tokens = held.select("id", "h", "line", "sorted", F.posexplode("sorted").alias("place", "word"))
    met = tokens.join(F.broadcast(prefix) if len(templates) <= BROADCAST_TEMPLATES else prefix, F.col("word") == F.col("token"))
    enough = (F.size("sorted") >= F.col("need")) & (F.size("sorted") - F.col("place") >= F.col("need") - F.col("at")) & (F.col("size") - F.col("at") >= F.col("need") - F.col("place"))
    shared = F.size(F.array_intersect("sorted", "ordered"))
    found = met.where(enough).withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
    return found.select("id", "h", "line", "label", (F.col("shared") / F.col("size")).alias("containment")).distinct()


def matching_windows(rows: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``id, h, label, containment`` of the best window of every text of several lines and template at or above the threshold."""
    vocabulary = sorted({w for _, words in templates for w in words.split()})
    sets = []
    for label, words in templates:
        own = sorted(set(words.split()))
        need, span = math.ceil(len(own) * threshold), math.ceil(len(words.split()) / threshold)
        sets.append(F.struct(F.lit(label).alias("label"), F.array(*[F.lit(w) for w in own]).alias("own"), F.lit(need).alias("need"), F.lit(span).alias("span")))
    floor = min((math.ceil(len(set(w.split())) * threshold) for _, w in templates), default=0)
    words = F.filter(F.split(_lowered(F.col("text")), BETWEEN_ALNUM), lambda w: w != "")
    texts = rows.where(F.contains(F.col("text"), F.lit("\n"))).select("id", "h", F.explode(F.array(words)).alias("words"))
    held = texts.select("id", "h", "words", F.explode(F.array(F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), F.col("words")))).alias("held"))
    likely = F.filter(F.array(*sets), lambda t: F.size(F.array_intersect(t["own"], F.col("held"))) >= t["need"])
    met = held.where(F.size("held") >= floor).select("id", "h", "words", F.explode(likely).alias("t"))
    starts = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_contains(F.col("t.own"), F.element_at("words", i)))
    shared = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("words", i, F.col("t.span")), F.col("t.own")))))
    found = met.select("id", "h", "t", F.explode(F.array(shared)).alias("shared")).where(F.col("shared") >= F.col("t.need"))
    return found.select("id", "h", F.col("t.label").alias("label"), (F.col("shared") / F.size("t.own")).alias("containment"))


def phrase_places(text: Column, phrase: str) -> tuple[Column, Column, Column]:
    """How often a phrase stands in the text's words, and the first and last word at which it starts (null if nowhere).

    Every word is set between two spaces, so that neighbouring places do not share one.
    """
    needle = "".join(f" {w} " for w in phrase.split())
    count = (F.length(text) - F.length(F.replace(text, F.lit(needle)))) / len(needle)
    first = F.locate(needle, text)
    tail = F.substring_index(text, needle, -1)
    words = lambda s: (F.length(s) - F.length(F.replace(s, F.lit(" ")))) / 2
    before_last = words(text) - words(tail) - len(phrase.split())
    return count.cast("bigint"), F.when(first > 0, words(F.substring(text, F.lit(1), first - 1))).cast("bigint"), F.when(first > 0, before_last).cast("bigint")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """All rows as ``id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    The score is 1 where a base phrase stands, else the highest containment of a matching line or window, 0 without any. A null or empty text
    has no words and no labels; repeated rows each get their result; an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    met = matching_lines(rows, templates, threshold).select("id", "h", "label", "containment").unionAll(matching_windows(rows, templates, threshold))
    matched = met.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("containment")
    )
    base = rows.select("id", "h", count_words(F.col("text"), ALNUM_WORD_ANY_CASE).alias("n_words"), F.explode(F.array(_lowered(F.col("text")))).alias("lowered"))
    may = F.lit(False)
    for phrase in PHRASES:
        may = may | F.contains(F.col("lowered"), F.lit(phrase.split()[0])) & F.contains(F.col("lowered"), F.lit(phrase.split()[-1]))
    words = F.filter(F.split("lowered", BETWEEN_ALNUM), lambda w: w != "")
    spaced = F.when(may, F.concat_ws("", F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))))).otherwise(F.lit(""))
    base = base.select("id", "h", "n_words", F.explode(F.array(spaced)).alias("spaced"))
    places = {label: phrase_places(F.col("spaced"), phrase) for phrase, label in PHRASES.items()}
    base = base.select(
        "id", "h", "n_words",
        sum((n for n, _, _ in places.values()), F.lit(0)).cast("bigint").alias("n_base"),
        F.least(*[a for _, a, _ in places.values()]).alias("first_word"),
        F.greatest(*[b for _, _, b in places.values()]).alias("last_word"),
        F.filter(F.array(*[F.when(n > 0, F.lit(label)) for label, (n, _, _) in places.items()]), lambda x: x.isNotNull()).alias("base"),
    )
    joined = base.join(matched, F.col("id").eqNullSafe(F.col("_id")) & F.col("h").eqNullSafe(F.col("_h")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
