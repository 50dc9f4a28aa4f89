"""License scans by an exact set-similarity join of text blocks with license templates, with built-in expressions only.

A block is a line, or a run of words that may cross line ends; a template is a notice; both are sets of words. A run has as many
words as the template's text, so that a wrapped notice fits in (comment marks are no words) and few others do. A block meets a template when it holds at least ``threshold`` of the
template's words. Words are ordered by their frequency in all blocks, rarest first. A template of n words that needs c of them can
miss n - c, so one of its first n - c + 1 words is in every block that meets it (prefix filter); that block has c of the words
(length filter), and behind the first common word there is room for the others on both sides (positional filter). What passes is verified.
Words that no template holds never count towards an overlap, so blocks are kept as their template words. A share alone forgives the word that tells one
license from its sister, so a template also names words that must be there, and words of sister licenses that must not. Runs are looked at around each place of a
prefix word only, with the same filters.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.plans.stage import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices as their licenses word them: label, text, the words that a block must hold whatever its share (what names the license, or its rarest
# word), and the words of sister licenses that it must not hold.
TEMPLATES = (
    ("mit", "Released under the MIT License.", "mit", ""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission charge", ""),
    ("apache", "Licensed under the Apache License, Version 2.0", "apache", ""),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at", "compliance", ""),
    ("bsd", "Released under the BSD License.", "bsd", ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
     "redistribution", ""),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gnu", ""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu", ""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla", ""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission fee", ""),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered", ""),
    ("cc-by", "Licensed under CC BY 4.0.", "cc by", "nc nd sa"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc by sa", "nc nd"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc", "nd sa"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "waived", ""),
)
# Templates of one pass over the blocks: they and their words travel in plans and broadcasts. More templates take more passes.
TEMPLATES_AT_ONCE = 500
# Places of a text that are looked at together; with those around them they bound what a row becomes.
CHUNK = 1_000


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATOR, text.translate(str.maketrans(UPPER, LOWER))) if w]


class Template(NamedTuple):
    label: str
    words: list[str]
    required: list[str]
    excluded: list[str]
    length: int


def prepared(templates: tuple[tuple[str, ...], ...]) -> list[Template]:
    """Templates (label, text[, required words[, excluded words]]) as sets of words; ``length`` counts repeated ones. A template without words meets nothing and goes."""
    found = []
    for label, text, *rest in templates:
        required, excluded = [sorted(set(plain_words(x))) for x in [*rest, "", ""][:2]]
        own = plain_words(text)
        if own:
            found.append(Template(label, sorted(set(own)), required, excluded, len(own)))
    return found


def need(template: Template, threshold: float) -> int:
    return math.ceil(round(threshold * len(template.words), 9))


def parse(df: DataFrame, universe: list[str], phrases: dict[str, str], key: str, text: str) -> DataFrame:
    """(key, row, n_words, found, blocks, places): one row per document; ``found`` has (label, n, first, last) of each phrase that stands
    in it, ``blocks`` the distinct template words of each line that holds any, ``places`` every template word with its place."""
    lines = df.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("row"),
                      F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "\n", -1).alias("lines"))
    words = lines.select("key", "row", F.transform("lines", lambda x: F.filter(F.split(x, SEPARATOR, -1), lambda w: w != "")).alias("lines"))
    # A dot before the first word, so that no phrase stands at the very start: a split there would not show.
    flat = words.select("key", "row", "lines", F.flatten("lines").alias("words")).select(
        "key", "row", "lines", "words", F.size("words").alias("n_words"), F.concat(F.lit(". "), F.array_join("words", " "), F.lit(" ")).alias("line"))
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    found = []
    for phrase, label in phrases.items():
        parts = F.split("line", f"(?= {phrase} )", -1)
        found.append(F.when(F.contains("line", F.lit(f" {phrase} ")), F.struct(
            F.lit(label).alias("label"), (F.size(parts) - 1).alias("n"), spaces(F.get(parts, F.lit(0))).alias("first"),
            (F.col("n_words") - spaces(F.element_at(parts, -1)) + 1).alias("last"))))
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: x["word"].isin(universe))
    own = F.filter(F.transform("lines", lambda b: F.array_distinct(F.filter(b, lambda w: w.isin(universe)))), lambda b: F.size(b) > 0)
    return flat.select("key", "row", F.col("n_words").cast("long"), F.array_compact(F.array(*found)).alias("found"), own.alias("blocks"), places.alias("places"))


def word_ranks(parsed: DataFrame, universe: list[str]) -> dict[str, int]:
    """Template words by their number of blocks in the whole corpus, rarest first. As many rows as template words reach the driver."""
    counted = parsed.select(F.explode(F.flatten("blocks")).alias("word")).groupBy("word").count()
    counts = {row["word"]: row["count"] for row in counted.collect()}
    return {word: rank for rank, word in enumerate(sorted(universe, key=lambda w: (counts.get(w, 0), w)))}


def _apt(held: Column, required: Column, excluded: Column, around: Column | None = None) -> Column:
    """Whether a block holds all required words, and neither it nor what stands ``around`` it any excluded one."""
    return (F.size(F.array_intersect(held, required)) == F.size(required)) & ~F.arrays_overlap(held if around is None else around, excluded)


FIELDS = "label string, words array<string>, required array<string>, excluded array<string>, need int, length int"


def _prefixes(spark: SparkSession, sets: list[Template], ranks: dict[str, int], threshold: float) -> DataFrame:
    """(first, at, *fields): the prefix of every template, its place in it, and the template. Bounded by TEMPLATES_AT_ONCE."""
    entries = []
    for t in sets:
        order, c = sorted(t.words, key=ranks.get), need(t, threshold)
        entries += [(word, at, t.label, order, t.required, t.excluded, c, t.length) for at, word in enumerate(order[:len(order) - c + 1])]
    return spark.createDataFrame(entries, "first string, at int, " + FIELDS)


def containment_join(spark: SparkSession, parsed: DataFrame, sets: list[Template], ranks: dict[str, int], threshold: float) -> DataFrame:
    """(key, row, label, share): every template that a block of the document meets, and the share of its words."""
    least = min(need(t, threshold) for t in sets)
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    ranked = F.array_sort(F.transform("block", lambda w: F.struct(F.element_at(table, w).alias("rank"), w.alias("word"))))
    blocks = (parsed.select("key", "row", F.explode(F.filter("blocks", lambda b: F.size(b) >= least)).alias("block"))
              .select("key", "row", F.transform(ranked, lambda x: x["word"]).alias("block")))
    size = F.size("block")
    tokens = blocks.select("key", "row", "block", F.posexplode(F.slice("block", 1, size - least + 1)).alias("place", "first"))
    met = tokens.join(F.broadcast(_prefixes(spark, sets, ranks, threshold)), "first").where(
        (size >= F.col("need")) & (F.least(size - F.col("place"), F.size("words") - F.col("at")) >= F.col("need")))
    shared = F.size(F.array_intersect("block", "words"))
    right = (shared >= F.col("need")) & _apt(F.col("block"), F.col("required"), F.col("excluded"))
    return met.where(right).select("key", "row", "label", (shared / F.size("words")).alias("share"))


def run_join(spark: SparkSession, parsed: DataFrame, sets: list[Template], ranks: dict[str, int], threshold: float) -> DataFrame:
    """(key, row, label, share): every template that a run of the document's words meets, and the largest share of its words around a place.

    Runs start at a word of the template; excluded words may not stand right beside a run either.
    """
    prefixes = _prefixes(spark, sets, ranks, threshold)
    first = sorted({r["first"] for r in prefixes.select("first").collect()})  # words of the templates
    longest, least = max(t.length for t in sets), min(need(t, threshold) for t in sets)
    # Chunks of places with those around them: a row becomes so many rows before anything is built around each place.
    chunk = lambda c: F.struct(F.least(c * CHUNK, F.lit(longest)).alias("lead"), F.slice(
        "places", F.greatest(c * CHUNK - longest, F.lit(0)) + 1, F.least(c * CHUNK, F.lit(longest)) + CHUNK + longest).alias("part"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("places") - 1) / CHUNK).cast("int")), chunk)
    parts = parsed.where(F.size("places") >= least).select("key", "row", F.explode(chunks).alias("x")).select("key", "row", "x.*")
    place = lambda i: F.get("part", i)
    own = F.filter(F.sequence(F.col("lead"), F.least(F.col("lead") + CHUNK, F.size("part")) - 1), lambda i: place(i)["word"].isin(first))
    near = F.transform(own, lambda i: F.struct(place(i)["at"].alias("place"), place(i)["word"].alias("first"), F.filter(
        F.slice("part", F.greatest(i - longest + 1, F.lit(1)), F.lit(2 * longest + 1)), lambda x: F.abs(x["at"] - place(i)["at"]) <= longest).alias("near")))
    around = parts.select("key", "row", F.explode(near).alias("x")).select("key", "row", "x.*").where(F.size("near") >= least)
    met = around.join(F.broadcast(prefixes), "first")
    words_in = lambda low, high: F.transform(F.filter("near", lambda x: (x["at"] >= low) & (x["at"] < high)), lambda x: x["word"])
    span, at = F.col("length"), F.col("place")
    held = words_in(at - span + 1, at + span)
    met = met.where((F.size(F.array_intersect(held, "words")) >= F.col("need")) & (F.size(F.array_intersect(held, "required")) == F.size("required")))
    starts = F.filter("near", lambda x: (x["at"] > at - span) & (x["at"] <= at) & F.array_contains("words", x["word"]))
    run = lambda s: F.when(
        _apt(words_in(s["at"], s["at"] + span), F.col("required"), F.col("excluded"), words_in(s["at"] - 1, s["at"] + span + 1)),
        F.size(F.array_intersect(words_in(s["at"], s["at"] + span), "words"))).otherwise(0)
    return met.withColumn("shared", F.array_max(F.transform(starts, run))).where("shared >= need").select(
        "key", "row", "label", (F.col("shared") / F.size("words")).alias("share"))


def scan_licenses(df: DataFrame, phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, ...], ...] = TEMPLATES,
                  threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    n_base counts all places of the phrases, first_word and last_word are their smallest and largest start (words from 0, else null).
    ``labels`` adds those of the templates that some line or run of words meets (``threshold`` of its words, all required and no excluded ones); ``score`` is 1 with a phrase, else the largest share met, else 0. Labels are
    distinct, sorted and comma-joined. Null and empty texts have no words, an empty result string and score 0. Repeated rows are judged
    alike; further columns play no part.
    """
    every = prepared(templates)
    groups = [every[i:i + TEMPLATES_AT_ONCE] for i in range(0, len(every), TEMPLATES_AT_ONCE)] or [[]]
    spark, found, met = df.sparkSession, F.col("found"), None
    for sets in groups:
        universe = sorted({w for t in sets for w in (*t.words, *t.required, *t.excluded)})
        parsed = stage(parse(df, universe, phrases, key, text))
        if sets:
            ranks = word_ranks(parsed, universe)
            for part in (containment_join(spark, parsed, sets, ranks, threshold), run_join(spark, parsed, sets, ranks, threshold)):
                met = part if met is None else met.unionByName(part)
    base = parsed.select(
        "key", "row", "n_words", F.aggregate(found, F.lit(0), lambda n, x: n + x["n"]).cast("long").alias("n_base"),
        F.array_min(F.transform(found, lambda x: x["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(found, lambda x: x["last"])).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))).alias("base"))
    if met is not None:
        best = met.groupBy("key", "row").agg(F.collect_set("label").alias("met"), F.max("share").alias("share"))
    else:
        best = spark.createDataFrame([], "key long, row long, met array<string>, share double")
    best = best.withColumnsRenamed({"key": "k", "row": "r"})
    joined = base.join(best, (F.col("row") == F.col("r")) & F.col("key").eqNullSafe(F.col("k")), "left")
    both = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("met", F.array().cast("array<string>")))))
    return joined.select(F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
                         F.array_join(both, ",").alias("labels"),
                         F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
