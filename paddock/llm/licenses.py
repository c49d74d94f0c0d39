"""License scans: a positional rare-token index. DataFrame expressions only.

Templates are short passages of well-known licences. Their rarer words are the index: word -> (template, position in it).
Of each file all index words it holds are looked up, those with the highest IDF (over the files that may match) first; a place
where one of them has its position in a template is a candidate; a candidate counts if the template's mandatory key phrase
stands at its place. A key phrase holds a word of the index, so none is missed. Its score is the share of the template's words found in place.

Three fixed phrases give base labels wherever their words stand in a row. Files are A-Z lower-cased; words are runs without ASCII
controls, punctuation or white space. The scan is one pass without a shuffle, after one pass that counts files per
index word (as many rows as the index has words). Words are only taken apart in files with a word of GATES; no other file can match.

Null texts count as empty: no words, no labels, score 0. Repeated rows and null keys are scanned like any other.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed phrases of the base labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Fixed passages: label, words, mandatory key phrase. Each phrase is part of its passage and holds a word of the index.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "redistribution and use in source and binary forms"),
    ("cc-by", "this work is licensed under a creative commons attribution", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "licensed under cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial", "creative commons attribution noncommercial"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
     "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "permission to use copy modify and or distribute this software"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     "permission is hereby granted free of charge"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)
#: Fixed: template words that are common in prose, and so not part of the index.
COMMON = frozenset("a and any are as by can conditions copy file following for form forms free general in into is it its may not of or person public "
                   "purpose released source terms that the this to under use used v version with without work you 0 2 3 4".split())
#: Fixed: every key phrase, of templates and of the base labels, holds one of these.
GATES = ("licen", "redistribution", "attribution", "permission", "unencumbered")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
_ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def index_words(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, t, _ in templates for w in t.split()} - COMMON)


def _candidate(text: Column, gates=GATES) -> Column:
    """Whether a file may hold a key phrase: plain substring searches. lower() maps more than A-Z, which only lets more files in."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(g)) for g in gates])


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _strings(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs]) if xs else F.expr("cast(array() as array<string>)")


def file_counts(docs: DataFrame, words: list[str], text: str = "text") -> dict[str, int]:
    """Files per index word; at most one row per index word reaches the driver."""
    rows = docs.where(_candidate(F.col(text))).select(F.array_intersect(_words(F.col(text)), _strings(words)).alias("w"))
    return {r.w: r.n for r in rows.select(F.explode("w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def _places(words: Column, phrase: list[str]) -> Column:
    """Where the words of a phrase stand in a row: its last word is found first, as it is the rarest."""
    n = len(phrase)
    at = F.filter(F.transform(words, lambda w, i: F.when(w == phrase[-1], i)), lambda i: i.isNotNull() & (i >= n - 1))
    starts = F.transform(at, lambda i: i - (n - 1))
    return F.filter(starts, lambda i: F.slice(words, i + 1, F.lit(n)) == _strings(phrase))


def scan(docs: DataFrame, templates=TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every file."""
    vocabulary = index_words(templates)
    files = file_counts(docs, vocabulary, text)
    # Rarest first; words of no file are never looked up. Equal counts go by the word.
    ranked = sorted(files, key=lambda w: (files[w], w))
    postings = {w: [(t, i) for t, (_, x, _) in enumerate(templates) for i, y in enumerate(x.split()) if y == w] for w in ranked}
    body = F.array(*[_strings(x.split()) for _, x, _ in templates])
    keys = F.array(*[_strings(p.split()) for _, _, p in templates])
    offset = F.array(*[F.lit(x[: f" {x} ".index(f" {p} ")].count(" ")) for _, x, p in templates])
    label = _strings([x for x, _, _ in templates])
    none = F.expr("cast(array() as array<struct<t:int,at:int>>)")

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    words = F.when(_candidate(F.col("text")), _words(F.col("text")))
    rows = rows.select("doc_id", F.coalesce(F.regexp_count(F.col("text"), F.lit(_ANY_WORD)), F.lit(0)).cast("bigint").alias("n_words"),
                       F.coalesce(words, F.expr("cast(array() as array<string>)")).alias("words"))
    rows = rows.withColumn("rare", F.array_intersect(_strings(ranked), "words"))
    if ranked:
        index = F.create_map(*[c for w in ranked for c in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("at")) for t, i in postings[w]]))])
        # (word, position) of the looked-up words, then (template, place of its first word) for each posting.
        hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(F.col("rare"), x["w"]))
        rows = rows.withColumn("hits", F.when(F.size("rare") > 0, hits))
        aligned = F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(index, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["at"]).alias("at")))))
        rows = rows.withColumn("aligned", F.coalesce(aligned, none))
        firm = F.filter("aligned", lambda p: F.slice("words", F.greatest(p["at"] + F.get(offset, p["t"]), F.lit(0)) + 1, F.size(F.get(keys, p["t"]))) == F.get(keys, p["t"]))
        rows = rows.withColumn("places", F.array_distinct(F.filter(firm, lambda p: p["at"] + F.get(offset, p["t"]) >= 0)))
    else:
        rows = rows.withColumn("places", none)
    share = lambda p: F.aggregate(F.transform(F.get(body, p["t"]), lambda w, i: F.when(F.get("words", p["at"] + i) == w, 1.0).otherwise(0.0)),
                                  F.lit(0.0), lambda a, x: a + x) / F.size(F.get(body, p["t"]))
    rows = rows.withColumn("base", F.array(*[F.struct(F.lit(x).alias("label"), _places(F.col("words"), p.split()).alias("at")) for p, x in PHRASES]))
    found = F.filter("base", lambda s: F.size(s["at"]) > 0)
    starts = F.flatten(F.transform("base", lambda s: s["at"]))
    rows = rows.withColumn("starts", starts).withColumn("found", F.array_sort(F.array_distinct(F.transform(found, lambda s: s["label"]))))
    more = F.transform("places", lambda p: F.get(label, p["t"]))
    best = F.array_max(F.transform("places", share))
    return rows.select(
        "doc_id", "n_words", F.size("starts").cast("bigint").alias("n_base"), F.array_min("starts").cast("bigint").alias("first_word"),
        F.array_max("starts").cast("bigint").alias("last_word"), F.array_join("found", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("found", more)), ",").alias("labels"),
        F.round(F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("starts") > 0, 0.5).otherwise(0.0)), 6).alias("score"))
