"""License scans by diagonal voting, in DataFrame operations only.

Every rolling k-gram of a text's words is hashed and joined with the k-grams of the templates.
A hit at word p of the text and word t of the template is compared word for word, since hashes
may collide, and votes for the diagonal p - t, on which an unchanged copy puts all its votes.
Votes are summed by text, template and diagonal as bit sets of the template's k-grams;
neighbouring diagonals, which an inserted or dropped word makes of one, are merged into a span.
A span is verified by the share of the template's k-grams that stand in it word for word, each
counted once, and by its length: it may not be longer than what its template would fill.

Templates are phrases or whole licenses of any length.  They are a fixed list, so their k-grams
are broadcast and texts are never shuffled: only texts' few hits and counts are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import WHOLE

#: Phrases whose every place is reported, with their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Openings of public licenses and usual notices of them (fixed values), by label.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    *WHOLE,
]

GRAM = 3
#: Share of a template's k-grams that a find has at least.
COVERAGE = 0.6
#: Diagonals that are at most so far apart are one find.
DRIFT = 2
#: Words of a span for each word of its template at most.
STRETCH = 2
#: k-grams of a template that one bit set holds; longer templates have several.
_BITS = 63

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> Column:
    """Words of a text: runs of lower-cased letters, digits and non-ASCII characters."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def template_words(text: str) -> list[str]:
    """A template's words, as those of texts."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _LOWER)))


def _template_grams(spark: SparkSession, templates, gram: int) -> DataFrame:
    """(gram hash, template, label, is it a base phrase, offset, k-grams and words of the template,
    words of the k-gram)."""
    rows = []
    listed = [(label, phrase, True) for phrase, label in BASE.items()] + [(a, b, False) for a, b in templates]
    for number, (label, phrase, base) in enumerate(listed):
        words = template_words(phrase)
        if len(words) < 2:
            raise ValueError(f"a template needs two words or more: {phrase!r}")
        size = min(gram, len(words))
        total = len(words) - size + 1
        rows += [(number, label, base, t, total, len(words), words[t : t + size]) for t in range(total)]
    schema = "template int, label string, base boolean, offset int, grams int, length int, wanted array<string>"
    table = spark.createDataFrame(rows, schema)
    hashed = F.lit(None).cast("long")
    for size in range(2, gram + 1):
        hashed = F.when(F.size("wanted") == size, F.xxhash64(*(F.col("wanted")[j] for j in range(size)))).otherwise(hashed)
    return table.withColumn("gram", hashed)


def find_licenses(docs: DataFrame, templates=TEMPLATES, gram: int = GRAM, coverage: float = COVERAGE, drift: int = DRIFT) -> DataFrame:
    """Every find of a base phrase or template.

    Takes ``doc_id`` and ``text``.  ``templates``: (label, text) pairs, of two words or more each.
    Returns ``doc_id, row_key`` (a hash of id and text, which tells rows of one id apart),
    ``label, base, start, end`` (words, from 0, end exclusive) and ``covered`` (1 for base
    phrases).  Rows repeated whole are one; null and empty texts have no finds.
    """
    if gram < 2:
        raise ValueError("k-grams have two words or more")
    grams = _template_grams(docs.sparkSession, templates, gram)
    # phrases with fewer words than a k-gram are looked up by hashes of their own
    short = {n: sorted({r["gram"] for r in grams.where(F.size("wanted") == n).select("gram").collect()}) for n in range(2, gram)}
    words = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), _words("text").alias("words")).where(F.size("words") > 1)

    def at(i):
        own = [F.get("words", i + j) for j in range(gram)]
        return F.struct(*(F.xxhash64(*own[:n]).alias(f"h{n}") for n in range(2, gram + 1)), *(w.alias(f"w{j}") for j, w in enumerate(own)))

    rolling = F.transform(F.sequence(F.lit(0), F.size("words") - 2), at)
    places = words.select("doc_id", "row_key", F.posexplode(rolling).alias("place", "at"))
    hashes = F.array(F.col(f"at.h{gram}"))
    for n, known in short.items():
        hashes = F.when(F.col(f"at.h{n}").isin(known), F.concat(hashes, F.array(f"at.h{n}"))).otherwise(hashes) if known else hashes
    hashed = places.select("doc_id", "row_key", "place", F.explode(hashes).alias("gram"), *(F.col(f"at.w{j}").alias(f"w{j}") for j in range(gram)))
    same = F.col("w0") == F.col("wanted")[0]
    for j in range(1, gram):
        same &= (F.size("wanted") <= j) | (F.col(f"w{j}") == F.get("wanted", F.lit(j)))
    diagonal = ["doc_id", "row_key", "template", "label", "base", "grams", "length"]
    votes = (
        # the templates are a fixed list of a few hundred or thousand k-grams
        hashed.join(F.broadcast(grams), "gram")
        .where(same)
        .groupBy(*diagonal, (F.col("place") - F.col("offset")).alias("diagonal"), F.expr(f"offset DIV {_BITS}").alias("word"))
        .agg(
            F.bit_or(F.expr(f"shiftleft(1L, offset % {_BITS})")).alias("hits"),
            F.min("place").alias("first"), F.max(F.col("place") + F.size("wanted")).alias("last"),
        )
    )
    in_order = "PARTITION BY doc_id, row_key, template ORDER BY diagonal, word"
    runs = votes.withColumn("breaks", F.expr(f"base OR coalesce(diagonal - lag(diagonal) OVER ({in_order}) > {drift}, true)"))
    return (
        runs.withColumn("run", F.expr(f"sum(int(breaks)) OVER ({in_order})"))
        .groupBy(*diagonal, "run", "word")
        .agg(F.bit_or("hits").alias("hits"), F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy(*diagonal, "run")
        .agg(F.sum(F.bit_count("hits")).alias("hits"), F.min("first").cast("long").alias("start"), F.max("last").cast("long").alias("end"))
        .withColumn("covered", F.col("hits") / F.col("grams"))
        .where(F.when(F.col("base"), F.col("covered") == 1).otherwise((F.col("covered") >= coverage) & (F.col("end") - F.col("start") <= STRETCH * F.col("length"))))
        .select("doc_id", "row_key", "label", "base", "start", "end", "covered")
    )


def scan_licenses(docs: DataFrame, **options) -> DataFrame:
    """License labels of every text.

    Takes ``doc_id`` and ``text``; other columns are ignored.  Returns a row per input row:
    ``doc_id, n_words, n_base`` (places of base phrases), ``first_word, last_word`` (their
    least and greatest start, null without any), ``base_labels, labels`` (distinct, sorted
    and comma-joined; empty if none) and ``score`` (the largest share of a template that a
    find covers, 1 for a base phrase, 0 without finds).  Texts are read whole.  A null text has
    no words; a null doc_id stays null; rows repeated whole get the same values each; an empty
    table gives an empty one.
    """
    base_start = F.when(F.col("base"), F.col("start"))
    finds = (
        find_licenses(docs, **options)
        .groupBy("doc_id", "row_key")
        .agg(
            F.count(base_start).alias("n_base"),
            F.min(base_start).alias("first_word"),
            F.max(base_start).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("covered").alias("score"),
        )
    )
    counts = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.size(_words("text")).cast("long").alias("n_words")
    )
    same = counts["row_key"].eqNullSafe(finds["row_key"]) & counts["doc_id"].eqNullSafe(finds["doc_id"])
    return counts.join(finds, same, "left").select(
        counts["doc_id"], "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
