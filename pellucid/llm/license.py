"""License scans in DataFrame functions only: MinHash bands over overlapping text windows, then exact containment.

Texts are lower-cased and cut at everything but letters and digits. Windows of ``WIDTH`` five-word shingles
(twelve words) begin at every ``STRIDE``-th shingle of a text. Of ``BANDS * ROWS`` permutations each gives a window's least shingle,
and ``ROWS`` of them are one band's key. Templates are indexed under the windows at all of their shingles.
Windows with shingles in common at a Jaccard similarity s meet with probability 1 - (1 - s ** ROWS) ** BANDS: 1 for
an equal window, over 0.99 with one shingle of eight changed (s = 7/9), 0.97 at s = 0.6, each window on its own. A text that
has ``WIDTH + STRIDE - 1`` shingles of a template in a row holds an equal window wherever they begin, so
that an unchanged notice is always met. Templates of fewer shingles cannot fill such a window; theirs are single
shingles, whose only band is the shingle itself, and any shingle in common is met.

For the documents and templates that met, all shingles of the whole text are compared exactly, and a document
matches at a containment of 0.8 of the template's different shingles. A notice is lost only where edits leave
no such run of it and every band of its remaining windows fails; what is reported is always exact.

Band keys and shingles come from one scan, and only those that a template has leave it; documents are never shuffled.

Nulls, ties, repeats: a null text, and one of fewer than five words, matches nothing. Rows of equal id and
text are one document; documents without id are reported with a null id. An empty table gives an
empty result, and templates of fewer than five words are an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, WIDTH, STRIDE, BANDS, ROWS, LEAST = 5, 8, 4, 8, 2, 0.8
#: Rows of the templates' index, of some 50 bytes, up to which it is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
CUT = r"[^\p{L}\p{N}]+"

#: Notices as their licenses give or suggest them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the “Software”), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), CUT), "")


def _template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def _shingles(window: Column, at: int) -> Column:
    return F.xxhash64(*[F.get(window, F.lit(at + i)) for i in range(SHINGLE)])


def _windows(words: Column, stride: int) -> Column:
    """Slices of WIDTH shingles' words; the last ones may be shorter. Null, not filtered, without shingles, so that texts are cut once."""
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    all_of = F.transform(F.sequence(F.lit(0), F.floor(last / stride).cast("int")), lambda i: F.slice(words, i * stride + 1, WIDTH + SHINGLE - 1))
    return F.when(F.size(words) >= SHINGLE, all_of)


def _hashes(window: Column) -> list[Column]:
    """A window's shingles; places beyond its end repeat the first."""
    first = _shingles(window, 0)
    return [first] + [F.when(F.size(window) >= SHINGLE + j, _shingles(window, j)).otherwise(first) for j in range(1, WIDTH)]


def _places() -> list[Column]:
    return [F.col(f"h{j}") for j in range(WIDTH)]


def _bands(bands: int) -> Column:
    least = [F.least(*[F.xxhash64(F.lit(k), h) for h in _places()]) for k in range(bands * ROWS)]
    return F.array(*[F.xxhash64(F.lit(b), *least[b * ROWS : (b + 1) * ROWS]) for b in range(bands)])


def _keyed(texts: DataFrame, ids: list[str], stride: int, bands: int) -> DataFrame:
    """ids, key: every band of every window of ``words``, and every shingle, some repeated.

    A window tells its first shingles up to the next window's.
    """
    cut = texts.select(*ids, F.explode(_windows(F.col("words"), stride)).alias("w"))
    hashed = cut.select(*ids, *[h.alias(f"h{j}") for j, h in enumerate(_hashes(F.col("w")))])
    return hashed.select(*ids, F.explode(F.concat(_bands(bands), F.array(*_places()[:stride]))).alias("key"))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def scan(docs: DataFrame, templates: dict[str, str] | None = None, bands: int = BANDS, least: float = LEAST) -> DataFrame:
    """doc_id, template_id, matched and total (different shingles), containment."""
    templates = TEMPLATES if templates is None else templates
    cut = {name: _template_words(text) for name, text in templates.items()}
    for name, w in cut.items():
        if len(w) < SHINGLE:
            raise ValueError(f"{name} has fewer than {SHINGLE} words")
    n = sum(map(len, cut.values()))
    short = {name: len(w) - SHINGLE + 1 < WIDTH + STRIDE - 1 for name, w in cut.items()}
    given = docs.sparkSession.createDataFrame([(k, w, short[k]) for k, w in cut.items()], "template_id string, words array<string>, short boolean")
    keys = _keyed(given, ["template_id", "short"], 1, bands).distinct()
    shingles = given.select("template_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - SHINGLE), lambda i: F.slice("words", i + 1, SHINGLE))).alias("w")).select("template_id", _shingles(F.col("w"), 0).alias("key")).distinct()
    total = shingles.groupBy("template_id").agg(F.count("*").alias("total"))
    # Of a short template no bands are indexed: its shingles are windows themselves.
    marked = keys.join(shingles.withColumn("shingle", F.lit(True)), ["template_id", "key"], "left")
    index = marked.filter("shingle or not short").select("template_id", "key", F.coalesce("shingle", F.lit(False)).alias("shingle"), (F.col("short") | F.col("shingle").isNull()).alias("meets"))

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), words(F.col("text")).alias("words"))
    row = ["doc_id", "th", "template_id"]
    shared = _keyed(base, row[:2], STRIDE, bands).join(_sized(index, n * (bands + 1)), "key").select(*row, "key", "shingle", "meets").distinct()
    exact = shared.groupBy(*row).agg(F.count_if("shingle").alias("matched"), F.max("meets").alias("met")).join(_sized(total, len(cut)), "template_id")
    found = exact.filter(F.col("met") & (F.col("matched") >= F.lit(least) * F.col("total")))
    return found.select("doc_id", "template_id", "matched", "total", F.round(F.col("matched") / F.col("total"), 6).alias("containment"))
