"""License scan: which license statements a document holds.

Texts and templates become overlapping windows of a few word shingles, and MinHash bands of a window are
its keys. A template is looked up by the windows of its size class:

=======  ==========  ======  =======  ===========================================
class    shingles    window  stride   a text holding 75 % of the template has an
                                      intact run of at least window + stride - 1
=======  ==========  ======  =======  ===========================================
0        1 to 3      1       1        1
1        4 to 7      2       2        3
2        8 and more  4       2        5
=======  ==========  ======  =======  ===========================================

An edited word breaks up to five neighbouring shingles. So what is left of a template of n shingles at
75 % lies in at most 0.05 n + 1 runs, the longest of which reaches the length in the table. A window inside
it equals a window of the template, and equal windows share all their bands: such a template is retrieved
with certainty, and partly equal windows still meet in some band. Matches are then verified by exact
shingle containment.

Defined cases: case and punctuation are ignored; a NULL or empty text matches nothing; a template of three
or four words is one shingle of its own length, found anywhere in a text; shorter templates are refused.
Repeated document rows share one result. Other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.containment import contained, row_key
from pixelloom.llm.store import small, written
from pixelloom.llm.text import SHINGLE, let, words

THRESHOLD = 0.75

#: Statements and notices as their publishers word them.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("mit", "Released under the MIT License."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                   "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                   "Public License as published by the Free Software Foundation"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                   "the following conditions are met"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

#: (least shingles, most shingles, window, stride) of each size class.
CLASSES = ((1, 3, 1, 1), (4, 7, 2, 2), (8, 1 << 30, 4, 2))
BANDS = 2


def license_words(text: Column) -> Column:
    return words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""))


def _windows(word: Column, k: int, piece) -> Column:
    n = F.size(word)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: piece([word[i + j] for j in range(k)])))


def hashes(word: Column, k: int) -> Column:
    """Hashes of the k-word shingles in order; none for fewer words."""
    return F.coalesce(_windows(word, k, lambda w: F.xxhash64(F.lit(k), *w)), F.array().cast("array<bigint>"))


def band_keys(h: Column, size_class: int, stride: int) -> Column:
    """The band keys of all windows of a hash array: per window and band, the minimum under that band's permutation."""
    _, _, width, _ = CLASSES[size_class]
    bands = 1 if width == 1 else BANDS

    def key(i: Column, band: int) -> Column:
        values = [h[i + j] if band == 0 else F.xxhash64(h[i + j], F.lit(band)) for j in range(width)]
        return F.xxhash64(F.lit(size_class * 16 + band), values[0] if width == 1 else F.least(*values))

    starts = F.sequence(F.lit(0), F.size(h) - width, F.lit(stride))
    def of_band(band: int) -> Column:
        return F.transform(starts, lambda i: key(i, band))

    per_band = [of_band(b) for b in range(bands)]
    return F.when(F.size(h) >= width, F.array_distinct(F.concat(*per_band))).otherwise(F.array().cast("array<bigint>"))


def _keys(word: Column, k: int, strides: dict[int, int]) -> Column:
    """Band keys of the k-word shingles for the size classes in ``strides``."""
    return let(hashes(word, k), lambda h: F.concat(*[band_keys(h, c, s) for c, s in strides.items()]))


def shingles(word: Column, lengths: tuple[int, ...]) -> Column:
    """The distinct shingles of all ``lengths`` as strings."""
    parts = [F.coalesce(_windows(word, k, lambda w, k=k: F.concat_ws(" ", F.lit(str(k)), *w)), F.array().cast("array<string>")) for k in lengths]
    return F.array_distinct(F.concat(*parts))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, text string")


def license_matches(docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD, k: int = SHINGLE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (document, license): id, license, n_shingles, n_shared, containment (and ``key`` of the row).

    ``templates`` has (license, text); it may be a table of any size.
    """
    templates = default_templates(docs.sparkSession) if templates is None else templates
    cut = templates.select("license", license_words(F.col("text")).alias("w")).where(F.size("w") >= 3).withColumn(
        "k", F.least(F.lit(k), F.size("w")))
    cut = written(cut, "templates")
    lengths = tuple(sorted(r[0] for r in cut.select("k").distinct().collect()))  # at most 3 values
    if not lengths:
        raise ValueError("templates need at least three words")
    parts = [cut.where(F.col("k") == n).select("license", F.explode(shingles(F.col("w"), (n,))).alias("shingle")) for n in lengths]
    strings = parts[0]
    for p in parts[1:]:
        strings = strings.unionByName(p)
    counts = strings.groupBy("license").agg(F.count(F.lit(1)).cast("int").alias("n_shingles"))
    strings = written(strings.join(counts, "license").withColumnRenamed("license", "item"), "template-shingles")

    keys = []
    sized = cut.join(counts, "license")
    for n in lengths:
        for c, (least, most, _, _) in enumerate(CLASSES):
            mine = sized.where((F.col("k") == n) & F.col("n_shingles").between(least, most))
            keys.append(mine.select("license", F.explode(_keys(F.col("w"), n, {c: 1})).alias("key_hash"),
                                    F.lit(n).alias("k"), F.lit(c).alias("c")))
    probes = keys[0]
    for p in keys[1:]:
        probes = probes.unionByName(p)
    probes = written(probes.distinct(), "template-bands")
    used = sorted((r[0], r[1]) for r in probes.select("k", "c").distinct().collect())  # at most 3 x 3 values

    def text_keys(text: Column) -> Column:
        def of(word: Column) -> Column:
            return F.concat(*[_keys(word, n, {c: CLASSES[c][3] for m, c in used if m == n}) for n in lengths])
        return let(license_words(text), of)

    texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.select("key", F.explode(text_keys(F.col("text"))).alias("key_hash"))
    pairs = written(rows.join(small(probes.select("license", "key_hash").distinct()), "key_hash").select(
        "key", F.col("license").alias("item")).distinct(), "license-candidates")
    met = contained(texts, pairs, strings, let(license_words(F.col("text")), lambda w: shingles(w, lengths)), math.nextafter(threshold, 0))
    return met.select(
        F.col("key"), F.col("id").alias(id_col), F.col("item").alias("license"), F.col("n_shingles").cast("long").alias("n_shingles"), "n_shared",
        (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
