"""License notices in texts, by MinHash over overlapping windows and exact containment; DataFrame functions only.

A text's words (letters and digits, lower case) give five-word shingles, hashed to longs. Windows of ``WINDOW`` shingles
start every ``STEP``. A window has ``BANDS`` bands of one MinHash each (the smallest value of the shingles hashed
anew with the band's number); it retrieves the templates that hold a window with the same value in a band. With one row per band, a
window that shares a share J of the joint shingles is missed with probability ``(1 - J) ** BANDS``: a one-shingle template
in a window of 8 (J = 1/8) with 0.02 %, J = 1/4 with 1e-8. What is retrieved is verified: the share of a template's
shingles that occur around the window. A collision needs a common shingle, so windows without any template shingle are
passed over before their bands are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
WINDOW = 8
STEP = 4
BANDS = 64
CONTAINMENT = 0.8
# Templates whose bands may be broadcast; a longer list is joined by shuffle.
BROADCAST = 5_000

# Notices as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License.",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles in order; empty for null and for fewer than five words."""
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    hashed = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(ws, i, SHINGLE)))
    # the words are computed once, as the only element of an outer array
    return F.flatten(F.transform(F.array(words), lambda ws: F.when(F.size(ws) >= SHINGLE, hashed(ws)).otherwise(F.array().cast("array<bigint>"))))


def bands(window: Column) -> Column:
    """``array<struct<band, value>>``: the window's MinHash in each band."""

    def smallest(band: int) -> Column:
        return F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(band))))

    return F.array(*[F.struct(F.lit(i).alias("band"), smallest(i).alias("value")) for i in range(BANDS)])


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``template, t, need``: the shingles of each template and how many distinct ones it has."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("template"), F.lit(v).alias("text")) for k, v in templates.items()]))
    table = spark.range(1).select(rows.alias("r")).select("r.template", shingles(F.col("r.text")).alias("t"))
    return table.filter(F.size("t") > 0).withColumn("need", F.size(F.array_distinct("t")))


def windows_of(h: Column, step: int) -> Column:
    """First places (from 0) of the windows over ``h``: every ``step``, the last one reaching the end."""
    return F.sequence(F.lit(0), F.greatest(F.ceil((F.size(h) - WINDOW) / step).cast("int"), F.lit(0)) * step, F.lit(step))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """``<id_col>, template, containment, first_word, n_places``: the templates that each text holds.

    A template is held where at least ``containment`` of its distinct shingles lie within its own length around a
    retrieved window. ``containment`` is the best share, ``first_word`` the first word (from 0) of the first window that
    holds it, ``n_places`` the windows that do. Whole texts are read. Null texts and texts or templates of fewer than five words
    match nothing. Rows that share an id (also null) are reported together, once per template. Other columns are not read.
    """
    spark = docs.sparkSession
    table = template_table(spark, TEMPLATES if templates is None else templates).cache()
    known = sorted({x for r in table.select("t").collect() for x in r.t})  # bounded by the list of templates
    few = table.count() <= BROADCAST
    parts = table.select("template", "t", "need", F.explode(windows_of(F.col("t"), 1)).alias("at"))
    keyed = parts.select("template", "t", "need", F.explode(bands(F.slice("t", F.col("at") + 1, WINDOW))).alias("b"))
    keyed = keyed.select("template", "t", "need", "b.band", "b.value").dropDuplicates(["template", "band", "value"])
    table.unpersist()

    rows = docs.select(F.col(id_col).alias("id"), shingles(F.col(text_col)).alias("h"))
    common = lambda xs: F.exists(xs, lambda x: x.isin(known))
    rows = rows.filter(common(F.col("h"))).withColumn("h", F.col("h"))
    at = F.filter(windows_of(F.col("h"), STEP), lambda i: common(F.slice("h", i + 1, WINDOW)))
    places = rows.select("id", "h", F.explode(at).alias("at"))
    hits = places.select("id", "h", "at", F.explode(bands(F.slice("h", F.col("at") + 1, WINDOW))).alias("b")).select("id", "h", "at", "b.*")
    found = hits.join(F.broadcast(keyed) if few else keyed, ["band", "value"])
    around = F.slice("h", F.greatest(F.col("at") + 1 - F.size("t"), F.lit(1)), F.size("t") * 2 + WINDOW)
    share = F.size(F.array_intersect("t", around)) / F.col("need")
    checked = found.select("id", "template", "at", share.alias("share")).filter(F.col("share") >= containment)
    return checked.groupBy("id", "template").agg(
        F.max("share").alias("containment"), F.min("at").cast("long").alias("first_word"), F.count_distinct("at").alias("n_places")
    ).withColumnRenamed("id", id_col)
