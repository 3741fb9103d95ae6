"""License scan by MinHash bands over overlapping text windows and exact shingle containment; DataFrame functions only.

Texts are cut into windows of `WINDOW` shingles (five words each) on a grid of half that size; templates have their windows at every offset, or one window if they are
shorter. A MinHash is the least of the window's shingle hashes after an exclusive-or with one of `BANDS` fixed words whose leading bits differ; a
band is one MinHash. For a Jaccard similarity j, two windows share a band with probability 1 - (1 - j) ** BANDS. A whole template of three or
four shingles lies inside some window, so j >= 3 / 8; a longer one, edited up to the threshold, has a window with j >= 5 / 11: at least
0.9994 of them are retrieved. Templates of one or two shingles have windows of one shingle, which a band finds always. Hits are
verified by exact containment of the template's distinct shingles in the whole text, so interrupted and rearranged templates count too.

Defined results: null and empty texts or templates match nothing; templates of under five words are left out, as they have no full shingle; repeated rows are one
row of the result; several copies of a template in a text are one match, told with where the first would begin; an empty table gives an empty result.

Scale: texts are read twice without a shuffle; only hits leave the first pass. The template index is broadcast only if its counted rows are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sqltext import SHINGLE, row_key, scratch, shingles, small, word_hashes, words

THRESHOLD = 0.8
WINDOW = 8
BANDS = 16

# fixed values: notices by which works state their license
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "Apache-2.0-text": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "GPL-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
}


def templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("text")) for k, v in TEMPLATES.items()))
    return spark.range(1).select(F.inline(rows))


def _masks() -> list[int]:
    """One word a band: the leading bits count the bands, the others are a fixed scramble."""
    out = []
    for i in range(BANDS):
        x = (i + 1) * 0x9E3779B97F4A7C15 & (1 << 60) - 1
        word = i * (16 // BANDS if BANDS <= 16 else 1) << 60 | x
        out.append(word - (1 << 64) if word >> 63 else word)
    return out


def _windows(df: DataFrame, hashes: str, size: int, step: int, whole: bool) -> DataFrame:
    """One row per window: its first shingle's place `at` from 1, and its hashes; whole: a shorter list is one window."""
    n = F.size(hashes)
    last = F.greatest(n - size, F.lit(0)) if whole else n - size
    # the grid ends with the last window that holds a new shingle
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), last + (1 if whole else step)), F.lit(step))).otherwise(F.expr("cast(array() as array<int>)"))
    each = F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice(F.col(hashes), i, size).alias("w")))
    rest = [c for c in df.columns if c != hashes]
    return df.select(*rest, F.explode(each).alias("x")).select(*rest, F.col("x.at").alias("at"), F.col("x.w").alias("w"))


def _banded(df: DataFrame, size: int) -> DataFrame:
    """A row for each band: its number and its MinHash. Windows of one shingle need one band."""
    if size == 1:
        return df.select("*", F.lit(0).alias("band"), F.coalesce(F.col("w")[0], F.lit(0).cast("long")).alias("least")).drop("w")
    # one row a band first, then the least of plain columns, which Spark compiles; array functions with lambdas took ten times as long
    rest = [c for c in df.columns if c != "w"]
    split = df.select(*rest, *(F.get("w", F.lit(i)).alias(f"w{i}") for i in range(size)))
    masks = F.array(*(F.struct(F.lit(i).alias("band"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(_masks())))
    each = split.select(*split.columns, F.explode(masks).alias("x"))
    least = F.least(*(F.col(f"w{i}").bitwiseXOR(F.col("x.mask")) for i in range(size)))
    return each.select(*rest, F.col("x.band").alias("band"), F.coalesce(least, F.lit(0).cast("long")).alias("least"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", license_col: str = "license_id", license_text_col: str = "text",
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per text row and license: row_key, id, license, containment, and the first word (from 1) where the earliest hit would have the license begin."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("rkey", row_key(F.col("id"), F.col("text")))
    marks = known.select(F.col(license_col).alias("license"), word_hashes(words(F.col(license_text_col))).alias("lw")).where(F.size("lw") >= SHINGLE)
    marks = marks.select("license", shingles(F.col("lw")).alias("lsh"))
    hits = None
    for size, mine in ((1, F.size("lsh") <= 2), (WINDOW, F.size("lsh") > 2)):
        own = marks.where(mine)
        if own.isEmpty():
            continue
        index = _banded(_windows(own, "lsh", size, 1, True).withColumnsRenamed({"at": "offset"}), size)
        index = index.groupBy("band", "least", "license").agg(F.min("offset").alias("offset"), F.max("offset").alias("last"))
        texts = docs.select("rkey", word_hashes(words(F.col("text"))).alias("dw")).where(F.size("dw") >= SHINGLE).select("rkey", shingles(F.col("dw")).alias("dsh"))
        found = _banded(_windows(texts, "dsh", size, max(1, size // 2), False), size).join(small(index), ["band", "least"])
        found = found.select("rkey", "license", F.explode(F.array_distinct(F.array(F.col("at") - F.col("offset") + 1, F.col("at") - F.col("last") + 1))).alias("begin"))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = docs.sparkSession.createDataFrame([], f"rkey long, license {marks.schema['license'].dataType.simpleString()}, begin int")
    # where a license begins by its first hit is told, but its shingles may stand anywhere in the text
    hits = scratch(hits.groupBy("rkey", "license").agg(F.min("begin").alias("begin")))
    once = lambda c: F.explode(F.array(c))  # noqa: E731  kept from being worked out again in the next expression
    back = docs.join(small(hits.select("rkey").distinct()), "rkey", "left_semi").select("rkey", "id", once(word_hashes(words(F.col("text")))).alias("dw"))
    back = back.select("rkey", "id", once(shingles(F.col("dw"))).alias("dsh"))
    both = back.join(hits.join(small(marks), "license"), "rkey")
    share = F.size(F.array_intersect("lsh", "dsh")) / F.size(F.array_distinct("lsh"))
    return (both.withColumn("containment", share).where(F.col("containment") >= threshold - 1e-9).groupBy("rkey", "id", "license")
            .agg(F.max("containment").alias("containment"), F.min("begin").alias("begin")).select(F.col("rkey").alias("row_key"), "id", "license", "containment", "begin"))
