"""Licence notices found by MinHash bands over overlapping text windows, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.llm.common import stored

#: Fixed values: (id, public licence notice).
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[\p{L}\p{N}]+"
SHINGLE = 5
#: A notice is found when this share of its shingles occurs in the document.
LEAST = 0.8
#: One-row bands: a window and a template of resemblance j meet with probability 1 - (1 - j)^BANDS, 0.9998 at j = 0.5.
BANDS = 12


def collision(j: float) -> float:
    return 1 - (1 - j) ** BANDS


def words(text) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def shingles(w) -> Column:
    """64-bit hashes of all runs of five words, in order; none when there are fewer words."""
    last = F.size(w) - (SHINGLE - 1)
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda k: F.xxhash64(F.slice(w, k, SHINGLE)))).otherwise(F.array().cast("array<bigint>"))


def once(df: DataFrame, *drop: str, **cols: Column) -> DataFrame:
    """``df`` with ``cols``, which later expressions refer to instead of computing them again for every element."""
    out = df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))).alias("_once"))
    return out.select(*[c for c in df.columns if c not in drop], *[F.col(f"_once.{k}").alias(k) for k in cols])


def template_frame(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """One row per notice: ``t``, ``license``, ``t_grams``, ``scale``. Notices of under five words are refused."""
    rows = spark.createDataFrame([(k, i, x) for k, (i, x) in enumerate(templates)], "t int, license string, notice string")
    w = words(F.col("notice"))
    rows = rows.select("t", "license", F.array_distinct(shingles(w)).alias("t_grams"), w.alias("t_words"))
    n = F.size("t_grams")
    power = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1))))).cast("int")
    return rows.withColumn("scale", F.when(n > 0, power).otherwise(F.raise_error(F.lit("a notice needs five words")).cast("int")))


def _least(grams: Column, seed: int) -> Column:
    return F.array_min(F.transform(grams, lambda g: F.xxhash64(F.lit(seed), g)))


def _bands(grams: Column) -> Column:
    """(band, least value) of the shingles of one window under each of the seeded permutations."""
    return F.array(*[F.struct(F.lit(k).alias("band"), _least(grams, k).alias("low")) for k in range(BANDS)])


def cue_words(templates=TEMPLATES) -> list[str]:
    """Words of which every possible finding has one, so that texts without any can be passed over.

    Words are taken per notice, longest first, until the shingles that hold one of them are more than the share
    ``1 - LEAST`` that a finding may lack.
    """
    import re

    cues: set[str] = set()
    for _, notice in templates:
        w = re.findall(r"[^\W_]+", notice.lower())
        grams = {tuple(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)}
        for word in sorted(set(w), key=lambda x: (x not in cues, -len(x), x)):
            if sum(any(c in g for c in cues) for g in grams) > (1 - LEAST) * len(grams):
                break
            cues.add(word)
    return sorted(cues)


def license_matches(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """(key, ``license``, ``containment``): notices of which at least 80 % of the five-word shingles occur in the text.

    Texts are cut into overlapping windows of 1, 2, 4, ... shingles, one size per template size, each a quarter further on.
    Windows without a cue word are passed over: they lack more than a fifth of every notice. MinHash bands of the
    others are joined with those of the templates, and the share of a template's shingles in the whole text decides.
    One row per key and licence, the best of its notices; rows that repeat a key give one row, and null is a key like any
    other. Null or empty texts and texts of under five words have none. Hashes of texts with a cue are stored once and
    read for the windows and for the check; only such hashes are shuffled.
    """
    t = template_frame(docs.sparkSession, templates)
    sizes = sorted({r["scale"] for r in t.select("scale").distinct().collect()})
    cues = F.array(*[F.lit(c) for c in cue_words(templates)])
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    some = docs.where(low.rlike("|".join(cue_words(templates)))).select(F.col(key).alias("_key"), F.md5(F.col(text)).alias("_md5"), words(F.col(text)).alias("w"))
    some = once(some, "w", words=F.col("w"))
    at = F.filter(F.transform("words", lambda w, k: F.when(F.array_contains(cues, w), k + 1)), lambda k: k.isNotNull())
    some = once(some, "words", grams=shingles(F.col("words")), cue=at).where((F.size("grams") > 0) & (F.size("cue") > 0))
    # A row is known by key and text, so null keys and keys that repeat with other texts keep their own shingles.
    row = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("_key").cast("string")), F.lit("")), F.lit("|"), F.col("_md5")))
    some = stored(some.select("_key", row.alias("_row"), "grams", "cue"), "shingles")

    def windows(n: int) -> Column:
        """Windows of ``n`` shingles on a grid of a quarter of it; those that hold a cue word."""
        step = max(1, n // 4)
        cell = lambda k: F.floor((k - 1) / step).cast("int")
        last = cell(F.size("grams"))
        starts = F.array_distinct(F.flatten(F.transform("cue", lambda c: F.sequence(F.greatest(cell(c - (n + SHINGLE - 2)), F.lit(0)), F.least(cell(c), last)))))
        return F.transform(starts, lambda k: F.struct(F.lit(n).alias("scale"), F.slice("grams", k * step + 1, n).alias("g")))

    seen = some.select("_row", F.explode(F.concat(*[windows(n) for n in sizes])).alias("win"))
    seen = seen.select("_row", "win.scale", F.explode(_bands(F.col("win.g"))).alias("b")).select("_row", "scale", "b.band", "b.low")
    t_bands = t.select("t", "scale", F.explode(_bands(F.col("t_grams"))).alias("b")).select("t", "scale", "b.band", "b.low")
    found = seen.join(F.broadcast(t_bands), ["scale", "band", "low"]).select("_row", "t").distinct()
    checked = found.join(F.broadcast(t.select("t", "license", "t_grams")), "t").join(some.select("_row", "_key", "grams"), "_row")
    share = F.size(F.array_intersect("t_grams", "grams")) / F.size("t_grams")
    best = checked.withColumn("containment", share).where(F.col("containment") >= LEAST).groupBy("_key", "license").agg(F.max("containment").alias("containment"))
    return best.select(F.col("_key").alias(key), "license", "containment")


def oracle_sql(templates=TEMPLATES) -> str:
    """Exact containment of every notice in every document."""
    rows = ", ".join(f"({k}, '{i}', '{x.replace(chr(39), chr(39) * 2)}')" for k, (i, x) in enumerate(templates))
    w = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{UPPER}', '{LOWER}'), '[\\p{{L}}\\p{{N}}]+')"
    g = "list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')))"
    return (
        f"WITH t AS (SELECT t, license, {g} AS g FROM (SELECT *, {w('notice')} AS w FROM (VALUES {rows}) v(t, license, notice))), "
        f"d AS (SELECT doc_id, {g} AS g FROM (SELECT doc_id, {w('text')} AS w FROM documents)), "
        "p AS (SELECT doc_id, unnest(g) AS x FROM d), q AS (SELECT t, license, len(g) AS n, unnest(g) AS x FROM t), "
        "c AS (SELECT doc_id, t, license, count(DISTINCT p.x) / any_value(n)::DOUBLE AS containment FROM p JOIN q ON p.x = q.x GROUP BY ALL) "
        f"SELECT doc_id, license, max(containment) AS containment FROM c WHERE containment >= {LEAST} GROUP BY ALL"
    )
