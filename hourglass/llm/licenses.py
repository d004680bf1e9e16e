"""License scans: TF-IDF cosine of header lines and whole licence files to templates, then inheritance along directories."""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from hourglass.llm.common import set_aside, settle

#: Public licence notices, as (licence, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Every template has one of these; a single line or text without any is not compared.
MARKERS = r"(?i)licen[cs]e|copyright|rights reserved|redistribut|permission is|public domain"
#: The same in a block of lines, where words may be wrapped and lines begin with comment signs.
WRAPPED = r"(?i)licen[cs]e|copyright|rights[^a-z0-9]+reserved|redistribut|permission[^a-z0-9]+is|public[^a-z0-9]+domain"
BLOCK = 6  # lines of the longest block
HEADER, FILE = 0.6, 0.35
#: A whole text this near to a full text is that licence (other names and years: 0.95 or more; unlike licences: at most 0.8).
FULL = 0.92
FULL_TEXTS = Path(__file__).with_name("licence_texts")


def terms(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def full_texts() -> list[tuple[str, str]]:
    return [(p.name.removesuffix(".txt"), p.read_text()) for p in sorted(FULL_TEXTS.glob("*.txt"))]


def template_weights(templates: list[tuple[str, str]]) -> tuple[dict[str, float], float, list[tuple[str, int, str, float]]]:
    """idf by term, idf of any other term, and (licence, template, term, unit-length weight) of the templates."""
    n = len(templates)
    df = Counter(t for _, text in templates for t in set(terms(text)))
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    rows = []
    for number, (licence, text) in enumerate(templates):
        weights = {t: k * idf[t] for t, k in Counter(terms(text)).items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        rows += [(licence, number, t, w / length) for t, w in sorted(weights.items())]
    return idf, math.log(1 + n) + 1, rows


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _scored(counted: DataFrame, known: DataFrame, vectors: DataFrame, other: float, unit: list[str]) -> DataFrame:
    """(unit, licence, score): cosine of every unit's counted terms to every template that shares a term with it."""
    weighed = counted.join(known, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    lengths = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = weighed.join(vectors, "term").groupBy(*unit, "licence", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    return dots.join(lengths, unit).select(*unit, "licence", F.round(F.col("dot") / F.col("length"), 6).alias("score"))


def _blocks(rows: DataFrame, text: str) -> DataFrame:
    """Runs of 2 to BLOCK neighbouring lines with a licence word in them, wherever they start: (path, version, unit, line)."""
    given = rows.filter(F.col(text).rlike(WRAPPED)).select("__path", "__version", text).dropDuplicates(["__path", "__version"])
    lines = F.split(text, "\n")
    start = lambda i: F.struct(i.alias("at"), F.slice(lines, i, BLOCK).alias("lines"))
    runs = F.filter(F.transform(F.sequence(F.lit(1), F.size(lines)), start), lambda b: F.array_join(b.lines, "\n").rlike(WRAPPED))
    parts = F.transform(F.sequence(F.lit(2), F.lit(BLOCK)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("b.lines", 1, n), "\n").alias("line")))
    held = given.select("__path", "__version", F.explode(runs).alias("b")).select("__path", "__version", "b", F.explode(parts).alias("p"))
    return held.filter((F.col("p.n") <= F.size("b.lines")) & F.col("p.line").rlike(WRAPPED)).select("__path", "__version", (F.col("b.at") * BLOCK + F.col("p.n")).alias("unit"), "p.line")


def scan(files: DataFrame, path: str = "path", text: str = "text", header: float = HEADER, whole: float = FILE) -> DataFrame:
    """The rows with licence, licence_score, origin (own, inherited, none) and licence_from (a directory, when inherited).

    A file's own licence is that of the full licence text it repeats (score at least FULL), else of its most similar line or whole
    text among the notices (score at least ``header``; ties: first licence), else of the most similar block of 2 to BLOCK
    neighbouring lines, so that wrapped notices are found whole. A file that repeats a full text, or else whose whole
    text reaches ``whole`` on a notice, is a licence file and speaks for its directory (best score, then first licence). Files
    without a licence of their own take that of the nearest directory above them that has one; directories are resolved once
    each, so a directory with most files is still one row. NULL text is empty, a NULL path has no directories; repeated rows
    repeat; columns named like results are replaced; no rows give no rows. Term counts, scores, own licences and speaking directories
    are settled, each being read more than once: no plan holds more than one of these steps.
    """
    spark = files.sparkSession
    given, back = set_aside(files.drop("licence", "licence_score", "origin", "licence_from"), (path, text))
    rows = given.withColumns({"__path": F.coalesce(path, F.lit("")), "__version": F.xxhash64(text)})
    idf, other, weights = template_weights(TEMPLATES)
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))  # a few dozen fixed rows
    vectors = F.broadcast(spark.createDataFrame(weights, "licence string, template int, term string, weight double"))
    marked = rows.filter(F.col(text).rlike(MARKERS)).select("__path", "__version", text).dropDuplicates(["__path", "__version"])
    lines = marked.select("__path", "__version", F.posexplode(F.split(text, "\n")).alias("unit", "line")).filter(F.col("line").rlike(MARKERS))
    units = lines.unionByName(marked.select("__path", "__version", F.lit(-1).alias("unit"), F.col(text).alias("line")))
    words = units.select("__path", "__version", "unit", F.explode(F.split(F.lower("line"), "[^a-z0-9]+")).alias("term")).filter("term <> ''")
    unit = ["__path", "__version", "unit"]
    counted = settle(words.groupBy(*unit, "term").agg(F.count("*").alias("tf")))
    notice = (known, vectors, other)
    scored = settle(_scored(counted, *notice, unit).filter(F.col("score") >= min(header, whole)))
    best = lambda: F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("b")
    file = ["__path", "__version"]
    idf, other, weights = template_weights(full_texts())
    known = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))  # some thousand fixed rows
    vectors = F.broadcast(spark.createDataFrame(weights, "licence string, template int, term string, weight double"))
    entire = _scored(counted.filter("unit = -1"), known, vectors, other, unit).filter(F.col("score") >= FULL).withColumn("rank", F.lit(0))
    notices = scored.filter(F.col("score") >= header).withColumn("rank", F.lit(1))
    first = F.min(F.struct("rank", (-F.col("score")).alias("minus"), "licence")).alias("b")
    own = settle(notices.unionByName(entire).groupBy(*file).agg(first).select(*file, F.col("b.licence").alias("own"), (-F.col("b.minus")).alias("own_score"), (F.col("b.rank") == 0).alias("is_full")))
    blocks = _blocks(rows.join(own, file, "left_anti"), text)
    words = blocks.select(*file, "unit", F.explode(F.split(F.lower("line"), "[^a-z0-9]+")).alias("term")).filter("term <> ''")
    wrapped = _scored(settle(words.groupBy(*unit, "term").agg(F.count("*").alias("tf"))), *notice, unit).filter(F.col("score") >= header)
    wrapped = wrapped.groupBy(*file).agg(best()).select(*file, F.col("b.licence").alias("own"), (-F.col("b.minus")).alias("own_score"), F.lit(False).alias("is_full"))
    own = settle(own.unionByName(wrapped))
    loose = scored.filter((F.col("unit") == -1) & (F.col("score") >= whole)).groupBy(*file).agg(best())
    files = loose.join(own, file, "full").filter((F.col("is_full") | F.col("b").isNotNull()) & (F.col("__path") != ""))
    spoken = F.when(F.col("is_full"), F.struct("own_score", "own")).otherwise(F.struct((-F.col("b.minus")).alias("own_score"), F.col("b.licence").alias("own")))
    speaking = files.withColumn("s", spoken).select("__path", F.col("s.own").alias("licence"), F.col("s.own_score").alias("score")).groupBy(parent(F.col("__path")).alias("dir")).agg(best())
    speaking = settle(speaking.select("dir", F.col("b.licence").alias("dir_licence"), (-F.col("b.minus")).alias("dir_score")))
    directories = rows.select(parent(F.col("__path")).alias("home")).distinct()
    parts = F.split("home", "/")
    above = directories.select("home", F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir"))), F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("dir"))))).alias("a")).select("home", "a.*")
    above = above.filter((F.col("dir") != "") | (F.col("depth") == 0))
    nearest = above.join(speaking, "dir").groupBy("home").agg(F.max_by(F.struct("dir", "dir_licence", "dir_score"), "depth").alias("n"))
    joined = rows.join(own.drop("is_full"), file, "left").withColumn("home", parent(F.col("__path"))).join(nearest, "home", "left")
    has_own = F.col("own").isNotNull()
    return joined.select(
        *back,
        F.coalesce("own", "n.dir_licence").alias("licence"), F.when(has_own, F.col("own_score")).otherwise(F.col("n.dir_score")).alias("licence_score"),
        F.when(has_own, "own").when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(~has_own, F.col("n.dir")).alias("licence_from"),
    )


def oracle(paths: str) -> str:
    """The same as SQL; ``paths`` selects doc_id, path and text."""
    idf, other, weights = template_weights(TEMPLATES)
    quoted = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)
    return rf"""
WITH f AS ({paths}), idf(term, idf) AS (VALUES {quoted(sorted(idf.items()))}), v(licence, template, term, weight) AS (VALUES {quoted(weights)}),
m AS (SELECT doc_id, path, text FROM f WHERE regexp_matches(text, '{MARKERS}')),
u AS (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS unit FROM m),
units AS (SELECT doc_id, path, unit, line FROM u WHERE regexp_matches(line, '{MARKERS}') UNION ALL SELECT doc_id, path, -1, text FROM m),
w AS (SELECT doc_id, path, unit, unnest(regexp_split_to_array(lower(line), '[^a-z0-9]+')) AS term FROM units),
t AS (SELECT doc_id, path, unit, term, count(*) * coalesce(any_value(idf), {other!r}) AS w FROM w LEFT JOIN idf USING (term) WHERE term <> '' GROUP BY doc_id, path, unit, term),
l AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS length FROM t GROUP BY doc_id, unit),
d AS (SELECT doc_id, path, unit, licence, template, sum(w * weight) AS dot FROM t JOIN v USING (term) GROUP BY doc_id, path, unit, licence, template),
s AS (SELECT d.doc_id, path, d.unit, licence, round(dot / length, 6) AS score FROM d JOIN l ON d.doc_id = l.doc_id AND d.unit = l.unit),
own AS (SELECT doc_id, licence, score FROM s WHERE score >= {HEADER} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1),
dirs AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, licence, score FROM s WHERE unit = -1 AND score >= {FILE}
         QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, licence) = 1),
near AS (SELECT f.doc_id, dir, licence, score FROM f JOIN dirs ON starts_with(f.path, dir || '/') QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(dir) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(own.licence, near.licence) AS licence, CASE WHEN own.licence IS NOT NULL THEN own.score ELSE near.score END AS licence_score,
       CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN near.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN own.licence IS NULL THEN near.dir END AS licence_from
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN near USING (doc_id)
"""
