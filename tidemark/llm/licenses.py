"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import fresh, materialize

# fixed values: short and opening notices of public licences, as their texts have them
TEMPLATES = [
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "permissive",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "permissive", "Released under the MIT License."),
    (
        "MIT",
        "permissive",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction',
    ),
    (
        "BSD-3-Clause",
        "permissive",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ),
    ("BSD-3-Clause", "permissive", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "copyleft",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "copyleft", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0. Creative Commons Attribution-ShareAlike 4.0 International."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "permissive", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "proprietary", "All rights reserved."),
]
TEXTS = Path(__file__).with_name("license_texts")  # whole licence texts, one file by name of the licence
CUE = r"(?i)licen[cs]e|copyright|all rights reserved|permission is hereby|redistribution and use|free software|public domain|spdx"
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|notice)"
TERM = "[a-z0-9]+"
LEAST = 0.6  # cosine from which a notice is taken for a licence


def _terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): how often each term is in a text."""
    words = F.expr(f"regexp_extract_all(lower({text}), '{TERM}', 0)")
    return df.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def match_notices(notices: DataFrame, least: float = LEAST) -> DataFrame:
    """(notice, license, score) of the distinct texts of ``notices`` (notice, text, n) that are like a template.

    Terms weigh (1 + ln tf) * (1 + ln((N + 1) / (df + 1))), where N counts the files with a notice and df those with the term;
    ``n`` is how many files have the text.  The best template wins, of equals (to 9 digits) the last by name.
    """
    spark = notices.sparkSession
    total = notices.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    terms = materialize(_terms(notices, "notice", "text").join(notices.select("notice", "n"), "notice"))
    idf = terms.groupBy("term").agg(F.sum("n").alias("df"))
    weight = f"(1 + ln(tf)) * (1 + ln(({total} + 1D) / (coalesce(df, 0) + 1D)))"
    vectors = terms.join(idf, "term").selectExpr("notice", "term", f"{weight} as w")
    norms = vectors.groupBy("notice").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    whole = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    rows = [(k, name, text) for k, (name, text) in enumerate([(name, text) for name, _, text in TEMPLATES] + whole)]
    templates = spark.createDataFrame(rows, "template int, license string, text string")
    # a fixed list of templates: some thousand terms, whatever the input
    wanted = _terms(templates, "template", "text").join(idf, "term", "left").selectExpr("template", "term", f"{weight} as v")
    sizes = wanted.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    dots = vectors.join(F.broadcast(wanted), "term").groupBy("notice", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = (
        dots.join(norms, "notice")
        .join(F.broadcast(sizes), "template")
        .join(F.broadcast(templates.select("template", "license")), "template")
        .select("notice", F.struct(F.round(F.col("dot") / (F.col("norm") * F.col("size")), 9).alias("score"), "license").alias("hit"))
    )
    best = scored.groupBy("notice").agg(F.max("hit").alias("hit"))
    return best.select("notice", "hit.license", "hit.score").where(F.col("score") >= least)


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """``files`` without its text, with ``own_license``, ``score``, ``license`` and ``licensed_by``.

    A file is compared by its lines that speak of licences or rights, wherever they stand, and a file named like a licence
    as a whole too; the better match counts.  A file without a licence of its own takes that of the nearest directory above it with a licence file
    (the best of several); ``licensed_by`` is "self", that directory, or null.  A null path has no directory, a null or
    empty text no notice; repeated rows stay.  New names that clash get a leading underscore.

    Equal notices are compared once, and directories rather than files are joined with the ones above them.
    """
    notice, whole, directory, named, lines_of, text_of = fresh(files, "notice", "whole", "directory", "named", "lines_of", "text_of")
    hit, other, above_, inherited = fresh(files, "hit", "other", "above", "inherited")
    own, score, license_, by = fresh(files, "own_license", "score", "license", "licensed_by")
    path, text = F.col(f"`{path_col}`"), F.col(f"`{text_col}`")
    base = F.element_at(F.split(path, "/"), -1)
    cut = F.array_join(F.filter(F.split(text, "\n"), lambda x: x.rlike(CUE)), "\n")
    passing = [f"`{c}`" for c in files.columns if c != text_col]
    noted = files.select(
        *passing,
        F.coalesce(base.rlike(LICENSE_NAME), F.lit(False)).alias(named),
        F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).alias(directory),
        F.when(text.rlike(CUE), cut).alias(lines_of),
        F.when(base.rlike(LICENSE_NAME) & (text != ""), text).alias(text_of),
    )
    noted = noted.withColumn(notice, F.md5(lines_of)).withColumn(whole, F.md5(text_of))
    # a licence file counts once among the files with a notice, whichever way it is compared
    lines = noted.where(F.col(lines_of) != "").select(F.col(notice).alias("notice"), F.col(lines_of).alias("text"), F.lit(1).alias("k"))
    wholes = noted.where(F.col(text_of) != "").select(
        F.col(whole).alias("notice"), F.col(text_of).alias("text"), F.when(F.col(lines_of) != "", 0).otherwise(1).alias("k")
    )
    distinct = lines.unionByName(wholes).groupBy("notice", "text").agg(F.sum("k").alias("n"))
    matched = materialize(match_notices(materialize(distinct), least).select("notice", F.struct(F.round("score", 6).alias("s"), "license").alias("hit")))
    # most files have no notice: they need no join, and would meet in one task under a null key
    noted = noted.drop(lines_of, text_of)
    bare = F.col(notice).isNull() & F.col(whole).isNull()
    found = noted.where(F.col(notice).isNotNull() & F.col(whole).isNull()).join(matched.toDF(notice, hit), notice, "left")
    files_found = noted.where(F.col(whole).isNotNull()).join(matched.toDF(whole, hit), whole, "left")
    files_found = files_found.join(matched.toDF(notice, other), notice, "left").withColumn(hit, F.greatest(hit, other)).drop(other)
    found = found.unionByName(files_found).unionByName(noted.where(bare), allowMissingColumns=True)
    found = found.withColumn(own, F.col(hit)["license"]).withColumn(score, F.col(hit)["s"]).drop(hit, notice, whole)
    known = materialize(found)
    sources = (
        known.where(F.col(named) & F.col(own).isNotNull() & F.col(directory).isNotNull())
        .groupBy(F.col(directory).alias("above"))
        .agg(F.max(F.struct(score, own)).alias("best"))
        .select("above", F.col(f"best.{own}").alias("inherited"))
    )
    parts = F.split("below", "/")
    above = (
        known.where(F.col(own).isNull() & F.col(directory).isNotNull())
        .select(F.col(directory).alias("below"))
        .distinct()
        .select("below", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
        .withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    )
    nearest = above.join(sources, "above").groupBy("below").agg(F.max(F.struct("depth", "above", "inherited")).alias("from"))
    nearest = nearest.select(F.col("below").alias(directory), F.col("from.above").alias(above_), F.col("from.inherited").alias(inherited))
    return known.join(nearest, directory, "left").select(
        *passing,
        own,
        score,
        F.coalesce(F.col(own), F.col(inherited)).alias(license_),
        F.when(F.col(own).isNotNull(), F.lit("self")).otherwise(F.col(above_)).alias(by),
    )
