"""License scan: TF-IDF cosine of statements and whole texts to templates, then inheritance along paths.

Every line and sentence of a text is a possible licence header, held against
``TEMPLATES``; every whole text is a possible licence file, held against the
full texts of ``licence_texts``.  Terms are weighted by TF-IDF, in which every
line and sentence of the corpus counts, and compared by sparse cosine, as
joins: their terms meet template terms, products are summed for each pair.
Only what can reach the threshold takes part: it must hold a term without which
no template can be reached, and an upper bound of its cosine must reach the
threshold.  In that bound the vocabulary of the templates and the ``COMMON``
most frequent terms have their own weight and all others the least that they
can have, so no pair is lost.

A text that is like a full licence text, or of whose words at least half stand
in licence statements, is a licence file and speaks for its directory; the root
is the directory of paths without a slash and an ancestor of every path.  Texts
with no licence of their own inherit from the nearest ancestor directory that
has one, by an equi-join of each path's ancestors with the licence directories.

Defined cases: null and blank texts state nothing and may inherit; a null path
has no ancestors; a text like a full licence text has that licence, whatever
lines it holds; ties between templates go to the first name, between licence
files of a directory to the better cosine and then the first name; repeated
rows are scanned each, as if they stood alone; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, table, unpacked
from .scratch import settle

SIMILARITY = 0.5
#: Licences share their boilerplate, so whole texts must be nearer.
WHOLE_SIMILARITY = 0.75
#: So many of the most frequent terms have their own weight in the bound before the joins.
COMMON = 50_000
#: Counts by term are handed on when a task holds so many.
HELD_TERMS = 200_000
#: Where a statement ends: at a line's end, and after a full stop, question or exclamation mark.
SENTENCE = r"\r\n|[\n\r]|(?<=[.!?])\s+"
#: Licence names and wordings of their usual statements.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under Creative Commons Zero."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "No part may be reproduced without permission."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_SENTENCE, _BREAK = re.compile(SENTENCE), re.compile(r"[^\w.+-]+|_+|\.(?=\s|$)")


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the full licence texts beside this file."""
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]


def _terms(text: str) -> list[str]:
    return [t for t in _BREAK.split(text.lower()) if t]


def _statements(text: str | None) -> list[list[str]]:
    """The terms of every line and sentence."""
    return [_terms(p) for p in _SENTENCE.split(text or "")]


def _count(batches):
    """(term, df): in how many statements each term stands; a null term counts the statements."""
    df: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            parts = _statements(text)
            df[None] += len(parts)
            for terms in parts:
                df.update(set(terms))
            if len(df) > HELD_TERMS:
                yield pa.RecordBatch.from_arrays([pa.array(df.keys(), type=pa.string()), pa.array(df.values(), type=pa.int64())], names=["term", "df"])
                df = Counter()
    yield pa.RecordBatch.from_arrays([pa.array(df.keys(), type=pa.string()), pa.array(df.values(), type=pa.int64())], names=["term", "df"])


class Bound:
    """Upper bounds of the cosine to the nearest of some templates."""

    def __init__(self, wordings: list[str], idf: dict[str, float], least: float, similarity: float):
        self.idf, self.least, self.similarity = idf, least, similarity - 1e-6
        self.postings: dict[str, list[tuple[int, float]]] = {}
        self.essential: set[str] = set()
        for k, wording in enumerate(wordings):
            w = {t: n * idf[t] for t, n in Counter(_terms(wording)).items()}
            norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
            # terms that together cannot reach the threshold are not essential
            rest = 0.0
            for t in sorted(w, key=lambda t: (w[t], t)):
                self.postings.setdefault(t, []).append((k, w[t] / norm))
                rest += (w[t] / norm) ** 2
                if rest >= self.similarity**2:
                    self.essential.add(t)

    def reached(self, terms: list[str]) -> bool:
        if self.essential.isdisjoint(terms):
            return False
        dots: dict[int, float] = {}
        squares = 0.0
        for t, n in Counter(terms).items():
            w = n * self.idf.get(t, self.least)
            squares += w * w
            for k, v in self.postings.get(t, ()):
                dots[k] = dots.get(k, 0.0) + w * v
        return max(dots.values()) >= self.similarity * math.sqrt(squares)


def _find(shared):
    """Rows (doc_id, path, h, nth, words, whole, terms) of statements and whole texts that may reach the threshold; ``nth`` tells the statements of a text apart."""

    def run(batches):
        part, whole = unpacked(shared)
        for batch in batches:
            for k in range(0, len(batch), 1000):
                some = batch.slice(k, 1000)
                rows = []
                for at, text in enumerate(some.column(3).to_pylist()):
                    parts = _statements(text)
                    every = [t for terms in parts for t in terms]
                    rows += [(at, nth, len(every), False, terms) for nth, terms in enumerate(parts) if part.reached(terms)]
                    if whole.reached(every):
                        rows.append((at, -1, len(every), True, every))
                if rows:
                    at, nth, words, flags, terms = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [*(some.column(c).take(pa.array(at, type=pa.int64())) for c in range(3)), pa.array(nth, type=pa.int32()), pa.array(words, type=pa.int32()), pa.array(flags, type=pa.bool_()), pa.array(terms, type=pa.list_(pa.string()))],
                        names=["doc_id", "path", "h", "nth", "words", "whole", "terms"],
                    )

    return run


def _weighted(bags: DataFrame, keys: list[str], idf: DataFrame) -> DataFrame:
    """(keys, term, w) with unit length for each key; ``bags``: keys, term, tf."""
    raw = bags.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, keys).select(*keys, "term", (F.col("w") / F.col("norm")).alias("w"))


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, similarity: float = SIMILARITY, full: list[tuple[str, str]] | None = None) -> DataFrame:
    """``files``: doc_id, text, path.  One row for each: own and effective licence, cosine, where it comes from."""
    spark = files.sparkSession
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("path").cast("string").alias("path"))
    known = [(n, t, False) for n, t in templates or TEMPLATES] + [(n, t, True) for n, t in (full_texts() if full is None else full)]

    # in how many statements of the corpus each term stands; every statement counts
    df = settle(files.select("text").mapInArrow(_count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")))
    total = float((df.filter("term is null").agg(F.sum("df").alias("n")).first()["n"]) or 1)
    df = df.filter("term is not null")
    counts = [(i, n, whole, t, c) for i, (n, text, whole) in enumerate(known) for t, c in sorted(Counter(_terms(text)).items())]
    wordings = spark.createDataFrame(counts, "template int, licence string, whole boolean, term string, tf int")  # as many rows as the templates have terms
    vocabulary = wordings.select("term").distinct()
    weight = lambda n: math.log(1 + total / (1 + n))
    common = df.orderBy(F.desc("df"), "term").limit(COMMON).collect()
    of_templates = df.join(F.broadcast(vocabulary), "term", "left_semi").collect()
    weights = {c[3]: weight(0) for c in counts} | {r["term"]: weight(r["df"]) for r in [*common, *of_templates]}
    least = weight(common[-1]["df"]) if len(common) == COMMON else weight(0)
    bounds = Bound([t for _, t, whole in known if not whole], weights, least, similarity), Bound([t for _, t, whole in known if whole], weights, least, WHOLE_SIMILARITY)

    found = files.select("doc_id", "path", F.xxhash64("text").alias("h"), "text").mapInArrow(_find(carried(spark, bounds)), "doc_id long, path string, h long, nth int, words int, whole boolean, terms array<string>")
    marked = settle(found.withColumn("k1", F.xxhash64("whole", "terms")).withColumn("k2", F.hash("whole", "terms")))
    bags = settle(marked.groupBy("k1", "k2").agg(F.first("whole").alias("whole"), F.first("terms").alias("terms")))
    held = bags.select(F.explode("terms").alias("term")).distinct().unionByName(vocabulary).distinct()
    idf = settle(held.join(df, "term", "left").select("term", F.log(1 + F.lit(total) / (1 + F.coalesce("df", F.lit(0)))).alias("idf")))

    left = _weighted(bags.select("k1", "k2", "whole", F.explode("terms").alias("term")).groupBy("k1", "k2", "whole", "term").agg(F.count(F.lit(1)).alias("tf")), ["k1", "k2", "whole"], idf)
    right = _weighted(wordings, ["template", "licence", "whole"], idf)
    cosine = left.join(F.broadcast(right.withColumnRenamed("w", "v")), ["whole", "term"]).groupBy("k1", "k2", "whole", "template", "licence").agg(F.sum(F.col("w") * F.col("v")).alias("cosine"))
    near = cosine.filter(F.round("cosine", 9) >= F.when(F.col("whole"), WHOLE_SIMILARITY).otherwise(similarity))
    best = near.groupBy("k1", "k2").agg(F.max(F.struct(F.round("cosine", 9).alias("cosine"), (-F.col("template")).alias("first"), "licence")).alias("b")).select("k1", "k2", "b.cosine", "b.licence")
    stated = marked.join(settle(best), ["k1", "k2"]).select("doc_id", "h", "path", "nth", "words", F.size("terms").alias("n"), F.struct("whole", "cosine", "licence").alias("top"))
    # a row that repeats gives each of its statements again; one text's words are held against one text's statements
    stated = stated.groupBy("doc_id", "h", "path", "nth").agg(F.max("top").alias("top"), F.max("n").alias("n"), F.max("words").alias("words"))
    own = settle(
        stated.groupBy("doc_id", "h", "path").agg(F.max("top").alias("top"), F.sum("n").alias("n"), F.max("words").alias("words")).select("doc_id", "h", "path", "top.cosine", "top.licence", (2 * F.col("n") >= F.col("words")).alias("is_file"))
    )

    # licence files speak for their directory; the nearest of a path's ancestors wins
    folder = F.regexp_replace("path", "(^|/)[^/]*$", "")
    folders = settle(own.filter("is_file").select(folder.alias("folder"), "cosine", "licence").groupBy("folder").agg(F.max(F.struct("cosine", "licence")).alias("top")).select("folder", F.col("top.licence").alias("of_folder")))
    root = folders.filter("folder = ''").first()
    of_root = F.when(F.col("path").isNotNull(), F.lit(root and root["of_folder"]))
    steps = F.split("path", "/")
    parents = files.select("path").filter(F.size(steps) > 1).distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("folder")))).alias("p")).select("path", "p.depth", "p.folder")
    given = settle(parents.join(folders, "folder").groupBy("path").agg(F.max(F.struct("depth", "folder", "of_folder")).alias("near")).select("path", "near.folder", "near.of_folder"))
    out = files.select("doc_id", "path", F.xxhash64("text").alias("h"))
    on = [out.doc_id.eqNullSafe(own.doc_id), out.h == own.h, out.path.eqNullSafe(own.path)]
    return out.join(own, on, "left").select(out.doc_id, out.path, own.licence.alias("own_licence"), own.cosine, F.coalesce(own.is_file, F.lit(False)).alias("is_licence_file")).join(given, "path", "left").withColumn("folder", F.coalesce("folder", F.when(of_root.isNotNull(), ""))).withColumn("of_folder", F.coalesce("of_folder", of_root)).select(
        "doc_id",
        "path",
        "own_licence",
        "cosine",
        "is_licence_file",
        F.coalesce("own_licence", "of_folder").alias("licence"),
        F.when(F.col("own_licence").isNotNull(), "statement").when(F.col("of_folder").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(F.col("own_licence").isNull(), F.col("folder")).alias("inherited_from"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path of their own: theirs is source/language/hundred/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", "text", path.alias("path")))
