"""Licence scans: TF-IDF cosine of statements and licence files to templates, and inheritance from the nearest directory. DataFrame operations only."""

from __future__ import annotations

import json
import re
from collections import Counter
from math import log
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlake.llm.common import small, table, written
from clusterlake.operators.sketches import let

#: Usual statements of licences, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ],
}
#: Words without weight.
STOP = "a an and any are as at by for from if in is it of on one or that the this to was were with you".split()
#: Least cosine of a statement, and of a licence file to a whole licence.
COSINE = 0.75
#: Lines, or sentences, in a run that is scored as one statement at most.
RUN = 12


def tokens(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")
    return F.filter(words, lambda x: ~x.isin(STOP))


def words_of(text: str) -> list[str]:
    """tokens() of one text."""
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w and w not in STOP]


def whole_licenses() -> dict[str, str]:
    """Texts of whole licences by SPDX identifier, of those in the folder."""
    return {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def counts(unit: Column, vocabulary: list[str]) -> Column:
    """Of a unit, the number k of words that templates have and u of others."""
    words = F.split(F.lower(unit), "[^a-z0-9]+")
    count = lambda s, x: F.when((x == "") | x.isin(STOP), s).when(x.isin(vocabulary), F.struct((s["k"] + 1).alias("k"), s["u"].alias("u"))).otherwise(F.struct(s["k"].alias("k"), (s["u"] + 1).alias("u")))
    return F.aggregate(words, zero(), count)


def zero() -> Column:
    return F.struct(F.lit(0).cast("double").alias("k"), F.lit(0).cast("double").alias("u"))


def total(each: Column) -> Column:
    return F.aggregate(each, zero(), lambda s, x: F.struct((s["k"] + x["k"]).alias("k"), (s["u"] + x["u"]).alias("u")))


def possible(c: Column) -> Column:
    """Whether a unit with these counts can reach the least cosine.

    The cosine is at most the share that the words k have in the vector's length; no word weighs more than an unknown one, so that
    their squares sum to at most k * k, and those of the others to at least u, in squares of that weight.
    """
    need = COSINE**2 / (1 - COSINE**2)
    return (c["k"] > 0) & (c["k"] * c["k"] >= need * c["u"])


def runs(parts: Column, vocabulary: list[str], sep: str, whole: bool) -> Column:
    """The runs of at most RUN parts that can reach the least cosine and, if asked for, all parts together.

    A run begins and ends with a part that has a word of the templates: without one that has none, its cosine is at least as large.
    """

    def chosen(x: Column) -> Column:
        p, c = x["p"], x["c"]
        n = F.size(c)
        at = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(c, i)["k"] > 0)
        ends = lambda i: F.filter(F.sequence(i, F.least(n, i + (RUN - 1))), lambda j: (F.element_at(c, j)["k"] > 0) & let(total(F.slice(c, i, j - i + 1)), possible))
        found = F.flatten(F.transform(at, lambda i: F.transform(ends(i), lambda j: F.array_join(F.slice(p, i, j - i + 1), sep))))
        return F.concat(found, F.when(let(total(c), possible), F.array(F.array_join(p, sep))).otherwise(F.array().cast("array<string>"))) if whole else found

    both = let(parts, lambda p: F.struct(p.alias("p"), F.transform(p, lambda x: counts(x, vocabulary)).alias("c")))
    return F.array_distinct(let(both, chosen))


def words_in(words: list[str]) -> Column:
    """An array of words, as one literal."""
    return F.split(F.lit(" ".join(words)), " ")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the templates' words, as one literal."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")).alias("x")).select("x.*")


def best_of(units: DataFrame, forms: list[tuple[str, str, list[str]]], idf: dict[str, float], unknown: float) -> DataFrame:
    """(key, cosine, license) of each of (key, unit) that reaches the least cosine to one of the forms (name, licence, words)."""
    spark = units.sparkSession
    known = F.broadcast(small_table(spark, list(idf.items()), "word string, idf double"))
    t = small_table(spark, [(form, k, w, x) for form, k, words in forms for w, x in unit_vector(words, idf).items()], "form string, license string, word string, t double")
    tf = units.select("key", F.explode(tokens(F.col("unit"))).alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("tf"))
    v = tf.join(known, "word", "left").select("key", "word", (F.col("tf") * F.coalesce("idf", F.lit(unknown))).alias("w"))
    norm = v.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = v.join(F.broadcast(t), "word").groupBy("key", "form", "license").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    scored = dot.join(norm, "key").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= COSINE)
    return scored.groupBy("key").agg(F.max(F.struct("cosine", "license")).alias("b")).select("key", "b.*")


def unit_vector(words: list[str], idf: dict[str, float]) -> dict[str, float]:
    w = {x: n * idf[x] for x, n in Counter(words).items()}
    norm = sum(x * x for x in w.values()) ** 0.5
    return {k: x / norm for k, x in w.items()}


def near_a_whole(text: Column, forms: list[tuple[str, str, list[str]]], idf: dict[str, float]) -> Column:
    """Whether a text has words enough to reach the least cosine to one of the forms: those it shares make up at least the cosine's square of the form's squares."""
    out = F.lit(False)
    for _, _, words in forms:
        squares = sorted(((x * x, w) for w, x in unit_vector(words, idf).items()), reverse=True)
        top, sum_ = [], 0.0
        while sum_ < 0.9:  # a text may have all of the rest
            top.append(squares[len(top)])
            sum_ += top[-1][0]
        weight = F.from_json(F.lit(json.dumps({w: x for x, w in top})), "map<string,double>")
        shared = lambda t, top=top, weight=weight: F.aggregate(F.array_intersect(t, words_in([w for _, w in top])), F.lit(0.0), lambda s, w: s + weight[w])
        out = out | (shared(text) >= COSINE**2 - (1 - sum_) - 1e-6)
    return out


def statements(files: DataFrame) -> DataFrame:
    """(id, license, cosine, share, is_file) of each row of (id, text) that is near a whole licence, or has a statement: the whole licence first, then the best statement. Rows are told apart by id.

    Units are the lines of the text, its sentences, runs of up to RUN of either, and the whole text. Inverse document frequencies are
    counted over all texts, for the templates' words; any other word weighs as one that no text has. Units that can't reach the least
    cosine are left early. Comment marks have no words, so that they don't count.
    """
    forms = [(f"{k}/{i}", k, words_of(t)) for k, v in TEMPLATES.items() for i, t in enumerate(v)]
    wholes = [(k, k, words_of(t)) for k, t in whole_licenses().items()]
    vocabulary = sorted({w for *_, words in forms for w in words})  # fixed by TEMPLATES
    every = sorted({w for *_, words in forms + wholes for w in words})
    known = words_in(every)

    texts = files.select("id", F.coalesce("text", F.lit("")).alias("text"))
    had = texts.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(tokens(F.col("text")), known))).alias("word"))
    counted = {r["word"]: r["count"] for r in had.groupBy("word").count().collect()}  # at most the vocabulary; "" counts all texts
    n = counted.pop("", 0)
    idf = {w: _idf(n, counted.get(w, 0)) for w in every}
    unknown = _idf(n, 0)

    lines = runs(F.split("text", "\n"), vocabulary, "\n", True)
    # A sentence goes on over the ends of lines, but not over an empty one.
    sentences = runs(F.split("text", r"(?<=[.!?;:])\s+|\n[ \t\r#*;%!>|/-]*\n"), vocabulary, " ", False)
    units = texts.select("id", F.length("text").alias("size"), F.explode(F.array_union(lines, sentences)).alias("unit"))
    #: Units alike count once: a statement that a third of the texts carry is scored once.
    unit = F.sha2("unit", 256)
    distinct = written(units.groupBy("id", unit.alias("key")).agg(F.first("unit").alias("unit"), F.max("size").alias("size")), "units")
    best = best_of(distinct.groupBy("key").agg(F.first("unit").alias("unit")), forms, {w: idf[w] for w in vocabulary}, unknown)
    hits = distinct.join(small(written(best, "best")), "key").select("id", F.lit(False).alias("is_file"), "cosine", "license", (F.length("unit") / F.col("size")).alias("share"))

    near = texts.where(let(tokens(F.col("text")), lambda t: near_a_whole(t, wholes, idf))).select("id", F.sha2("text", 256).alias("key"), F.col("text").alias("unit"))
    near = written(near, "wholes")
    best = best_of(near.groupBy("key").agg(F.first("unit").alias("unit")), wholes, idf, unknown)
    licences = near.join(small(written(best, "best")), "key").select("id", F.lit(True).alias("is_file"), "cosine", "license", F.lit(1.0).alias("share"))
    both = hits.unionByName(licences)
    return both.groupBy("id").agg(F.max(F.struct("is_file", "cosine", "license", "share")).alias("b")).select("id", "b.license", "b.cosine", "b.share", "b.is_file")


def _idf(n: int, df: int) -> float:
    return log((1 + n) / (1 + df)) + 1


def inherit(files: DataFrame) -> DataFrame:
    """Adds license and license_from to rows of (id, path, own, is_file): a file's own licence, or that of the nearest directory above it with a licence file.

    Of several licence files in a directory, the least path decides. Directories are resolved first, once each, by a join with the
    licences of their ancestors; files then join on their own directory. A null path counts as empty, which is the root.
    """
    f = files.withColumn("dir", F.regexp_replace(F.coalesce("path", F.lit("")), "/?[^/]*$", ""))
    licensed = f.where("is_file and own is not null").groupBy("dir").agg(F.min(F.struct("path", "own")).alias("m")).select(F.col("dir").alias("above"), F.col("m.own").alias("inherited"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, 1, i), "/").alias("above")))
    dirs = f.select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("x")).select("dir", "x.*")
    nearest = dirs.join(licensed, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "inherited")).alias("m")).select("dir", "m.above", "m.inherited")
    out = f.join(nearest, "dir", "left")
    return out.withColumn("license", F.coalesce("own", "inherited")).withColumn("license_from", F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("above"))).drop("dir", "above", "inherited")


def scan(files: DataFrame) -> DataFrame:
    """(id, path, own, cosine, is_file, license, license_from) of rows (id, path, text). Null texts have no licence of their own. Repeated ids share their statements. An empty table gives an empty result."""
    own = statements(files).select(F.col("id"), F.col("license").alias("own"), "cosine", "is_file")
    return inherit(files.select("id", "path").join(own, "id", "left").withColumn("is_file", F.coalesce("is_file", F.lit(False))))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a source is a tree, in which a thousand ids share a directory and a hundred a directory within that.

    Null and empty texts have no licence of their own; a null source is the root. Of equal cosines the licence last in the alphabet
    holds, of several licence files in a directory the least path. Repeated rows get a row each, with the statements of all rows of
    their id; an empty table gives an empty result; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    level = lambda n: (F.col("doc_id") - F.pmod(F.col("doc_id"), F.lit(n))).cast("string")
    path = F.concat_ws("/", "source", level(1000), level(100), F.col("doc_id").cast("string"))
    out = scan(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text"))
    return out.select(F.col("id").alias("doc_id"), "path", "own", "cosine", "is_file", "license", "license_from")
