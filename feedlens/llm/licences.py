"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Files are (path, text). Every line of a file, every paragraph (of a longer one, every window of `PARAGRAPH` lines
from every half of that) and every whole text, however long, is compared with each notice by the cosine of sparse TF-IDF vectors, whole texts
also with the full licence texts. A line or paragraph over `HEADER` gives the file its own licence. A file
whose whole text is over `WHOLE` is a licence file: it also gives its directory that licence. A text over
`WHOLE` of a full licence has that one, whatever notices it quotes. A file without a licence
of its own takes that of the nearest ancestor directory that has one. Directories are joined with
their ancestors' paths; files meet only their own directory's result.

Document frequencies of the templates' words are counted over all texts; a word that no template has
counts as rare. However common its words are, a text is compared unless its template words' share of its
length, which no cosine can exceed (Cauchy-Schwarz), is below what is already found.

Edge cases: null and empty texts have no licence of their own; a null path is in the root directory;
ties go to the higher cosine, then the first licence by name, then the first path; an empty table gives
no rows; repeated rows are scanned alike; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_summary, settle
from .licence_texts import TEXTS

HEADER, WHOLE = 0.6, 0.6
PARAGRAPH = 40

#: Licence names with notices as authors write them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation; either version 2"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the "
                 "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                 "GNU Affero General Public License as published by the Free Software Foundation, either version 3"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    *[(name, f"SPDX-License-Identifier: {short}") for name, short in [
        ("Apache-2.0", "Apache-2.0"), ("MIT", "MIT"), ("ISC", "ISC"), ("BSD-2-Clause", "BSD-2-Clause"),
        ("BSD-3-Clause", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0"), ("GPL-2.0", "GPL-2.0-only"),
        ("GPL-2.0", "GPL-2.0-or-later"), ("GPL-2.0", "GPL-2.0"), ("GPL-3.0", "GPL-3.0-only"),
        ("GPL-3.0", "GPL-3.0-or-later"), ("GPL-3.0", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1-only"),
        ("LGPL-2.1", "LGPL-2.1-or-later"), ("LGPL-3.0", "LGPL-3.0-or-later"), ("AGPL-3.0", "AGPL-3.0-only"),
        ("AGPL-3.0", "AGPL-3.0-or-later"), ("CC0-1.0", "CC0-1.0"), ("CC-BY-4.0", "CC-BY-4.0")]],
]

_words = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*").findall


#: A licence identifier is one word with its name, so that another name is another word.
_identifier = re.compile(r"spdx-license-identifier:[ \t]*")


def words(text: str | None) -> list[str]:
    low = (text or "").lower()
    return _words(_identifier.sub("spdx-license-identifier.", low) if "spdx-" in low else low)


class Matcher:
    """Cosines to the templates under document frequencies `df` of `n` texts; `full` is for whole texts only."""

    def __init__(self, templates: list[tuple[str, str]], df: dict[str, int], n: int, full: list[tuple[str, str]] = ()):
        self.rare = math.log(1 + n) + 1
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for _, t in templates for w in words(t)}
        self.names, self.postings = [], {}
        for k, (name, text) in enumerate(templates):
            v = {w: f * self.idf[w] for w, f in Counter(words(text)).items()}
            size = math.sqrt(sum(x * x for x in v.values()))
            self.names.append(name)
            for w, x in v.items():
                self.postings.setdefault(w, []).append((k, x / size))
        self.full = Matcher(full, df, n) if full else None

    def best(self, w: list[str], above: float = 0.0) -> tuple[float, str]:
        """The highest cosine and its licence; (0, "") if none can exceed `above`."""
        every = known = 0.0
        hits = []
        for x, f in Counter(w).items():
            got = self.postings.get(x)
            if got is None:
                every += (f * self.rare) ** 2
            else:
                v = f * self.idf[x]
                known += v * v
                hits.append((v, got))
        every += known
        if known <= above * above * every:
            return 0.0, ""
        dot = [0.0] * len(self.names)
        for v, got in hits:
            for k, x in got:
                dot[k] += v * x
        size = math.sqrt(every)
        return min(((d / size, name) for d, name in zip(dot, self.names)), key=lambda s: (-s[0], s[1]))

    def scan(self, text: str | None) -> tuple[str | None, float, bool]:
        """(licence, cosine, is a licence file) of a text; the best cosine is given in any case."""
        top: tuple[float, str] = (0.0, "")
        every: list[str] = []
        paragraph: list[list[str]] = []  # of its lines, those not yet compared with what comes behind them
        fresh = 0

        def better(w: list[str]) -> tuple[float, str]:
            return max(top, self.best(w, top[0]), key=lambda s: s[0])

        for line in (text or "").split("\n"):
            w = words(line)
            if not w or len(paragraph) >= PARAGRAPH:
                top = better(sum(paragraph, [])) if fresh and len(paragraph) > 1 else top
                paragraph, fresh = paragraph[PARAGRAPH // 2:] if w else [], 0
            if w:
                top = better(w)
                every += w
                paragraph.append(w)
                fresh += 1
        top = better(sum(paragraph, [])) if fresh and len(paragraph) > 1 else top
        if self.full:
            whole = self.full.best(every, min(top[0], WHOLE - 1e-9))
            if whole[0] >= WHOLE:
                return whole[1], whole[0], True
            top = max(top, whole, key=lambda s: s[0])
        whole = self.best(every, min(top[0], WHOLE - 1e-9))
        top = max(top, whole, key=lambda s: s[0])
        return (top[1] if top[0] >= HEADER else None), top[0], whole[0] >= WHOLE


def _frequencies(batches: Iterator[pa.RecordBatch], vocabulary: frozenset) -> Iterator[pa.RecordBatch]:
    count: Counter = Counter()
    for b in batches:
        for t in b.column(0):
            count.update(vocabulary.intersection(words(t.as_py())))
            count[""] += 1
    if count:
        yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], names=["word", "n"])


def matcher(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, full: list[tuple[str, str]] = TEXTS) -> Matcher:
    """Counts, over all texts, in how many each template word occurs (collected: that vocabulary)."""
    vocabulary = frozenset(w for _, t in [*templates, *full] for w in words(t))
    got = (files.select("text").mapInArrow(partial(_frequencies, vocabulary=vocabulary), "word string, n long")
           .groupBy("word").agg(F.sum("n").alias("n")).collect())
    df = {r["word"]: r["n"] for r in got}
    return Matcher(templates, df, df.pop("", 0), full)


def as_files(docs: DataFrame) -> DataFrame:
    """`docs` as files `source/lang/doc_id`; a missing part is `_`."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit("_")) for c in ("source", "lang", "doc_id")]
    return docs.withColumn("path", F.concat_ws("/", *part))


def _directory(path):
    """All before the last slash, empty for the root."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"/?[^/]*$", "")


def scan(files: DataFrame, id_col: str, templates: list[tuple[str, str]] = TEMPLATES,
         full: list[tuple[str, str]] = TEXTS) -> DataFrame:
    """id, path, own licence and cosine, is_licence_file, inherited licence and from where, licence."""
    m = matcher(files, templates, full)
    shared = files.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.scan(t.as_py()) for t in b.column(2)]
            cols = list(zip(*got)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()),
                 pa.array(cols[2], pa.bool_())], names=["id", "path", "own_licence", "cosine", "is_licence_file"])
    own = settle(files.select(F.col(id_col).cast("long").alias("id"), "path", "text").mapInArrow(
        run, "id long, path string, own_licence string, cosine double, is_licence_file boolean")
        .withColumn("directory", _directory(F.col("path"))))

    first = Window.partitionBy("directory").orderBy(F.desc("cosine"), "own_licence", "path")
    given = (own.filter("is_licence_file and own_licence is not null")
             .withColumn("nth", F.row_number().over(first)).filter("nth = 1")
             .select(F.col("directory").alias("inherited_from"), F.col("own_licence").alias("inherited_licence")))
    depth = F.size(F.split("directory", "/"))
    upto = F.transform(F.sequence(F.lit(0), depth),
                       lambda k: F.array_join(F.slice(F.split("directory", "/"), 1, k), "/"))
    above = own.select("directory").distinct().select("directory", F.explode(F.array_distinct(upto)).alias("inherited_from"))
    nearest = Window.partitionBy("directory").orderBy(F.desc(F.length("inherited_from")))
    found = settle(above.join(given, "inherited_from").withColumn("nth", F.row_number().over(nearest)).filter("nth = 1")
                   .select("directory", "inherited_from", "inherited_licence"))
    every = settle(own.select("directory").distinct().join(found, "directory", "left"))
    out = join_summary(own, every, ["directory"])
    inherits = F.col("own_licence").isNull() & F.col("inherited_licence").isNotNull()
    return out.select(F.col("id").alias(id_col), "path", "own_licence", "cosine", "is_licence_file",
                      F.when(inherits, F.col("inherited_from")).alias("inherited_from"),
                      F.coalesce("own_licence", "inherited_licence").alias("licence"))
