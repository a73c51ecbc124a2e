"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line of every text (a header line, or a line of a licence file) is compared with the templates. Terms are runs of [a-z0-9]
after lower-casing A-Z; weights are tf x ln(1 + N / df) over the N templates, a term in no template weighs ln(1 + N). A
line's licence is the template with the largest cosine, SIMILAR at least; a file's is that of its best line. Lines
without an anchor term are skipped before any scoring: by the Cauchy-Schwarz inequality the other terms alone cannot reach
SIMILAR, which is checked when the templates are read.

Passages (headers, titles, SPDX tags, openings of bodies, and the phrases above) are looked for in the whole text's terms, over
line ends and comment signs: at each place where the text has the passage's key term, the block of as many terms as the
passage has, laid so that the key terms meet, is compared with it by the same cosine, with the passages' own weights. A
text's licence is that of its best line or block; of equal cosines the longer passage's. Names without a version (gpl,
lgpl) stand for passages that tell none.

A file whose base name is that of a licence file gives its licence to its directory. Files without one of their own
take that of the nearest ancestor directory: distinct directories are expanded to their ancestors and joined by path.

Defined cases. Null or empty text: no licence of its own. Null path: no directory, nothing inherited. Ties: within a
line the first template, among a text's lines and blocks of equal cosine the longer passage, then the larger name, among a directory's
licence files of equal cosine the smaller name. Repeated rows: one result row each. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, stored

SIMILAR = 0.8
#: (licence, phrase)
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd-2-clause", "Licensed under the BSD 2-Clause License"),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Released under the ISC License"),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Released under the MIT License"),
    ("mpl-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
)
_GNU, _FSF = "under the terms of the GNU {} as published by the Free Software Foundation", "either version {} of the License"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_SPDX = {
    "apache-2.0": ["Apache-2.0"], "bsd-2-clause": ["BSD-2-Clause"], "bsd-3-clause": ["BSD-3-Clause"], "cc-by-4.0": ["CC-BY-4.0"], "cc-by-nc-4.0": ["CC-BY-NC-4.0"],
    "cc-by-sa-4.0": ["CC-BY-SA-4.0"], "cc0-1.0": ["CC0-1.0"], "gpl-2.0": ["GPL-2.0"], "gpl-3.0": ["GPL-3.0"], "isc": ["ISC"], "lgpl-3.0": ["LGPL-3.0"], "mit": ["MIT"], "mpl-2.0": ["MPL-2.0"],
}
#: (licence, passage), for blocks of terms that lines do not bound
PASSAGES = (
    *TEMPLATES,
    *((name, f"SPDX-License-Identifier: {tag}") for name, tags in _SPDX.items() for tag in tags),
    ("apache-2.0", "Apache License Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("bsd-2-clause", _BSD),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("cc0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("gpl", "GNU General Public License"),
    ("gpl", _GNU.format("General Public License")),
    *((f"gpl-{v}.0", f"{_GNU.format('General Public License')}; {_FSF.format(v)}") for v in (2, 3)),
    *((f"gpl-{v}.0", f"GNU General Public License version {v}") for v in (2, 3)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "GNU Lesser General Public License"),
    ("lgpl", _GNU.format("Lesser General Public License")),
    ("lgpl-3.0", f"{_GNU.format('Lesser General Public License')}; {_FSF.format(3)}"),
    ("lgpl-3.0", "GNU Lesser General Public License version 3"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "Mozilla Public License Version 2.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
#: Key terms, rarest in other prose first; a passage's is the first that it holds.
KEYS = ("spdx", "apache", "mozilla", "gnu", "cc0", "endorse", "redistribution", "permission", "license", "licensed")
#: Frequent words, which are no anchors.
COMMON = frozenset("the of to this is in and under by".split())
LICENCE_FILES = r"(?i)(^|/)(licen[sc]e|copying|notice)([.-][^/]*)?$"


def terms(phrase: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", phrase.lower())


class Weights:
    """The templates as arrays over their vocabulary (both of fixed size)."""

    def __init__(self, templates=TEMPLATES, similar: float = SIMILAR):
        own = [(name, terms(t)) for name, t in templates]
        self.names, self.vocabulary, n = [x for x, _ in own], sorted({w for _, t in own for w in t}), len(own)
        self.idf = [log(1 + n / sum(v in t for _, t in own)) for v in self.vocabulary]
        self.other = log(1 + n)
        self.rows = [[t.count(v) * i for v, i in zip(self.vocabulary, self.idf, strict=True)] for _, t in own]
        self.norms = [sqrt(sum(x * x for x in r)) for r in self.rows]
        self.anchors = [v for v in self.vocabulary if v not in COMMON]
        for name, r, norm in zip(self.names, self.rows, self.norms, strict=True):
            rest = sqrt(sum(x * x for v, x in zip(self.vocabulary, r, strict=True) if v in COMMON)) / norm
            if rest >= similar:
                raise ValueError(f"{name}: its frequent words alone reach {rest:.2f}")

    def anchored(self, text: Column) -> Column:
        return text.rlike(f"(?i)(?<![a-z0-9])(?:{'|'.join(self.anchors)})(?![a-z0-9])")

    def best(self, line: Column) -> Column:
        """struct(score, name) of the line's best template."""
        words = F.filter(F.split(ascii_lower(line), "[^a-z0-9]+"), lambda w: w != "")
        vocabulary = F.array(*map(F.lit, self.vocabulary))
        idf = F.array(*map(F.lit, self.idf))

        def of(w):
            tf = F.transform(vocabulary, lambda v, i: F.size(F.filter(w, lambda x: x == v)) * F.get(idf, i))
            strange = F.sort_array(F.filter(w, lambda x: ~F.array_contains(vocabulary, x)))
            start = F.struct(F.lit("").alias("w"), F.lit(0).alias("run"), F.lit(0).alias("sum"))
            squares = F.aggregate(
                strange, start,
                lambda a, x: F.when(x == a["w"], F.struct(x.alias("w"), (a["run"] + 1).alias("run"), (a["sum"] + 2 * a["run"] + 1).alias("sum"))).otherwise(F.struct(x.alias("w"), F.lit(1).alias("run"), (a["sum"] + 1).alias("sum"))),
                lambda a: a["sum"],
            )

            def scores(x):
                norm = F.sqrt(F.aggregate(x["tf"], F.lit(0.0), lambda a, y: a + y * y) + x["squares"] * self.other**2)
                each = [F.struct((F.aggregate(F.zip_with(x["tf"], F.array(*map(F.lit, r)), lambda p, q: p * q), F.lit(0.0), lambda a, y: a + y) / (norm * n)).alias("score"), F.lit(-k).alias("k")) for k, (r, n) in enumerate(zip(self.rows, self.norms, strict=True))]
                return F.array_max(F.array(*each))

            return let(F.struct(tf.alias("tf"), squares.alias("squares")), scores)

        top = let(words, of)
        return let(top, lambda s: F.struct(s["score"].alias("score"), F.get(F.array(*map(F.lit, self.names)), -s["k"]).alias("name")))


class Passages:
    """Passages by key term, over the whole text."""

    def __init__(self, passages=PASSAGES):
        own, n = [(name, terms(t)) for name, t in passages], len(passages)
        idf = {v: log(1 + n / sum(v in t for _, t in own)) for v in sorted({w for _, t in own for w in t})}
        self.names, self.other, self.squares = [name for name, _ in own], log(1 + n) ** 2, {v: x * x for v, x in idf.items()}
        self.keys, self.lengths, self.norms, self.weights = {}, [len(t) for _, t in own], [], []
        for k, (name, t) in enumerate(own):
            key = next((x for x in KEYS if x in t), None)
            if key is None:
                raise ValueError(f"{name}: a passage without a key term")
            self.keys.setdefault(key, []).extend((at, k) for at, x in enumerate(t) if x == key)
            self.weights.append({v: t.count(v) * self.squares[v] for v in t})
            self.norms.append(sqrt(sum(t.count(v) * self.squares[v] for v in t)))

    def keyed(self, text: Column) -> Column:
        return text.rlike(f"(?i)(?<![a-z0-9])(?:{'|'.join(self.keys)})(?![a-z0-9])")

    def best(self, text: Column) -> Column:
        """struct(score, size, name) of the text's best block; null where no block has all its terms."""
        as_map = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
        laid = F.create_map(*(x for key, at in self.keys.items() for x in (F.lit(key), F.array(*(F.struct(F.lit(a).alias("at"), F.lit(k).alias("k")) for a, k in at)))))
        squares, weights = as_map(self.squares), F.array(*map(as_map, self.weights))
        keys, lengths, norms, names = (F.array(*map(F.lit, x)) for x in (self.keys, self.lengths, self.norms, self.names))

        def scored(x):
            block, of = x["block"], F.get(weights, x["k"])
            dot = F.aggregate(block, F.lit(0.0), lambda a, y: a + F.coalesce(F.element_at(of, y), F.lit(0.0)))
            norm = F.aggregate(block, F.lit(0.0), lambda a, y: a + F.size(F.filter(block, lambda z: z == y)) * F.coalesce(F.element_at(squares, y), F.lit(self.other)))
            return F.struct(F.round(dot / (F.sqrt(norm) * F.get(norms, x["k"])), 9).alias("score"), F.get(lengths, x["k"]).alias("size"), F.get(names, x["k"]).alias("name"))

        def of(w):
            # first lambda: places of key terms; then the passages of that term whose block lies within the text
            places = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: F.array_contains(keys, p["x"]))
            blocks = F.flatten(F.transform(places, lambda p: F.transform(F.filter(F.element_at(laid, p["x"]), lambda q: (p["i"] >= q["at"]) & (p["i"] - q["at"] + F.get(lengths, q["k"]) <= F.size(w))), lambda q: F.struct(F.slice(w, p["i"] - q["at"] + 1, F.get(lengths, q["k"])).alias("block"), q["k"].alias("k")))))
            best = F.array_max(F.transform(blocks, lambda x: let(scored(x), lambda r: F.struct(r["score"].alias("score"), r["size"].alias("size"), r["name"].alias("name")))))
            return best

        return let(F.filter(F.split(ascii_lower(text), "[^a-z0-9]+"), lambda x: x != ""), of)


def _parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).when(path.isNotNull(), F.lit(""))


def scan(files: DataFrame, key: str, path: str = "path", text: str = "text", weights: Weights | None = None, passages: Passages | None = None) -> DataFrame:
    """(key, path, own, score, license, origin) for each row of files; origin is own, inherited or null."""
    w, whole = weights or Weights(), passages or Passages()
    rows = files.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(text).alias("t"))
    # the part of the row that is scored is a struct found within the row: no shuffle of texts, no joins by row
    lines = F.filter(F.split("t", "\n", -1), lambda x: w.anchored(x))
    best = F.when(w.anchored(F.col("t")), F.array_max(F.transform(lines, lambda x: let(w.best(x), lambda b: F.struct(b["score"].alias("score"), F.lit(0).alias("z"), b["name"].alias("name"))))))
    block = F.when(whole.keyed(F.col("t")), whole.best(F.col("t")))
    rows = rows.select("k", "p", F.struct(F.coalesce(best["score"], F.lit(0.0)).alias("score"), best["name"].alias("name")).alias("line"), block.alias("block"))
    # the line's score has not been rounded; a block of the same cosine is the longer passage, as lines are templates
    b = F.when(F.col("block.score") >= F.round("line.score", 9), F.struct(F.col("block.score").alias("score"), F.col("block.name").alias("name"))).otherwise(F.col("line"))
    rows = rows.select("k", "p", b.alias("b")).select("k", "p", F.when(F.col("b.score") >= SIMILAR, F.col("b.name")).alias("own"), F.when(F.col("b.score") >= SIMILAR, F.col("b.score")).alias("score"))
    rows = stored(rows.withColumn("dir", _parent(F.col("p"))), "license-lines")  # texts are read once; four columns for the joins
    named = rows.where(F.col("p").rlike(LICENCE_FILES) & F.col("own").isNotNull())
    given = named.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("own").alias("name"))).alias("g")).select(F.col("dir").alias("ancestor"), F.col("g.name").alias("given"))
    steps = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    dirs = rows.where("own is null and dir is not null").select("dir").distinct()
    above = dirs.select("dir", F.explode(F.array_distinct(F.concat(up, F.array("dir")))).alias("ancestor"))
    nearest = above.join(given, "ancestor").groupBy("dir").agg(F.max_by("given", F.length("ancestor")).alias("given")).withColumnRenamed("dir", "n_dir")
    out = rows.join(nearest, F.col("dir") == F.col("n_dir"), "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited")
    return out.select(F.col("k").alias(key), F.col("p").alias("path"), "own", "score", F.coalesce("own", "given").alias("license"), origin.alias("origin"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files: a short text with a line about a licence is the licence file of its directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = (F.octet_length("text") < 800) & F.col("text").rlike("(?i)licen[sc]e")
    name = F.concat(F.when(short, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")), F.lit(".txt"))
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 64).cast("string"), name)
    return scan(docs.select("doc_id", path.alias("path"), "text"), "doc_id")
