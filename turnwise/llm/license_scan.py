"""License scans: sparse TF-IDF cosine of text lines to license templates, inherited down directories by path joins.

Only lines with a cue word are scored, each as a sparse vector over the templates'
own terms; how rare a term is, is counted over the cue lines of all documents.
A line is scored whole and in windows around its cue words, each as long as a
template, so what else stands on the line doesn't hide a notice.
The dot products are an equi-join on terms with the template weights, whose size
is the templates'. A file without a license of its own takes that of the nearest
ancestor directory that has a license file, by one equi-join of ancestors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import bounded_broadcast, cut, fits_broadcast, let

#: Least cosine at which a line counts as a template.
LEAST_COSINE = 0.6
#: Names of files whose license holds for their directory and all below.
LICENSE_FILES = ("license", "licence", "copying", "notice")
CUES = r"(?i)licen[cs]e|copyright|rights reserved|public domain|all rights|permission is hereby|redistribution and use|spdx"
#: A single term of a cue: windows are laid around these.
CUE_TERM = r"licen[cs]e|copyright|rights|domain|permission|redistribution|spdx"
#: Weight of a word in a window that no template has, whatever the size of the corpus.
FOREIGN = 4.0
#: Short notices as people put them in headers. Fixed values.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0",
    ],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "EPL-2.0": ["Licensed under the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
    "CC0-1.0": ["This work is dedicated to the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved."],
}


def template_table(spark: SparkSession, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    rows = [(name, f"{name}/{k}", text) for name, texts in templates.items() for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "license string, template string, line string")


def _terms(line: str):
    return F.array_remove(F.split(F.lower(line), r"[^0-9a-z]+"), "")


def _windows(lines: DataFrame, sizes: list[int]) -> DataFrame:
    """row, line, size, window: the runs of ``size`` terms that hold a cue term; a shorter line is its own only window."""

    def around(terms, size):
        last = F.greatest(F.lit(0), F.size(terms) - size)
        cues = F.filter(F.transform(terms, lambda x, i: F.when(x.rlike(CUE_TERM), i)), lambda i: i.isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(cues, lambda i: F.sequence(F.greatest(F.lit(0), i - (size - 1)), F.least(i, last)))))
        return F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), F.array_join(F.slice(terms, i + 1, size), " ").alias("window")))

    found = let(F.col("terms"), lambda terms: F.flatten(F.array(*[around(terms, n) for n in sizes])))
    return lines.select("row", "line", F.explode(found).alias("w")).select("row", "line", "w.size", "w.window")


def _window_lines(lines: DataFrame, weighed: DataFrame, norms: DataFrame, rarity: DataFrame, least: float, small) -> DataFrame:
    """row, line, cosine, size, license: each line's best window that reaches ``least``.

    A window is compared with the templates of its size, and must hold every
    term of the template that no other license has or that is part of the license's
    name: a notice that differs from it just in the name or version is of another license.
    """
    only = weighed.groupBy("term").agg(F.count_distinct("license").alias("licenses"))
    size = weighed.groupBy("template").agg(F.sum("tf").cast("int").alias("size"))
    t = cut(weighed.join(only, "term").join(size, "template").select("term", "license", "template", "size", "w", ((F.col("licenses") == 1) | F.array_contains(_terms("license"), F.col("term"))).cast("int").alias("own")))
    needed = t.groupBy("template").agg(F.sum("own").alias("needed"))
    windows = _windows(lines, sorted(r["size"] for r in size.select("size").distinct().collect()))
    terms = windows.select("size", "window").distinct().select("size", "window", F.explode(F.split("window", " ")).alias("term"))
    counted = terms.groupBy("size", "window", "term").agg(F.count(F.lit(1)).alias("n"))
    vector = cut(counted.join(rarity, "term", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(FOREIGN))))
    norm = vector.groupBy("size", "window").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = vector.join(small(t), ["term", "size"]).groupBy("size", "window", "license", "template")
    dots = dots.agg(F.sum(F.col("x") * F.col("w")).alias("dot"), F.sum("own").alias("held"))
    near = dots.join(small(needed), "template").where("held = needed").join(norms, "template").join(norm, ["size", "window"])
    near = near.withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6)).where(F.col("cosine") >= least)
    best = cut(near.groupBy("size", "window").agg(F.max(F.struct("cosine", "license")).alias("b")))
    hits = windows.join(bounded_broadcast(best, F.octet_length("window")), ["size", "window"])
    b = hits.groupBy("row", "line").agg(F.max(F.struct("b.cosine", "size", "b.license")).alias("b"))
    return b.select("row", "line", "b.cosine", "b.size", "b.license")


def license_lines(files: DataFrame, templates: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """row, line, license, cosine: the best template of each cue line, whole or in a window, that reaches ``least``. ``files``: row, text."""
    lines = files.select("row", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    lines = cut(lines.where(F.col("body").rlike(CUES)).select("row", "line", _terms("body").alias("terms")))
    total = lines.count()
    t = templates.select("license", "template", F.explode(_terms("line")).alias("term")).groupBy("license", "template", "term").agg(F.count(F.lit(1)).alias("tf"))
    t = cut(t)
    # every table of the templates has at most the rows of this one
    small = F.broadcast if fits_broadcast(t, F.octet_length(F.concat("license", "template", "term")) + 64) else (lambda df: df)
    vocabulary = small(t.select("term").distinct())  # the templates' own words
    met = lines.select("row", "line", F.explode("terms").alias("term")).join(vocabulary, "term")
    df = met.select("row", "line", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(total) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0
    weighed = cut(t.join(df, "term", "left").withColumn("w", F.col("tf") * idf).withColumn("idf", idf))
    norms = small(weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm")))
    rarity = small(weighed.select("term", "idf").distinct())
    unknown = F.log(F.lit(total) + 1.0) + 1.0
    counted = lines.select("row", "line", F.explode("terms").alias("term")).groupBy("row", "line", "term").agg(F.count(F.lit(1)).alias("n"))
    vector = counted.join(rarity, "term", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(unknown)))
    own = vector.groupBy("row", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = vector.where("idf is not null").join(small(weighed.select("term", "license", "template", "w")), "term")
    dots = dots.groupBy("row", "line", "license", "template").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    cosine = dots.join(norms, "template").join(own, ["row", "line"]).withColumn("cosine", F.col("dot") / (F.col("norm") * F.col("t_norm")))
    best = F.max(F.struct(F.round("cosine", 6).alias("cosine"), F.col("license")))
    whole = cosine.groupBy("row", "line").agg(best.alias("b")).where(F.col("b.cosine") >= least)
    whole = whole.select("row", "line", "b.cosine", F.lit(1 << 30).alias("size"), "b.license")  # before an equal window
    either = whole.unionByName(_window_lines(lines, weighed, norms, rarity, least, small)).groupBy("row", "line").agg(F.max(F.struct("cosine", "size", "license")).alias("b"))
    return either.select("row", "line", "b.license", "b.cosine")


def license_scan(
    files: DataFrame, templates: DataFrame | None = None, least: float = LEAST_COSINE, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row of ``files`` (path, text): the ``carry`` columns, path, own_license, cosine, n_lines, license, from_path.

    own_license is the template of the row's best line (ties: the last name in
    order); n_lines the lines that reach ``least``. license is own_license or
    else that of the nearest ancestor directory holding a license file, which
    from_path names (of several there, the first path). Null and empty texts have no
    license of their own; a null path inherits nothing; repeated rows each get
    their result; columns that are not carried are ignored.
    """
    templates = template_table(files.sparkSession) if templates is None else templates
    rows = files.select(*carry, "path", "text").withColumn("row", F.xxhash64(F.coalesce("path", F.lit("\x00")), F.coalesce("text", F.lit(""))))
    cued = rows.where(F.col("text").rlike(CUES)).select("row", "text").dropDuplicates(["row"])
    found = license_lines(cued, templates, least)
    best = found.groupBy("row").agg(F.max(F.struct("cosine", "license")).alias("b"), F.count(F.lit(1)).alias("n_lines"))
    own = cut(rows.select(*carry, "path", "row").join(best, "row", "left").select(*carry, "path", F.col("b.license").alias("own_license"), F.col("b.cosine").alias("cosine"), F.coalesce("n_lines", F.lit(0)).alias("n_lines")))
    parts = F.split("path", "/")
    parent = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    name = F.regexp_replace(F.lower(F.element_at(parts, -1)), r"\.[^.]*$", "")
    holders = own.where(name.isin(*LICENSE_FILES) & F.col("own_license").isNotNull())
    holders = holders.groupBy(parent.alias("dir")).agg(F.min(F.struct("path", "own_license")).alias("h"))
    need = own.where("own_license is null and path is not null").select("path").distinct()
    depth = F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1))
    up = need.select("path", F.explode(depth).alias("depth")).select("path", "depth", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), "/").alias("dir"))
    nearest = up.join(holders, "dir").groupBy("path").agg(F.max(F.struct("depth", "h")).alias("n"))
    nearest = nearest.select(F.col("path").alias("_path"), F.col("n.h.own_license").alias("inherited"), F.col("n.h.path").alias("_from"))
    out = own.join(nearest, own["path"] == nearest["_path"], "left")
    taken = F.col("own_license").isNull()
    return out.select(
        *carry, "path", "own_license", "cosine", "n_lines", F.coalesce("own_license", "inherited").alias("license"),
        F.when(taken, F.col("_from")).alias("from_path"),
    )


def as_files(documents: DataFrame) -> DataFrame:
    """Documents as a file tree, doc_id, path, text: <doc_id div 1000>/<doc_id div 100>/<doc_id>.txt.

    The first document of each thousand is <doc_id div 1000>/LICENSE, that of each other hundred the LICENSE of its directory.
    """
    d = F.col("doc_id")
    top, low = F.floor(d / 1000).cast("string"), F.floor(d / 100).cast("string")
    path = (
        F.when(d % 1000 == 0, F.concat(top, F.lit("/LICENSE")))
        .when(d % 100 == 0, F.concat(top, F.lit("/"), low, F.lit("/LICENSE")))
        .otherwise(F.concat(top, F.lit("/"), low, F.lit("/"), d.cast("string"), F.lit(".txt")))
    )
    return documents.select("doc_id", path.alias("path"), "text")
