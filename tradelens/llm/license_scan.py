"""License scans by MinHash bands, DataFrame functions only.

Templates are license notices. A text holds a template if at least 0.8 of the
template's five-word shingles (a template of fewer words is one shingle) lie in one
window of the text.

1. *Overlapping windows.* Templates are put in length classes (powers of two);
   a class has windows of its largest length plus a stride, every stride words
   (a quarter of the class's shortest template), so whatever the place of a notice some
   window holds all of it. Windows without any template shingle have containment
   0 and are not looked at.
2. *MinHash bands.* Windows and templates have one MinHash value per hash function;
   ``bands`` bands of ``rows`` values each are looked up among the templates'. A window
   that holds 0.8 of a template's shingles has Jaccard similarity j of 0.8 t / (w + 0.2 t)
   at least (t, w: shingles of template and window). The windows make w at most 3 t
   (4 t for a template that is one shingle, and there all of it is held), so j >= 0.25;
   with 64 bands of 1 row the miss probability is (1 - j) ** 64 < 2e-8.
3. *Verification.* Exact containment on the shingles' text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import cut, limited, small_or_shuffled, text_or_empty
from tradelens.llm.decontaminate import shingle_hashes, shingle_texts, word_array

# Public license and proprietary notices: the name or sentence by which a
# work names its license, SPDX lines, headers and opening passages of the license texts.
# Notices of sibling licenses (versions, variants) share most words, so a template that
# names a version is so short that a sibling's notice holds less than 0.8 of it.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-title": "The MIT License (MIT)",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-title": "Apache License Version 2.0, January 2004",
    "Apache-2.0-header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."),
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-2.0-v": "GNU General Public License v2",
    "GPL-2.0-header": (
        "terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    "GPL-3.0": "GNU General Public License, version 3",
    "GPL-3.0-v": "GNU General Public License v3",
    "GPL-3.0-header": (
        "terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-2.1-v": "GNU Lesser General Public License v2.1",
    "LGPL-2.1-header": (
        "of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "LGPL-3.0-v": "GNU Lesser General Public License v3",
    "LGPL-3.0-header": (
        "of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "AGPL-3.0-v": "GNU Affero General Public License v3",
    "AGPL-3.0-header": (
        "of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "MPL-2.0": "Mozilla Public License, version 2.0",
    "MPL-2.0-v": "Mozilla Public License, v. 2.0",
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at"),
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "BSD-3-Clause-text": (
        "nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission"),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer."),
    "ISC": "Licensed under the ISC License.",
    "ISC-title": "ISC License (ISC)",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Public-domain": "released into the public domain",
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at"),
    "BSL-1.0": "Boost Software License, Version 1.0",
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software."),
    "CC0-1.0": "CC0 1.0 Universal",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0-name": "Creative Commons Attribution 4.0 International",
    "CC-BY-SA-4.0-name": "Creative Commons Attribution-ShareAlike 4.0 International",
    "CC-BY-ND-4.0-name": "Creative Commons Attribution-NoDerivatives 4.0 International",
    "CC-BY-NC-4.0-name": "Creative Commons Attribution-NonCommercial 4.0 International",
    "CC-BY-NC-SA-4.0-name": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International",
    "CC-BY-NC-ND-4.0-name": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International",
    "All-rights-reserved": "All rights reserved.",
    "Proprietary": "Proprietary and confidential",
    "Confidential": "Confidential and proprietary",
    "No-copying": "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    "No-reproduction": "No part of this publication may be reproduced",
    # One of a version finds its -only and -or-later forms too.
    **{f"SPDX-{name}": f"SPDX-License-Identifier: {name}" for name in (
        "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause",
        "BSD-3-Clause", "ISC", "0BSD", "Unlicense", "EPL-2.0", "BSL-1.0", "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
        "CC-BY-ND-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0")},
}


def default_templates(spark) -> DataFrame:
    return spark.createDataFrame(list(NOTICES.items()), "template_id string, text string")


def _minhashes(hashes: Column, count: int) -> Column:
    return F.array(*[F.array_min(F.transform(hashes, _seeded(k))) for k in range(count)])


def _seeded(k: int):
    return lambda h: F.xxhash64(h, F.lit(k))


def _band_keys(hashes: Column, bands: int, rows: int) -> Column:
    minima = _minhashes(hashes, bands * rows)
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(
        b.alias("band"), F.xxhash64(F.slice(minima, b * rows + 1, rows)).alias("key")))


def _class_of(words: str) -> Column:
    """The largest power of two that is no more than a column's value."""
    return F.expr(f"shiftleft(1, cast(floor(log2({words})) as int))")


def _placed(n: int, openings: list[str] | None) -> Column:
    """(pos, hash) of the n-word shingles of column ``w`` that begin with one of
    ``openings`` (no other can be a template's); of all if that is None."""
    at = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
    if openings is not None:
        at = F.filter(at, lambda i: F.get("w", i).isin(openings))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get("w", i + k) for k in range(n)]).alias("hash")))


def scan(docs: DataFrame, templates: DataFrame, shingle: int = 5, containment: float = 0.8, bands: int = 64,
         rows: int = 1, max_broadcast_rows: int = 1_000_000, max_openings: int = 10_000) -> DataFrame:
    """One row per (doc_id, template_id) found: the best window's ``start`` and
    ``n_words``, and ``containment``; of equals the first. ``docs`` needs doc_id and
    text, ``templates`` template_id and text; other columns are ignored.

    Null or empty texts hold nothing, wordless templates are never found. Rows that
    repeat a doc_id count as one document with several texts. Empty tables
    give no rows.
    """
    size = F.size("w")
    prepared = (templates.select("template_id", word_array(text_or_empty()).alias("w")).where(size > 0)
                .select("template_id", size.alias("item_words"), "w", F.least(size, F.lit(shingle)).alias("n")))
    # A template shorter than a shingle is looked for as one shingle of its own length.
    lengths = sorted(r["n"] for r in prepared.select("n").distinct().collect())
    texts = [prepared.where(F.col("n") == n).select("template_id", "item_words", "n", _class_of("item_words").alias("class"),
             F.array_distinct(shingle_texts(F.col("w"), n)).alias("item_shingles"),
             F.array_distinct(shingle_hashes(F.col("w"), n)).alias("hashes")) for n in lengths]
    if not texts:
        return _empty(docs)
    items = cut(_union(texts))
    anchors = cut(items.select("n", "class", F.explode("hashes").alias("hash")).distinct())

    # 1. windows of the classes' grids that hold a template shingle
    worded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_key"), word_array(F.col("text")).alias("w"))
    keys = ["doc_id", "text_key"]
    opening = items.select(F.explode("item_shingles").alias("s")).select(F.split_part("s", F.lit(" "), F.lit(1)).alias("word")).distinct()
    openings = [r["word"] for r in opening.limit(max_openings + 1).collect()]
    listed = [worded.select(*keys, F.lit(n).alias("n"), F.explode(_placed(n, openings if len(openings) <= max_openings else None)).alias("p"))
              .select(*keys, "n", "p.pos", "p.hash") for n in lengths]
    hits = _union(listed).join(small_or_shuffled(anchors, max_broadcast_rows), ["n", "hash"])
    stride = F.greatest(F.floor(F.col("class") / 4), F.lit(1)).cast("int")
    width = F.col("class") * 2 - 1 + stride - 1
    first = F.greatest(F.ceil((F.col("pos") + F.col("n") - F.col("width")) / F.col("stride")), F.lit(0)).cast("int")
    wanted = (hits.select(*keys, "n", "pos", stride.alias("stride"), width.alias("width"))
              .select(*keys, "n", "width", F.explode(F.sequence(first, F.floor(F.col("pos") / F.col("stride")).cast("int"))).alias("k"), "stride")
              .select(*keys, F.struct((F.col("k") * F.col("stride")).alias("start"), "width", "n").alias("window")))
    wanted = cut(wanted.groupBy(*keys).agg(F.collect_set("window").alias("windows")))

    # 2. bands
    renamed = limited(wanted.withColumnsRenamed({k: f"_{k}" for k in keys}), F.size("windows"), max_broadcast_rows)
    windows = (worded.join(renamed, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")))
               .dropDuplicates(keys)
               .select(*keys, "w", F.explode("windows").alias("window"))
               .select(*keys, "window.start", "window.n", F.slice("w", F.col("window.start") + 1, F.col("window.width")).alias("w")))
    windows = cut(_union([windows.where(F.col("n") == n).select(
        *keys, "start", "n", F.size("w").alias("n_words"), F.array_distinct(shingle_texts(F.col("w"), n)).alias("shingles"),
        F.array_distinct(shingle_hashes(F.col("w"), n)).alias("hashes")) for n in lengths])
        .select("*", _band_keys(F.col("hashes"), bands, rows).alias("bands")).drop("hashes"))
    probes = cut(items.select("template_id", "n", F.explode(_band_keys(F.col("hashes"), bands, rows)).alias("b"))
                 .select("template_id", "n", "b.band", "b.key"))
    place = [*keys, "start", "n", "n_words"]
    pairs = (windows.select(*place, F.explode("bands").alias("b")).select(*place, "b.band", "b.key")
             .join(small_or_shuffled(probes, max_broadcast_rows), ["n", "band", "key"])
             .select(*place, "template_id").distinct())

    # 3. verification
    shared = F.size(F.array_intersect("shingles", "item_shingles")) / F.size("item_shingles")
    verified = (pairs.withColumnsRenamed({k: f"_{k}" for k in place})
                .join(windows, F.col("doc_id").eqNullSafe(F.col("_doc_id"))
                      & (F.col("text_key") == F.col("_text_key")) & (F.col("start") == F.col("_start"))
                      & (F.col("n") == F.col("_n")) & (F.col("n_words") == F.col("_n_words")))
                .join(small_or_shuffled(items.select("template_id", "item_shingles"), max_broadcast_rows // 10), "template_id")
                .select("doc_id", "template_id", "start", "n_words", shared.alias("containment"))
                .where(F.col("containment") >= containment))
    best = F.max_by(F.struct("start", "n_words", "containment"), F.struct("containment", -F.col("start"), -F.col("n_words")))
    return verified.groupBy("doc_id", "template_id").agg(best.alias("best")).select(
        "doc_id", "template_id", F.col("best.start").cast("long").alias("start"),
        F.col("best.n_words").cast("long").alias("n_words"), "best.containment")


def _empty(docs: DataFrame) -> DataFrame:
    return docs.limit(0).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("template_id"),
                                F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_words"),
                                F.lit(0.0).alias("containment"))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
