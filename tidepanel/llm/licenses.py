"""License scans with DataFrame functions only: MinHash bands over overlapping windows, then exact containment.

A template of T shingles is looked for in windows of its size class: w >= 4 T / 3 shingles, w / 4 apart, so that some
window holds every place a template can be. Such a window's similarity to a template of which ``percent`` of the
shingles are there is at least p = c T / (w + (1 - c) T); each band is one MinHash, and the number of bands makes
(1 - p) ** bands at most ``miss``. Windows and templates that share a band are counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORDS = 5
PERCENT = 75
MISS = 1e-4

# Wording of public licenses and of their usual notices.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution."),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
}

_BSD_2 = TEMPLATES["BSD-2-Clause"]
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
        "the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
_GNU_ONLY = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version "
             "{version} as published by the Free Software Foundation.")
_GNU_LINE = "This work is licensed under the GNU {name}, version {version}."
_GNU_LIBRARY = _GNU.replace("This program", "This library")
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
_CC_LINE = "This work is licensed under a Creative Commons {name} {version} International License."
# Wording of neighbouring licenses and versions, so that none is taken for another.
NEIGHBOURS = {
    "GPL-2.0-or-later": _GNU.format(name=_GPL, version="2"),
    "LGPL-2.1-or-later": _GNU_LIBRARY.format(name=_LGPL, version="2.1"),
    "LGPL-3.0-or-later": _GNU.format(name=_LGPL, version="3"),
    "AGPL-3.0-or-later": _GNU.format(name=_AGPL, version="3"),
    "GPL-2.0-only": _GNU_ONLY.format(name=_GPL, version="2"),
    "GPL-3.0-only": _GNU_ONLY.format(name=_GPL, version="3"),
    "GPL-2.0-line": _GNU_LINE.format(name=_GPL, version="2"),
    "LGPL-2.1-line": _GNU_LINE.format(name=_LGPL, version="2.1"),
    "LGPL-3.0-line": _GNU_LINE.format(name=_LGPL, version="3"),
    "AGPL-3.0-line": _GNU_LINE.format(name=_AGPL, version="3"),
    "BSD-3-Clause": (
        f"{_BSD_2} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."),
    "BSD-3-Clause-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide. This software is distributed without any warranty. You should have "
        "received a copy of the CC0 Public Domain Dedication along with this software. If not, see "
        "http://creativecommons.org/publicdomain/zero/1.0/."),
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0": _CC_LINE.format(name="Attribution", version="4.0"),
    "CC-BY-SA-4.0": _CC_LINE.format(name="Attribution-ShareAlike", version="4.0"),
    "CC-BY-ND-4.0": _CC_LINE.format(name="Attribution-NoDerivatives", version="4.0"),
    "CC-BY-NC-4.0": _CC_LINE.format(name="Attribution-NonCommercial", version="4.0"),
    "CC-BY-NC-SA-4.0": _CC_LINE.format(name="Attribution-NonCommercial-ShareAlike", version="4.0"),
    "CC-BY-NC-ND-4.0": _CC_LINE.format(name="Attribution-NonCommercial-NoDerivatives", version="4.0"),
    "EPL-1.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 "
        "which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."),
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions"),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "MPL-1.1": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use "
        "this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
}

_SHINGLES = (
    "transform(array(filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')), "
    "w -> transform(if(size(w) < {n}, array_repeat(0, 0), sequence(0, size(w) - {n})), i -> xxhash64({parts})))[0]")


def shingles(text: str, n: int = WORDS) -> Column:
    """Hashes of the runs of ``n`` words (letters and digits, lower case), in text order."""
    return F.expr(_SHINGLES.format(text=f"coalesce({text}, '')", n=n, parts=", ".join(f"w[i + {k}]" for k in range(n))))


def window_size(count: int) -> tuple[int, int]:
    """(window, step) in shingles for templates of ``count`` shingles; classes are a third apart."""
    size = 1
    while size - max(1, size // 4) + 1 < count:
        size = max(size + 1, size * 4 // 3)
    return size, max(1, size // 4)


def band_count(count: int, size: int, percent: int = PERCENT, miss: float = MISS) -> int:
    there = math.ceil(count * percent / 100)
    p = there / (size + count - there)
    return 1 if p >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-p)))


def _band_keys(items: str, bands: int) -> str:
    """MinHash values: the least shingle hash under ``bands`` seeds, each with its band's number in the key."""
    return f"transform(sequence(1, {bands}), b -> xxhash64(b, array_min(transform({items}, s -> xxhash64(s, b)))))"


def template_table(spark: SparkSession, templates: dict[str, str], percent: int, miss: float) -> DataFrame:
    """(license, items, n, size, step, bands) of the templates that have a shingle."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    found = rows.select("license", F.array_distinct(shingles("text")).alias("items")).where("size(items) > 0").collect()
    out = []
    for r in found:
        size, step = window_size(len(r["items"]))
        out.append((r["license"], r["items"], len(r["items"]), size, step, band_count(len(r["items"]), size, percent, miss)))
    return spark.createDataFrame(out, "license string, items array<long>, n int, size int, step int, bands int")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                 percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """(id, license, shared, n_shingles, containment, first_word): templates of which at least ``percent`` of the
    five-word shingles stand in one window of the document, with the best window (the first among equals). Where
    windows claim the same shingles of a document, the template of which more is there counts, then the longer one: a
    window whose shingles are mostly another template's is none.

    Templates are a dictionary that the caller holds in memory, so their size is bounded by the driver's; they are the
    only side that is broadcast. Only windows with some template shingle are made: without one no window can hold a
    template. Null and empty texts and texts of fewer than five words match nothing, nor do templates of fewer
    than five words. Rows without an id are left out; documents that come twice give the same rows once.
    Other columns are ignored; an empty table or no templates give an empty result.
    """
    spark = docs.sparkSession
    table = template_table(spark, TEMPLATES | NEIGHBOURS if templates is None else templates, percent, miss)
    known = table.collect()
    every = sorted({s for t in known for s in t["items"]})
    bands = {t["size"]: max(u["bands"] for u in known if u["size"] == t["size"]) for t in known}
    read = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    literal = f"array({', '.join(f'{s}L' if s > -(1 << 63) else 'bigint(-9223372036854775808)' for s in every) or '0L'})"
    # Where template shingles stand: only windows over such a place can hold a template.
    places = "filter(sequence(0, size(all) - 1), i -> array_contains({}, all[i]))".format(literal)
    held = read.select("doc", shingles("text").alias("all")).where("size(all) > 0" if known else "false")
    marked = held.where(f"arrays_overlap(all, {literal})").select("doc", "all", F.explode(F.expr(places)).alias("p"))
    classes = F.broadcast(table.select(F.explode("items").alias("shingle"), F.col("size").alias("class"), "step").distinct())
    near = marked.join(classes, F.expr("all[p] = shingle"))
    starts = near.select("doc", "all", F.col("class").alias("size"), F.explode(F.expr(
        "sequence(greatest(0, int(ceil((p - class + 1) / step))) * step, int(floor(p / step)) * step, step)")).alias("at"))
    windows = starts.select("doc", "size", "at", F.expr("slice(all, at + 1, size)").alias("run")).dropDuplicates(
        ["doc", "size", "at"])
    most = F.expr("case size {} end".format(" ".join(f"when {s} then {b}" for s, b in bands.items())) if bands else "1")
    keyed = windows.withColumn("held", F.array_distinct("run")).withColumn("bands", most).withColumn("key", F.explode(F.expr(_band_keys("held", "bands"))))
    wanted = table.select(
        "license", "items", "n", F.col("size").alias("class"), F.explode(F.expr(_band_keys("items", "bands"))).alias("band_key"))
    found = (keyed.join(F.broadcast(wanted), (F.col("key") == F.col("band_key")) & (F.col("size") == F.col("class")))
             .select("doc", "license", "n", "at", "run", "items", F.size(F.array_intersect("held", "items")).alias("shared"))
             .where(f"100 * shared >= {percent} * n").dropDuplicates(["doc", "license", "at"]))
    # Each shingle of the document goes to the best of the templates that claim it.
    claims = found.select("doc", "license", "n", "at", "shared", F.explode(F.expr(
        "transform(filter(sequence(0, size(run) - 1), i -> array_contains(items, run[i])), i -> at + i)")).alias("place"))
    owners = claims.groupBy("doc", "place").agg(F.max(F.struct(
        (F.col("shared") / F.col("n")).alias("there"), F.col("n").alias("long"), F.col("license").alias("name"))).alias("owner"))
    mine = F.sum(F.when(F.col("owner.name") == F.col("license"), 1).otherwise(0))
    found = claims.join(owners, ["doc", "place"]).groupBy("doc", "license", "n", "at", "shared").agg(
        mine.alias("own"), F.count("*").alias("all")).where("2 * own >= all")
    best = found.groupBy("doc", "license", "n").agg(F.max("shared").alias("shared"), F.min(F.struct((-F.col("shared")).alias("o"), "at")).alias("b"))
    return best.select(
        F.col("doc").alias(id_col), "license", F.col("shared").cast("long"), F.col("n").cast("long").alias("n_shingles"),
        (F.col("shared") / F.col("n")).alias("containment"), F.col("b.at").cast("long").alias("first_word"))
