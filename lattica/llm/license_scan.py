"""License notices in texts, with DataFrame operations only.

Texts are read in overlapping windows of 2c shingles every c, for each size class c (a power
of two); a notice of c/2..c shingles that is whole in a text lies in one of them, where its
similarity is at least 0.8 / 4 even if only 0.8 of it is there. 96 MinHash bands of one row
then retrieve its template with probability 1 - 0.8^96 (over 0.999999999), and the exact
share of the template's shingles in the window decides.

A band of a window and of a template can be equal only where the window holds the shingle that gives the
template its minimum. So the bands are looked up from their other end: the places of those
shingles (96 a template at most) say which windows can collide at all, and only these windows' minima are
computed and joined. No window that any band would retrieve is passed over.
Notices of fewer than WIDTH words are one shingle of all their words, and are looked up among
the runs of that width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, BANDS = 5, 96

# The words of public license texts and of the headers that they ask for.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_REST = (
    ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
    " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": _MIT_GRANT,
    "MIT-text": _MIT_GRANT
    + ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD": _BSD_GRANT,
    "BSD-2-Clause-text": _BSD_GRANT + _BSD_REST + _BSD_WARRANTY,
    "BSD-3-Clause-text": _BSD_GRANT + _BSD_REST + _BSD_NAMES + _BSD_WARRANTY,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
    " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
    " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    " 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."
    " 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

#: More notices of the licenses above and of others; a license is reported once, with its best notice.
NOTICES = [
    ("All-rights-reserved", "All rights reserved."),
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License 2.0"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License v2.0"),
    ("LGPL", "GNU Lesser General Public License"),
    ("LGPL", "GNU Library General Public License"),
    ("AGPL", "GNU Affero General Public License"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("EPL", "Eclipse Public License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("BSL-1.0", "Boost Software License"),
    ("Zlib", "zlib License"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    *((name, f"SPDX-License-Identifier: {tag}") for name, tags in {
        "MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "GPL-2.0": ["GPL-2.0"], "GPL-3.0": ["GPL-3.0"], "LGPL": ["LGPL-2.0", "LGPL-2.1", "LGPL-3.0"],
        "AGPL": ["AGPL-3.0"], "MPL-2.0": ["MPL-2.0"], "EPL": ["EPL-1.0", "EPL-2.0"], "BSD-2-Clause": ["BSD-2-Clause"], "BSD-3-Clause": ["BSD-3-Clause"],
        "ISC": ["ISC"], "BSL-1.0": ["BSL-1.0"], "Zlib": ["Zlib"], "CC0-1.0": ["CC0-1.0"], "Unlicense": ["Unlicense"], "CC-BY-4.0": ["CC-BY-4.0"],
        "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"],
    }.items() for tag in tags),
]


def words_in(text: Column) -> Column:
    """Letters and digits, lower case, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(w: Column, width: int) -> Column:
    """(hash, place) of all runs of `width` words."""
    return F.transform(F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.xxhash64(*(F.get(w, i + k) for k in range(width))).alias("h"), i.alias("i")))


def shingles(text: Column) -> Column:
    """Hashes of all runs of WIDTH words (letters and digits, lower case), in order."""
    return F.transform(F.array(words_in(text)), lambda w: F.transform(_runs(w, WIDTH), lambda r: r["h"]))[0]


def _minima(own: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(own, lambda x: F.xxhash64(x, j))))


def _templates(spark: SparkSession, notices: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Notices of WIDTH words or more with their shingles; shorter ones with their one run."""
    rows = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(i).alias("notice"), F.lit(v).alias("text")) for i, (k, v) in enumerate(notices)))
    known = spark.range(1).select(F.explode(rows).alias("t")).select("t.license", "t.notice", "t.text", F.size(words_in(F.col("t.text"))).alias("width"))
    long = known.where(F.col("width") >= WIDTH).select("license", "notice", F.array_distinct(shingles(F.col("text"))).alias("of"))
    first = lambda k: F.when(F.col("width") == k, F.transform(F.array(words_in(F.col("text"))), lambda w: _runs(w, k)[0]["h"])[0])
    run = F.coalesce(*map(first, range(1, WIDTH)))
    return long.withColumn("c", F.expr("cast(pow(2, ceil(log2(size(of)))) as int)")), known.where(F.col("width").between(1, WIDTH - 1)).select("license", "notice", "width", run.alias("h"), F.array_join(words_in(F.col("text")), r"[^\p{L}\p{N}]+").alias("like"))


def _short(docs: DataFrame, known: DataFrame) -> DataFrame | None:
    """Places of notices under WIDTH words, in the windows (two shingles) that hold them."""
    sought: dict[int, list[int]] = {}
    listed = known.collect()  # one row a template, fixed in number
    for r in listed:
        sought.setdefault(r["width"], []).append(r["h"])
    if not sought:
        return None

    def of_width(w: Column, k: int) -> Column:
        return F.transform(F.filter(_runs(w, k), lambda r: r["h"].isin(sought[k])), lambda r: F.struct(F.lit(k).alias("width"), r["h"].alias("h"), r["i"].alias("i")))

    at = lambda w: F.flatten(F.array(*(of_width(w, k) for k in sought)))
    # a text without the words of one in a row can't hold it, and isn't hashed
    some = docs.where(F.col("doc_id").isNotNull() & F.lower("text").rlike("|".join(sorted({r["like"] for r in listed}))))
    hits = some.select("doc_id", F.explode(F.transform(F.array(words_in(F.col("text"))), at)[0]).alias("r")).select("doc_id", "r.*")
    met = hits.join(F.broadcast(known.select("license", "notice", "width", "h")), ["width", "h"])
    start = F.explode(F.array_distinct(F.array(F.greatest(F.col("i") - 1, F.lit(0)), F.col("i"))))
    return met.select("doc_id", "license", "notice", F.lit(1.0).alias("containment"), start.alias("start"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, share: float = 0.8) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, license, containment, first_window, n_windows): a row
    for each document row's licenses, found where at least `share` of a notice's 5-word
    shingles are in one window; containment is the best window's share, first_window its
    first such window's place in shingles. Of a license's notices the one of most
    containment counts, then the first listed. Notices of fewer than five words are found
    whole only, at places in runs of their own width. Null and empty texts, null ids and
    texts without a notice give no rows; rows that repeat a doc_id count as one. Templates
    without a word are ignored. Other columns are ignored.
    """
    spark = docs.sparkSession
    known, brief = _templates(spark, [*TEMPLATES.items(), *NOTICES] if templates is None else list(templates.items()) or [("", "")])
    # the shingles that give a template's bands their minima, by size class; at most BANDS a template
    least = known.select("c", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform("of", lambda x: F.struct(F.xxhash64(x, j), x.alias("x")))))["x"]).alias("x"))
    of_class: dict[int, list[int]] = {}
    for r in least.distinct().orderBy("c", "x").collect():
        of_class.setdefault(r["c"], []).append(r["x"])
    of_class = of_class or {1: [0]}
    every = sorted({x for xs in of_class.values() for x in xs})
    own = docs.select("doc_id", shingles(F.col("text")).alias("s")).where("doc_id is not null")
    hits = own.withColumn("at", F.filter(F.transform("s", lambda x, i: F.when(x.isin(every), F.struct(x.alias("x"), i.alias("i")))), lambda h: h.isNotNull())).where(F.size("at") > 0)

    def around(c: int) -> Column:
        """The windows of size c that a hit of its templates at i is in: i div c and the one before."""
        mine = F.filter("at", lambda h: h["x"].isin(of_class[c]))
        near = F.array_distinct(F.flatten(F.transform(mine, lambda h: F.array(F.greatest(F.floor(h["i"] / c) - 1, F.lit(0)), F.floor(h["i"] / c)))))
        return F.transform(near, lambda k: F.struct(F.lit(c).alias("c"), k.cast("int").alias("k")))

    windows = hits.select("doc_id", "s", F.explode(F.flatten(F.array(*map(around, of_class)))).alias("w"))
    part = windows.select("doc_id", F.col("w.c").alias("c"), (F.col("w.c") * F.col("w.k")).alias("start"), F.array_distinct(F.slice("s", F.col("w.c") * F.col("w.k") + 1, 2 * F.col("w.c"))).alias("part"))
    bands = part.select("doc_id", "c", "start", "part", F.posexplode(_minima(F.col("part"))).alias("band", "value"))
    sought = known.select("license", "notice", "of", F.col("c").alias("_c"), F.posexplode(_minima(F.col("of"))).alias("_band", "_value"))
    met = bands.join(F.broadcast(sought), (F.col("c") == F.col("_c")) & (F.col("band") == F.col("_band")) & (F.col("value") == F.col("_value")))
    sure = met.withColumn("containment", F.size(F.array_intersect("part", "of")) / F.size("of")).where(F.col("containment") >= share)
    sure = sure.select("doc_id", "license", "notice", "containment", "start")
    short = _short(docs, brief)
    every = sure if short is None else sure.unionByName(short)
    of_notice = every.groupBy("doc_id", "license", "notice").agg(F.max("containment").alias("containment"), F.min("start").alias("first_window"), F.count_distinct("start").alias("n_windows"))
    best = of_notice.groupBy("doc_id", "license").agg(F.max_by(F.struct("containment", "first_window", "n_windows"), F.struct("containment", -F.col("notice"))).alias("b"))
    return best.select("doc_id", "license", "b.*")
