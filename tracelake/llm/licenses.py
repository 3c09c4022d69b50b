"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Everything is Spark expressions. Templates of similar length form a class with a span, the next power of two
to their words. A match is a run of ``span`` words that holds enough of a template's shingles. A window of
``span + stride - 1`` words every ``stride`` words holds any run whole. From the window's and the template's
numbers of shingles follows the least Jaccard similarity of a window with a match, and from it the number of
bands of one row, each with a hash of its own, for which it collides with probability ``1 - miss``. Windows
of all classes are cut in one pass, and of those that collide each run is compared. Only what could match is
hashed: the shingles a match must hold can't all avoid a template's anchor words, so texts and windows without
any such word are passed over without loss.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.json import let
from tracelake.llm.common import stored

SHINGLE = 5
#: Public license notices, as their publishers word them.
TEMPLATES = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0-header": 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "BSD-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
}
_WORD = "[^A-Za-z0-9]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, A-Z lowered."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, _WORD), lambda w: w != "")


def shingle_hashes(ws: Column) -> Column:
    """Hashes of all five-word shingles; none of fewer words."""
    n = F.size(ws) - (SHINGLE - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.xxhash64(F.array_join(F.slice(ws, k, SHINGLE), " ")))).otherwise(F.array().cast("array<bigint>"))


def _plain(text: str) -> list[str]:
    out, word = [], ""
    for c in text + " ":
        if c.isascii() and c.isalnum():
            word += c.lower()
        elif word:
            out.append(word)
            word = ""
    return out


def _sets(ws: list[str]) -> set[tuple[str, ...]]:
    return {tuple(ws[k : k + SHINGLE]) for k in range(len(ws) - SHINGLE + 1)}


def span_of(words: int) -> int:
    """The length of the runs that a template of so many words is looked for in: 8, 16, 32 ..."""
    span = 8
    while span < words:
        span *= 2
    return span


def classes(templates: dict[str, str], containment: float, miss: float = 1e-6) -> list[dict]:
    """Windows and bands for templates of five words or more, by span."""
    out: dict[int, dict] = {}
    for name, text in sorted(templates.items()):
        ws = _plain(text)
        if len(ws) < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        span = span_of(len(ws))
        c = out.setdefault(span, {"span": span, "stride": max(4, span // 2), "names": [], "similar": 1.0})
        c["names"].append(name)
        n, inside = len(_sets(ws)), span + c["stride"] - SHINGLE
        held = math.ceil(containment * n)
        c["similar"] = min(c["similar"], held / (inside + n - held))
    for c in out.values():
        c["bands"] = math.ceil(math.log(miss) / math.log(1 - c["similar"])) if c["similar"] < 1 else 1
        c["anchors"] = anchors({n: templates[n] for n in c["names"]}, containment)
    return [out[k] for k in sorted(out)]


def anchors(templates: dict[str, str], containment: float) -> list[str]:
    """Words of which any match holds one: for each template the longest, until more shingles hold them than a match may lack."""
    found = set()
    for text in templates.values():
        ws = _plain(text)
        sets = _sets(ws)
        may_lack = len(sets) - math.ceil(containment * len(sets))
        covered: set[tuple[str, ...]] = set()
        for w in sorted(set(ws), key=lambda w: (-len(w), w)):
            own = {s for s in sets if w in s} - covered
            if own:
                covered |= own
                found.add(w)
            if len(covered) > may_lack:
                break
    return sorted(found)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, containment: float = 0.8, most_broadcast: int = 10_000) -> DataFrame:
    """(id_col, license, containment): templates that a run of words of a text holds.

    A match is a run of the template's span (8, 16, 32 ... words, the first not below its own number) with at
    least ``containment`` of its distinct five-word shingles; a shorter text is one run. The best run's share
    is returned. Null, empty and shorter texts match nothing; ids that are null are dropped; documents with
    equal ids are one; an empty table gives no rows; other columns are ignored. Up to ``most_broadcast``
    templates are broadcast; more are joined by band and key.
    """
    templates = TEMPLATES if templates is None else templates
    few = lambda df: F.broadcast(df) if len(templates) <= most_broadcast else df
    found = classes(templates, containment)
    spark = docs.sparkSession
    rows = F.array(*(F.struct(F.lit(k).alias("class"), F.lit(n).alias("license"), F.lit(templates[n]).alias("text")) for k, c in enumerate(found) for n in c["names"]))
    catalogue = spark.range(1).select(F.explode(rows).alias("t")).select("t.*").withColumn("ws", words(F.col("text"))).withColumn("own", F.array_distinct(shingle_hashes(F.col("ws")))).drop("text", "ws")
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    # the classes whose anchors a text shows somewhere; windows and bands then are numbers that are exploded, and
    # arrays are computed after, as Spark writes what it explodes a second time into a filter
    shown = lambda low, c: functools.reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in c["anchors"]))
    kind = lambda k, c: F.struct(*(F.lit(v).alias(n) for n, v in (("class", k), ("stride", c["stride"]), ("inside", c["span"] + c["stride"] - SHINGLE), ("bands", c["bands"]))), F.array(*map(F.lit, c["anchors"])).alias("anchors"))
    kinds = let(F.lower("text"), lambda low: F.array_compact(F.array(*(F.when(shown(low, c), kind(k, c)) for k, c in enumerate(found)))))
    # written down, or Spark would split every text for the filters that it infers from what follows
    some = stored(some.withColumn("kinds", kinds).where(F.size("kinds") > 0), "candidates")
    # words are a column of their own: written into the shingles' expression they would be split for each shingle
    some = some.withColumn("ws", words(F.col("text"))).select("id", "kinds", "ws").where(F.size("ws") >= SHINGLE)
    wins = some.withColumn("hs", shingle_hashes(F.col("ws"))).select("id", "ws", "hs", F.explode("kinds").alias("c"))
    wins = wins.select("id", "ws", "hs", "c", F.explode(F.sequence(F.lit(0), F.greatest(F.size("hs") - 1, F.lit(0)), F.col("c.stride"))).alias("at"))
    wins = wins.where(F.arrays_overlap(F.slice("ws", F.col("at") + 1, F.col("c.inside") + SHINGLE - 1), F.col("c.anchors")))
    wins = wins.select("id", "c.class", "c.bands", F.slice("hs", F.col("at") + 1, F.col("c.inside")).alias("win"))

    def banded(df: DataFrame, column: str) -> DataFrame:
        """A row for each band, with the smallest of the column's hashes by the band's own hash."""
        rows = df.select("*", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)).alias("band"))
        return rows.withColumn("key", F.coalesce(F.array_min(F.transform(column, lambda h: F.xxhash64(h, F.col("band")))), F.lit(0)))  # never null, so that no filter computes it too

    bands = functools.reduce(lambda col, kc: F.when(F.col("class") == kc[0], kc[1]["bands"]).otherwise(col), enumerate(found), F.lit(1))
    keys = banded(catalogue.withColumn("bands", bands), "own").select("class", "license", "band", "key")
    met = banded(wins, "win").join(few(keys), ["class", "band", "key"])
    met = met.select("id", "license", "win").distinct().join(few(catalogue.select("license", "class", "own")), "license")
    runs = functools.reduce(lambda col, kc: F.when(F.col("class") == kc[0], _best(kc[1]["span"], kc[1]["stride"])).otherwise(col), enumerate(found), F.lit(0))
    met = met.withColumn("share", runs / F.size("own")).where(F.col("share") >= containment)
    return met.groupBy(F.col("id").alias(id_col), "license").agg(F.max("share").alias("containment"))


def _best(span: int, stride: int) -> Column:
    """Most of the template's shingles that one run of a window holds."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(stride - 1)), lambda s: F.size(F.array_intersect("own", F.slice("win", s + 1, span - SHINGLE + 1)))))


def licensed(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """(id_col, n_licenses, licenses) of every row with an id: the matched templates' names in order, joined by ' | '."""
    found = scan(docs, id_col=id_col, **options).groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_list("license")), " | ").alias("licenses"), F.count("*").alias("n"))
    every = docs.select(id_col).where(F.col(id_col).isNotNull()).join(found, id_col, "left")
    return every.select(id_col, F.coalesce("n", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"))
