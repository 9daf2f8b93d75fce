"""License scans in DataFrame functions only: MinHash bands retrieve templates for overlapping windows, exact containment verifies.

Words are runs of letters and digits in lower case; five in a row are a shingle. A template of s shingles belongs to the
class of the least power of two c >= s; windows of that class are 2c shingles long and start every c, so each
stretch of c shingles lies whole in one of them. A window that holds a template to MIN_CONTAINMENT has a Jaccard similarity of
at least J = 0.8 s / (2c + 0.2 s) >= 0.19 to it (s > c/2), and with BANDS bands of one row they share a band with a probability
of at least 1 - (1 - J)^BANDS, over 0.9999. It also holds over 0.4 c shingles of templates; a filter of FILTER_BITS bits, the same size
for any number of templates, finds windows that can't, which get no signature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

SHINGLE = 5
MIN_CONTAINMENT = 0.8
BANDS = 48
#: Bits of the filter of shingles that templates have, a power of two of 64 at least; a shingle has two of them.
FILTER_BITS = 1 << 16
#: Texts by which licenses are commonly declared or granted: (license, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal Public Domain Dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD", """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""),
)


def _word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once a row; the optimizer would copy a plain column into its uses, within lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shingles(text: Column) -> Column:
    """Hash of each shingle, in order; none for fewer words."""
    return let(_word_list(text), _word_shingles)


def _word_shingles(words: Column) -> Column:
    last = F.size(words) - SHINGLE + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates) -> DataFrame:
    """Rows (template, license, class, hashes); templates without a shingle are left out."""
    listed = [F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(templates or [("", "")])]
    rows = spark.range(1).select(F.explode(F.array(*listed)).alias("_t")).select("_t.*")
    rows = rows.withColumn("hashes", F.array_distinct(_shingles(F.col("text"))))
    size = F.ceil(F.log2(F.size("hashes").cast("double")))
    return rows.where(F.size("hashes") > 0).select("template", "license", F.pow(F.lit(2.0), size).cast("int").alias("class"), "hashes")


def signature(hashes: str):
    """The least hash of a set of shingles in each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, j))))


def shingle_filter(hashes: list[int]) -> Column:
    """A literal array of FILTER_BITS bits, by 64, with two bits set for each hash."""
    words = [0] * (FILTER_BITS // 64)
    for h in hashes:
        for bit in (h % FILTER_BITS, h // FILTER_BITS % FILTER_BITS):
            words[bit // 64] |= 1 << bit % 64
    return F.array(*[F.lit(w - (w >> 63 << 64)).cast("long") for w in words])


def passes(bits: Column, h: Column) -> Column:
    """Whether both bits of a hash are set."""

    def bit(at: Column) -> Column:
        word = F.get(bits, F.shiftright(at, 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    low = F.lit(FILTER_BITS - 1)
    return bit(h.bitwiseAND(low)) & bit(F.shiftright(h, FILTER_BITS.bit_length() - 1).bitwiseAND(low))


def license_matches(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", templates=TEMPLATES) -> DataFrame:
    """One row for each document and license found in it: id, license, containment (of the best window), first_word (of the first window that matches).

    templates: (license, text) pairs, a fixed list whose bands are sent to all tasks. Null texts, texts of fewer
    words than a shingle and an empty table give no rows. Rows that repeat an id give one row for each license. A null id
    stays null; other columns are ignored.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates)
    found = known.collect()  # as many rows as templates
    classes = sorted({r["class"] for r in found}) or [1]
    bits = shingle_filter([h for r in found for h in r["hashes"]])

    def of_class(hashes: Column, seen: Column, c: int) -> Column:
        starts = F.transform(F.sequence(F.lit(0), F.size(hashes) - 1, F.lit(c)), lambda s: F.struct(F.lit(c).alias("class"), s.alias("start"), F.slice(hashes, s + 1, 2 * c).alias("w")))
        return F.filter(starts, lambda x: F.size(F.filter(F.slice(seen, x["start"] + 1, 2 * c), lambda y: y)) > int(0.4 * c))

    def windows(hashes: Column) -> Column:
        own = lambda seen: F.flatten(F.array(*[of_class(hashes, seen, c) for c in classes]))
        return F.when(F.exists(hashes, lambda h: passes(bits, h)), let(F.transform(hashes, lambda h: passes(bits, h)), own))

    rows = docs.select(F.col(id_col).alias("_id"), F.explode(let(_shingles(F.col(text_col)), windows)).alias("_x"))
    rows = rows.select("_id", F.col("_x.class").alias("class"), F.col("_x.start").alias("start"), F.array_distinct("_x.w").alias("w"))
    rows = rows.select("*", F.posexplode(signature("w")).alias("band", "least"))
    bands = known.select("template", "license", F.col("class"), F.col("hashes"), F.posexplode(signature("hashes")).alias("band", "least"))
    hits = rows.join(F.broadcast(bands), ["class", "band", "least"])
    held = F.size(F.array_intersect("w", "hashes")) / F.size("hashes")
    hits = hits.select("_id", "license", "start", held.alias("held")).where(F.col("held") >= MIN_CONTAINMENT)
    return hits.groupBy(F.col("_id").alias(id_col), "license").agg(F.max("held").alias("containment"), F.min("start").cast("long").alias("first_word"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(read_table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quoted = lambda t: t.replace("'", "''")
    values = ", ".join(f"({i}, '{name}', '{quoted(text)}')" for i, (name, text) in enumerate(TEMPLATES))
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    shingles = f"SELECT *, list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) AS sh FROM"
    return f"""
        WITH t AS (SELECT *, list_distinct(sh) AS ts FROM ({shingles} (SELECT id, license, {words} AS ws FROM (VALUES {values}) v(id, license, text)))),
        k AS (SELECT id, license, len(ts) AS n, pow(2, ceil(log2(len(ts))))::BIGINT AS c, unnest(ts) AS s FROM t WHERE len(ts) > 0),
        d AS (SELECT doc_id, unnest(sh) AS s, unnest(range(len(sh))) AS p FROM ({shingles} (SELECT doc_id, {words} AS ws FROM documents)) WHERE len(sh) > 0),
        m AS (SELECT doc_id, id, license, n, c, k.s, p FROM d JOIN k ON d.s = k.s),
        w AS (SELECT doc_id, id, license, n, s, p // c * c AS start FROM m UNION ALL SELECT doc_id, id, license, n, s, p // c * c - c FROM m WHERE p >= c),
        h AS (SELECT doc_id, license, start, count(DISTINCT s) / n AS held FROM w GROUP BY doc_id, id, license, n, start)
        SELECT doc_id, license, max(held) AS containment, min(start) AS first_word FROM h WHERE held >= {MIN_CONTAINMENT} GROUP BY doc_id, license
    """


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLE = {"op6_license_scan": _oracle()}
