"""Licence scan by canonical digest lookup.

A text is brought to a canonical form (lower case, no copyright lines,
equivalent spellings unified, anything but letters and digits as one space) and
hashed. Known licence texts are hashed alike, and whole texts are matched by a
hash join on the digest. The same lookup over single lines finds one-line
licence notices inside longer texts.

Null counts as the empty text; the empty canonical form matches no licence.
Rows are judged one by one: repeated and null ids do not matter, nor do other
columns. Texts of any length are read whole.
Ties (two licences of one canonical form) give the first name in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_catalog
from .common import cut, whole

# Equivalent spellings, each with the form that stands for it.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("fulfil", "fulfill"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("http", "https"),
)

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Whole licence texts and one-line notices by name. More can be passed in as a table.
KNOWN = (
    ("MIT", MIT),
    ("ISC", ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    *license_catalog.whole_texts({"MIT": MIT, "ISC": ISC}),
    *license_catalog.notices(),
)


def canonical(text: Column) -> Column:
    """Canonical form of a text or a line."""
    kept = F.regexp_replace(F.lower(text), "(?m)^[^a-z0-9\\n]*(copyright|\\(c\\)|©|all rights reserved)[^\\n]*$", " ")
    form = F.concat(F.lit(" "), F.regexp_replace(kept, "[^\\p{L}\\p{N}]+", " "), F.lit(" "))
    for old, new in SPELLINGS:
        form = F.replace(form, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(form)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """(digest, license) of the known texts and of ``extra`` (license, text)."""
    known = spark.createDataFrame(list(KNOWN), "license string, text string")
    if extra is not None:
        known = known.unionByName(extra.select("license", "text"))
    known = known.where(canonical(whole()) != "")
    return known.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", notice: str | None = "licen[sc]e") -> DataFrame:
    """One row per document: canonical digest, ``license`` of the whole text (null if unknown) and the sorted licences of its notice lines.

    Notices depend on the text alone, so they are found once for each distinct
    text and joined on its hash: rows that repeat an id, or have none, keep their
    own. Only lines that match ``notice`` are hashed and shuffled; every notice
    of the catalogue does. With others in ``known`` give a wider pattern, or None
    for all lines.
    """
    # both lookups are cut, so that the joins deal their sides anew and a digest of many copies can be split
    known = cut(known)
    t = whole(F.col(text).cast("string"))
    blob = F.sha2(t, 256).alias("_blob")
    base = docs.select(F.col(doc_id).alias("doc_id"), digest(t).alias("digest"), blob)
    lines = F.split(t, "\n") if notice is None else F.filter(F.split(t, "\n"), lambda x: F.lower(x).rlike(notice))
    hits = cut(
        docs.select(blob, lines.alias("lines"))
        .where(F.size("lines") > 0)
        .dropDuplicates(["_blob"])
        .select("_blob", F.explode("lines").alias("line"))
        .select("_blob", digest(F.col("line")).alias("digest"))
        .join(known, "digest")
        .groupBy("_blob")
        .agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    )
    return (
        base.join(known, "digest", "left")
        .join(hits, "_blob", "left")
        .select("doc_id", F.col("digest").alias("canonical_sha256"), "license", F.coalesce("notices", F.lit("")).alias("notices"))
    )
