"""Stock licence files and notices planted in documents, against a brute-force reading of the notices."""

import re
import textwrap

from tessella.llm import license_texts, licenses

COPYRIGHT = "Copyright (c) 2021 Some Body\n\n"
NOTICES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This program is distributed under the GNU GPL v3 license or later": None,
    "This software is licensed under the BSD 3-Clause License": "BSD-3-Clause",
    "# SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0-or-later",
    "we do not license anything here": None,
}


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))


def files():
    yield "MIT", "MIT License\n\n" + COPYRIGHT + wrapped(licenses.MIT, 78)
    yield "MIT", "The MIT License (MIT)\n\n" + COPYRIGHT + licenses.MIT
    for width in (65, 70, 72, 75, 79, 80, 100):
        yield "ISC", "ISC License\n\n" + COPYRIGHT + wrapped(licenses.ISC, width)
        yield "BSD-3-Clause", COPYRIGHT + wrapped(license_texts.SHORT["BSD-3-Clause"], width)
        yield "BSD-2-Clause", "BSD 2-Clause License\n\n" + COPYRIGHT + wrapped(license_texts.SHORT["BSD-2-Clause"], width)
    for name in ("Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0"):
        yield name, license_texts.LONG[name]
        yield name, license_texts.LONG[name].replace("http://", "https://").replace("\n", "\r\n")
    yield "Apache-2.0", license_texts.LONG["Apache-2.0"].split("\n   APPENDIX")[0]
    yield "Unlicense", wrapped(license_texts.SHORT["Unlicense"], 72)
    yield None, licenses.MIT + "\n\nbut not for you"
    yield None, license_texts.LONG["GPL-3.0-only"][:9000]


def test_stock_files_are_found_whole(spark):
    planted = list(files())
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(planted)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs, licenses.known_digests(spark)).collect()}
    assert [got[i] for i in range(len(planted))] == [name for name, _ in planted]


def test_notices_are_found_in_lines(spark):
    lines = list(NOTICES)
    rows = [(i, f"some prose\n{line}\nmore prose") for i, line in enumerate(lines)] + [(99, "\n".join(lines)), (100, None)]
    got = {r.doc_id: r.notices for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_digests(spark)).collect()}
    assert [got[i] or None for i in range(len(lines))] == list(NOTICES.values())
    assert got[99] == ",".join(sorted({n for n in NOTICES.values() if n}))
    assert got[100] == ""


def test_catalogue_names_one_license_for_a_form():
    spelled = {}
    for name, text in licenses.license_catalog.notices():
        spelled.setdefault(re.sub(r"\W+", " ", text.lower()).strip(), set()).add(name)
    assert all(len(names) == 1 for names in spelled.values())
