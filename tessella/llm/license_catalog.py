"""Catalogue of whole licence texts and one-line notices, by SPDX name.

The canonical form drops lines that begin with "copyright", also where the word
only comes to a line's start by the wrapping of a sentence. So short texts are
listed once for each canonical form that a wrapping at 50 to 120 columns gives,
and long ones as published and with one line a paragraph. A text or notice that
does not say "or later" counts as "only".
"""

from __future__ import annotations

import re
import textwrap

from . import license_texts

NOTICE = re.compile(r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$")
WIDTHS = range(50, 121)

TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "Zlib": ("zlib License", "The zlib License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}

#: Where the instructions for the user of a licence begin; texts go round with and without them.
APPENDIX = re.compile(r"\n[ \t]*(APPENDIX: How to apply|How to Apply These Terms|Appendix: How to Apply)")

NAMES = {
    "MIT": ("MIT License", "MIT", "Expat License", "MIT (Expat) License"),
    "ISC": ("ISC License", "ISC"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache License v2", "Apache 2.0 License", "Apache 2.0", "Apache Software License, Version 2.0", "Apache Software License 2.0", "Apache-2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause", "New BSD License", "Modified BSD License", "Revised BSD License"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0 License"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL-2.0"),
    "EPL-1.0": ("Eclipse Public License, Version 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0", "EPL-1.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "WTFPL": ("WTFPL", "WTFPL License", "Do What The Fuck You Want To Public License"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "Open Font License 1.1", "OFL-1.1"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic License, Version 2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0", "CC0 1.0 Universal", "CC0 1.0 Universal License", "CC0 1.0 License", "Creative Commons Zero v1.0 Universal", "Creative Commons Zero License"),
    **{
        f"CC-{code}-{version}": tuple(
            name
            for whole in (f"Creative Commons {words} {version}",)
            for name in (
                f"CC {code} {version}",
                f"CC {code} {version} License",
                f"CC {code} {version} International",
                f"CC {code} {version} International License",
                whole,
                f"{whole} License",
                f"{whole} International",
                f"{whole} International License",
                f"{whole} International Public License",
                f"{whole} Unported License",
            )
            if "International" not in name or version == "4.0"
        )
        for version in ("4.0", "3.0", "2.0")
        for code, words in (
            ("BY", "Attribution"),
            ("BY-SA", "Attribution-ShareAlike"),
            ("BY-NC", "Attribution-NonCommercial"),
            ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    },
}

#: (SPDX stem, full name, short name, versions)
GNU = (
    ("GPL", "General Public License", ("2.0", "3.0")),
    ("LGPL", "Lesser General Public License", ("2.1", "3.0")),
    ("AGPL", "Affero General Public License", ("3.0",)),
)

SUBJECTS = ("", *(f"this {x} is " for x in ("work", "project", "software", "program", "library", "file")))
VERBS = ("licensed", "released", "distributed")
LINKS = (" under the ", " under ", " under the terms of the ")


def _gnu_names() -> dict[str, tuple[str, ...]]:
    out = {}
    for stem, full, versions in GNU:
        for version in versions:
            short = version.removesuffix(".0")
            names = [f"{g}{full}{v}{n}" for g in ("GNU ", "") for v in (" version ", " v", " ") for n in (version, short)]
            names += [f"{g}{stem}{v}{n}" for g in ("GNU ", "") for v in (" ", " v", "v", " version ") for n in (version, short)]
            only = (*names, *(f"{n} only" if "icense" in n else f"{n} license" for n in names))
            out[f"{stem}-{version}-only"] = only
            out[f"{stem}-{version}-or-later"] = tuple(f"{n}{w}" for n in names for w in (" or later", ", or (at your option) any later version", " or any later version"))
    return out


def canonical_form(text: str) -> str:
    """The canonical form before spellings are unified: texts that share it are one entry."""
    return re.sub(r"[\W_]+", " ", NOTICE.sub(" ", text.lower())).strip()


def _paragraphs(text: str) -> str:
    """``text`` with one line a paragraph; lines that are real copyright notices stay on their own."""
    out: list[str] = []
    fresh = True
    for line in text.split("\n"):
        notice = re.match(r"\s*copyright (\(c\)|\[?\d{4}|\[yyyy)", line, re.I)
        if not line.strip():
            fresh = True
            continue
        if fresh or notice:
            out.append(line.strip())
        else:
            out[-1] += " " + line.strip()
        fresh = bool(notice)
    return "\n".join(out)


def _wrapped(text: str, width: int, indent: str) -> str:
    return "\n\n".join(
        textwrap.fill(p, width, subsequent_indent=indent if p[0].isdigit() or p[0] in "*-" else "", break_on_hyphens=False) for p in text.split("\n\n")
    )


def _bullets(text: str) -> list[str]:
    """``text`` with its numbered items, and with other marks for them."""
    return [text, re.sub(r"(?m)^\d\. ", "* ", text), re.sub(r"(?m)^(\d)\. ", r"(\1) ", text)]


def _distinct(texts) -> list[str]:
    return list({canonical_form(t): t for t in reversed(list(texts))}.values())[::-1]


def whole_texts(short: dict[str, str]) -> list[tuple[str, str]]:
    out = []
    for name, text in {**license_texts.SHORT, **short}.items():
        forms = _distinct([t for b in _bullets(text) for t in [b, *(_wrapped(b, w, i) for w in WIDTHS for i in ("", "   "))]])
        out += [(name, t) for t in _distinct(f"{title}\n\n{f}" if title else f for f in forms for title in ("", *TITLES.get(name, ())))]
    for name, text in license_texts.LONG.items():
        cut = APPENDIX.search(text)
        bodies = [text] + ([text[: cut.start()]] if cut else [])
        out += [(name, t) for t in _distinct(f for b in bodies for f in (b, _paragraphs(b)))]
    return out


def notices() -> list[tuple[str, str]]:
    """One-line notices. A notice without the word licence is never looked up, so it is not listed."""
    names = {**NAMES, **_gnu_names()}
    found: dict[str, tuple[str, str]] = {}
    for spdx, known in names.items():
        lines = [f"SPDX-License-Identifier: {spdx}", f"License: {spdx}"]
        for name in known:
            lines.append(f"License: {name}")
            links = (*LINKS, " under a ") if name.startswith("Creative") else LINKS
            lines += [f"{s}{v}{link}{name}" for s in SUBJECTS for v in VERBS for link in links]
        for line in lines:
            if re.search("licen[sc]e", line, re.I):
                form = canonical_form(line)
                if form not in found or spdx < found[form][0]:
                    found[form] = (spdx, line)
    for stem, _, versions in GNU:
        for version in versions:
            line = f"SPDX-License-Identifier: {stem}-{version}"  # the older tag; canonical forms have no "+", so "or later" reads alike
            found.setdefault(canonical_form(line), (f"{stem}-{version}-only", line))
    return list(found.values())
