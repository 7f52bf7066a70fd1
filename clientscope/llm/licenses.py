"""License scan: word windows of whole texts against licence templates by the Dice coefficient over word bigrams."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientscope.llm.common import ddl, map_texts, pick

# Texts and notices of well-known licences, as their owners publish them.
AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions:"
)
MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission."
)
BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
APACHE_HEAD = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
    "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
APACHE_AS_IS = (
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
    "and limitations under the License."
)


def gnu(name: str, version: str) -> str:
    """The first paragraph of the notice that a GNU licence tells its users to put on their files."""
    subject = "This library" if name == "Lesser General Public License" else "This program"
    mark = ":" if version == "3" else ";"
    return (
        f"{subject} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
        f"Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


def commons(kind: str, name: str) -> tuple[str, str]:
    return f"Licensed under CC {kind} 4.0.", f"This work is licensed under a Creative Commons {name} 4.0 International License."


TEMPLATES = {
    "AGPL-3.0": (gnu("Affero General Public License", "3"), "Licensed under the GNU Affero General Public License, version 3."),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", f"{APACHE_HEAD} {APACHE_AS_IS}", APACHE_HEAD, APACHE_AS_IS,
        "This project is licensed under the Apache License 2.0.",
    ),
    "BSD-2-Clause": (f"{BSD_GRANT} {BSD_AS_IS}", "Released under the BSD 2-Clause License.", "Licensed under the BSD 2-Clause License."),
    "BSD-3-Clause": (
        f"{BSD_GRANT} {BSD_NAMES} {BSD_AS_IS}", "Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License.", BSD_NAMES,
    ),
    "CC-BY-4.0": commons("BY", "Attribution"),
    "CC-BY-NC-4.0": commons("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-SA-4.0": commons("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0": commons("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-SA-4.0": commons("BY-SA", "Attribution-ShareAlike"),
    "GPL-2.0": (
        gnu("General Public License", "2"), "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
    ),
    "GPL-3.0": (
        gnu("General Public License", "3"), "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
    ),
    "ISC": (" ".join(ISC), *ISC, "Released under the ISC License.", "This project is licensed under the ISC License."),
    "LGPL-2.1": (gnu("Lesser General Public License", "2.1"), "Licensed under the GNU Lesser General Public License, version 2.1."),
    "LGPL-3.0": (gnu("Lesser General Public License", "3"), "Licensed under the GNU Lesser General Public License, version 3."),
    "MIT": (
        f"{MIT_GRANT} {MIT_NOTICE} {AS_IS}", MIT_GRANT, f"{MIT_NOTICE} {AS_IS}", "Released under the MIT License.",
        "This project is licensed under the MIT License.", "The MIT License (MIT)",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
}

#: Words that tell licences of one family apart: a window must have those of its template and no other.
VARIANTS = (
    "2", "2.1", "3", "4", "lesser", "library", "affero", "mit", "isc", "apache", "mozilla", "noncommercial", "sharealike", "noderivatives", "nc",
    "sa", "nd", "endorse", "promote", "neither",
)

#: Bytes to words: A-Z folded; all other ASCII outside letters, digits and the dot becomes a blank, comment marks among it.
TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or c == 0x2E or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
VERSION = re.compile(rb"v?([0-9]+(?:\.[0-9]+)?)")


def words_of(text: bytes) -> list[bytes]:
    """Words without dots at their ends; a version has no v before it and no .0 behind it."""
    out = []
    for w in text.translate(TABLE).split():
        w = w.strip(b".")
        if w and (48 <= w[-1] <= 57) and (m := VERSION.fullmatch(w)):
            w = m[1].removesuffix(b".0")
        if w:
            out.append(w)
    return out


def bigrams(words: list[bytes]) -> frozenset[tuple[bytes, bytes]]:
    return frozenset(zip(words, words[1:]))  # noqa: B905


class Library:
    """Templates with their lengths, bigrams and variant words; and which template each bigram of a text may belong to."""

    def __init__(self, templates: Mapping[str, Iterable[str]], threshold: float, variants: Iterable[str] = VARIANTS):
        self.threshold = threshold
        self.variants = frozenset(v.encode() for v in variants)
        self.entries = []
        for license_, texts in sorted(templates.items()):
            for number, text in enumerate(texts):
                words = words_of(text.encode())
                if len(words) < 2:
                    raise ValueError("a template needs two words")
                self.entries.append((license_, number, len(words), bigrams(words), self.variants.intersection(words)))
        #: 2 s / (m + n) >= t with n >= s needs at least this many shared bigrams.
        self.least = [int(np.ceil(round(threshold * len(g) / (2 - threshold), 9))) for _, _, _, g, _ in self.entries]
        self.of_word: dict[bytes, int] = {}
        for _, _, _, grams, _ in self.entries:
            for w in sorted({w for pair in grams for w in pair}):
                self.of_word.setdefault(w, len(self.of_word) + 1)
        size = len(self.of_word) + 1
        self.any_gram = np.zeros(size * size, bool)
        self.codes = []
        for _, _, _, grams, _ in self.entries:
            codes = np.array(sorted(self.of_word[a] * size + self.of_word[b] for a, b in grams))
            self.any_gram[codes] = True
            self.codes.append(codes)
        self.size = size

    def matches(self, text: bytes) -> list[tuple[str, int, float]]:
        """(license, template, coefficient) of every template that some window reaches, with its best window.

        A window has as many words as its template (or all words of a shorter text) and starts where one of the
        template's bigrams does. The number of bigrams of the template in a text, and then in a window, is bounded
        before any window is looked at.
        """
        words = words_of(text)
        if len(words) < 2:
            return []
        get = self.of_word.get
        known = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        pairs = known[:-1] * self.size + known[1:]
        at = np.flatnonzero(self.any_gram[pairs])
        if not len(at):
            return []
        out, found = [], pairs[at]
        for (license_, number, width, grams, variants), codes, least in zip(self.entries, self.codes, self.least, strict=True):
            starts = at[np.isin(found, codes)]
            if len(starts) < least:
                continue
            starts = np.unique(np.minimum(starts, max(0, len(words) - width)))
            hits = at[np.isin(found, codes)]
            inside = np.searchsorted(hits, starts + width - 1) - np.searchsorted(hits, starts)
            best = 0.0
            for a in starts[inside >= least].tolist():
                window = words[a : a + width]
                made = bigrams(window)
                dice = 2 * len(made & grams) / (len(made) + len(grams))
                if dice >= self.threshold and dice > best and self.variants.intersection(window) == variants:
                    best = dice
            if best:
                out.append((license_, number, best))
        return out


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, Iterable[str]] = TEMPLATES, threshold: float = 0.8, *, variants: Iterable[str] = VARIANTS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id and licenses, an array of (license, template, dice) by license and template.

    Windows of a template's length slide over the whole text, so that a licence is found inside other prose, reflowed or
    behind comment marks. A template appears once, with its best window, if that reaches the threshold and has the same
    ``variants``: words such as versions that tell the licences of a family apart.

    Windows of a text that has too few of a template's bigrams are passed over, and so are windows with too few of them.
    The templates are a fixed list and go with the tasks; the scan is one pass without a shuffle.

    Null, empty and one-word texts have no bigrams and no licence; an empty table gives no rows; a very long text is
    handled alone, in memory in proportion to its length. Null ids, ties and repeated rows are judged row by row; other
    columns are ignored.
    """
    library = Library(templates, threshold, variants)
    rows = pick(docs, doc_id=id_col, text=text_col)

    def scan(text: bytes | None) -> list[dict]:
        return [{"license": k, "template": i, "dice": v} for k, i, v in library.matches(text or b"")]

    schema = f"{ddl(rows, 'doc_id')}, licenses array<struct<license:string,template:int,dice:double>>"
    return map_texts(rows, lambda texts: {"licenses": [scan(t) for t in texts]}, schema)


def license_names(found):
    """The distinct licences, comma-joined."""
    return F.array_join(F.array_distinct(F.transform(found, lambda m: m["license"])), ",")
