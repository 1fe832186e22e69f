"""Operator 2, licence scans by sentence rules.

A text's words, lower-cased and without the signs between them, are matched with
the known licence sentences, so that neither wrapped lines nor comment signs (#,
//, *, --) nor empty lines inside matter. A known sentence must begin and end
where a sentence or a line does. The document's sequence of sentence identifiers
is matched against ordered rules; where rules overlap, the longest wins, then the
first, and each sentence serves one match. Sentences of one match have at most
GAP other words between them, room for a title's copyright lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Known licence sentences by identifier (fixed values, from the licences' published texts).
SENTENCES = {
    "zlib-1": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-2": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-3": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header-1": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-2.0-header-2": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-header-2-s": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache-2.0-header-3": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-2.0-header-4": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-title": "The MIT License",
    "mit-title-2": "MIT License",
    "mit-title-3": "The MIT License (MIT)",
    "mit-1": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-3": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-4": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "bsd-1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-3": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-4": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-5": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-6": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-2": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "isc-3": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mpl-2.0-header-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-header-2": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2.0-header-2-s": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-1": "This is free and unencumbered software released into the public domain.",
    "unlicense-2": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-1": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-2": "This software is distributed without any warranty.",
    "cc0-3": "You should have received a copy of the CC0 Public Domain Dedication along with this software.",
    "cc-by-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}

#: Ordered licence rules: licence, kind, the identifiers in order (fixed values).
RULES = [
    ("Zlib", "text", ("zlib-1", "zlib-2", "zlib-3")),
    ("Apache-2.0", "header", ("apache-2.0-header-1", "apache-2.0-header-2", "apache-2.0-header-3", "apache-2.0-header-4")),
    ("Apache-2.0", "header", ("apache-2.0-header-1", "apache-2.0-header-2-s", "apache-2.0-header-3", "apache-2.0-header-4")),
    ("Apache-2.0", "header", ("apache-2.0-header-1", "apache-2.0-header-2")),
    ("Apache-2.0", "reference", ("apache-2.0-header-1",)),
    ("Apache-2.0", "notice", ("apache-2.0-notice",)),
    ("MIT", "text", ("mit-title", "mit-1", "mit-2", "mit-3", "mit-4")),
    ("MIT", "text", ("mit-title-2", "mit-1", "mit-2", "mit-3", "mit-4")),
    ("MIT", "text", ("mit-title-3", "mit-1", "mit-2", "mit-3", "mit-4")),
    ("MIT", "text", ("mit-1", "mit-2", "mit-3", "mit-4")),
    ("MIT", "notice", ("mit-notice",)),
    ("MIT", "reference", ("mit-title",)),
    ("MIT", "reference", ("mit-title-2",)),
    ("MIT", "reference", ("mit-title-3",)),
    ("GPL-3.0-only", "notice", ("gpl-3.0-notice",)),
    ("CC-BY-NC-4.0", "notice", ("cc-by-nc-4.0-notice",)),
    ("CC-BY-SA-4.0", "notice", ("cc-by-sa-4.0-notice",)),
    ("CC-BY-4.0", "notice", ("cc-by-4.0-notice",)),
    ("BSD-3-Clause", "text", ("bsd-1", "bsd-2", "bsd-3", "bsd-4", "bsd-5", "bsd-6")),
    ("BSD-2-Clause", "text", ("bsd-1", "bsd-2", "bsd-3", "bsd-5", "bsd-6")),
    ("BSD-3-Clause", "text", ("bsd-1", "bsd-2", "bsd-3", "bsd-4")),
    ("BSD-2-Clause", "text", ("bsd-1", "bsd-2", "bsd-3")),
    ("ISC", "text", ("isc-1", "isc-2", "isc-3")),
    ("0BSD", "text", ("0bsd-1", "isc-2", "isc-3")),
    ("ISC", "reference", ("isc-1",)),
    ("MPL-2.0", "header", ("mpl-2.0-header-1", "mpl-2.0-header-2")),
    ("MPL-2.0", "header", ("mpl-2.0-header-1", "mpl-2.0-header-2-s")),
    ("MPL-2.0", "reference", ("mpl-2.0-header-1",)),
    ("Unlicense", "text", ("unlicense-1", "unlicense-2")),
    ("Unlicense", "reference", ("unlicense-1",)),
    ("CC0-1.0", "notice", ("cc0-1", "cc0-2", "cc0-3")),
    ("CC0-1.0", "notice", ("cc0-1", "cc0-2")),
    ("CC0-1.0", "reference", ("cc0-1",)),
    ("CC-BY-4.0", "notice", ("cc-by-4.0-work",)),
    ("CC-BY-SA-4.0", "notice", ("cc-by-sa-4.0-work",)),
    ("CC-BY-NC-4.0", "notice", ("cc-by-nc-4.0-work",)),
]

#: GNU licences: short name, full name, versions (fixed values); their headers differ in these alone.
GNU = (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",)))
#: Licences that are named in notices and in SPDX lines (fixed values).
NAMED = {
    "MIT": "the MIT License", "Apache-2.0": "the Apache License, Version 2.0", "MPL-2.0": "the Mozilla Public License 2.0", "BSD-3-Clause": "the BSD 3-Clause License",
    "BSD-2-Clause": "the BSD 2-Clause License", "ISC": "the ISC License", "Unlicense": "the Unlicense", "CC0-1.0": "CC0 1.0", "CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0", "GPL-2.0-only": "the GNU General Public License, version 2", "GPL-3.0-only": "the GNU General Public License, version 3", "AGPL-3.0-only": "the GNU Affero General Public License, version 3",
}
#: The titles of licences' own texts (fixed values).
TITLES = {
    "Apache-2.0": "Apache License Version 2.0, January 2004", "GPL-2.0-only": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GPL-3.0-only": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-2.1-only": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "LGPL-3.0-only": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "AGPL-3.0-only": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "MPL-2.0": "Mozilla Public License Version 2.0", "EPL-2.0": "Eclipse Public License - v 2.0", "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003",
}
SPDX = (*NAMED, "0BSD", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "GPL-2.0", "GPL-3.0", "EPL-2.0", "BSL-1.0", "Zlib")
NOTICES = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is licensed under", "This file is licensed under")


def _forms() -> None:
    """Adds the sentences and rules that follow a form."""
    for short, name, versions in GNU:
        for work in ("program", "library"):
            own = f"{short.lower()}-{work}"
            SENTENCES[f"{own}-2"] = f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
            SENTENCES[f"{own}-3"] = f"See the {name} for more details."
            SENTENCES[f"{own}-4"] = f"You should have received a copy of the {name} along with this {work}."
            for v in versions:
                full = f"{short}-{v if '.' in v else v + '.0'}"
                SENTENCES[f"{own}-{v}-later"] = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
                SENTENCES[f"{own}-{v}-only"] = f"This {work} is free software; you can redistribute it and/or modify it under the terms of the {name} version {v} as published by the Free Software Foundation."
                for kind in ("later", "only"):
                    licence, first, rest = f"{full}-{'or-later' if kind == 'later' else 'only'}", f"{own}-{v}-{kind}", (f"{own}-2", f"{own}-3", f"{own}-4")
                    RULES.extend([(licence, "header", (first, *rest)), (licence, "header", (first, *rest[:2])), (licence, "reference", (first,))])
    for licence, name in NAMED.items():
        for verb in NOTICES:
            SENTENCES[f"{licence} {verb}"] = f"{verb} {name}."
            RULES.append((licence, "notice", (f"{licence} {verb}",)))
    for licence in SPDX:
        SENTENCES[f"spdx {licence}"] = f"SPDX-License-Identifier: {licence}"
        RULES.append((_today(licence), "spdx", (f"spdx {licence}",)))
        for sign in ("OR", "AND"):
            for other in SPDX:
                SENTENCES[f"spdx {licence} {sign} {other}"] = f"SPDX-License-Identifier: {licence} {sign} {other}"
                RULES.append((f"{_today(licence)} {sign} {_today(other)}", "spdx", (f"spdx {licence} {sign} {other}",)))
    for licence, title in TITLES.items():
        SENTENCES[f"title {licence}"] = title
        RULES.append((licence, "title", (f"title {licence}",)))


def _today(licence: str) -> str:
    """The name that a licence has in SPDX now."""
    return {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only"}.get(licence, licence)


_forms()

#: Every known sentence has one of these, each inside one word; texts with none are not read further.
ANCHORS = ("licens", "permission", "copyright", "distribut", "warrant", "liable", "unencumbered", "released", "cc0")
#: Words that may stand between two sentences of one match.
GAP = 40

_WORD = re.compile(r"[^\W_]+")
#: Between two words: what ends a sentence or a line.
_END = re.compile(r"[.!?;:)\n]")


def normal(sentence: str) -> list[str]:
    """Lower-cased words; the signs between them go."""
    return [w.lower() for w in _WORD.findall(sentence)]


class Scanner:
    """Finds licences in one text after another."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules=tuple(RULES), anchors: tuple[str, ...] = ANCHORS, gap: int = GAP):
        assert not any(re.search(r"\s", a) for a in anchors), "an anchor is part of one word"
        assert all(any(a in s.lower() for a in anchors) for s in sentences.values()), "each sentence needs an anchor"
        self.anchors, self.gap = anchors, gap
        first: dict[tuple[str, ...], str] = {}  # sentences of the same words are one
        names = {name: first.setdefault(tuple(normal(s)), name) for name, s in sentences.items()}
        self.starts: dict[tuple[str, str], list[tuple[list[str], str]]] = {}
        for words, name in sorted(first.items(), key=lambda x: -len(x[0])):
            assert len(words) > 1, "a sentence needs two words"
            self.starts.setdefault(words[:2], []).append((list(words), name))
        self.by_first: dict[str, list] = {}
        spelt = {}
        for licence, kind, ids in rules:
            spelt.setdefault(tuple(names[i] for i in ids), (licence, kind))
        for order, (ids, (licence, kind)) in sorted(enumerate(spelt.items()), key=lambda x: (-len(x[1][0]), x[0])):
            self.by_first.setdefault(ids[0], []).append((licence, kind, ids))

    def sentences(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(identifier, start, end, first word, word after) of the known sentences, in order; the longest at each place."""
        found = list(_WORD.finditer(text))
        words = [m[0].lower() for m in found]

        def ends(k: int) -> bool:
            """Whether a sentence may end before word k."""
            return k in (0, len(words)) or _END.search(text, found[k - 1].end(), found[k].start()) is not None

        out, k = [], 0
        while k + 1 < len(words):
            for known, name in self.starts.get((words[k], words[k + 1]), ()):
                stop = k + len(known)
                # one may also follow or precede another without a sign between
                if words[k:stop] == known and (ends(k) or out and out[-1][4] == k) and (ends(stop) or tuple(words[stop : stop + 2]) in self.starts):
                    end = found[stop - 1].end()
                    out.append((name, found[k].start(), end + (text[end : end + 1] in (".", "!", "?", ";", ":")), k, stop))
                    k = stop
                    break
            else:
                k += 1
        return out

    def scan(self, text: str | None) -> list[tuple[str, str, int, int, tuple[str, ...]]]:
        """(licence, kind, start, end, identifiers) of each match, in order."""
        if not text:
            return []
        low = text.lower()
        if not any(a in low for a in self.anchors):
            return []
        known = self.sentences(text)
        out, k = [], 0
        while k < len(known):
            for licence, kind, ids in self.by_first.get(known[k][0], ()):
                own = known[k : k + len(ids)]
                if tuple(x[0] for x in own) == ids and all(b[3] - a[4] <= self.gap for a, b in zip(own, own[1:])):
                    out.append((licence, kind, own[0][1], own[-1][2], ids))
                    k += len(ids)
                    break
            else:
                k += 1
        return out


def licence_matches(docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: dict[str, str] = SENTENCES, rules=tuple(RULES), anchors: tuple[str, ...] = ANCHORS, gap: int = GAP) -> DataFrame:
    """(key, n_sentences, licenses, matches array<struct>): one row per row of docs.

    licenses lists the distinct licences by name. Null and empty texts, and texts
    with no known sentence, have an empty list; very long texts are read whole.
    Changed sentences, expressions of more than two SPDX names and comment signs
    made of letters (REM, dnl) are not known. Repeated rows and null keys are kept; an
    empty table gives an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    match = pa.list_(pa.struct([("license", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("sentences", pa.list_(pa.string()))]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sentences, rules, anchors, gap)
        for batch in batches:
            found = [scanner.scan(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([sum(len(m[4]) for m in f) for f in found], pa.int64()), pa.array([sorted({m[0] for m in f}) for f in found], pa.list_(pa.string())),
                    pa.array([[{"license": a, "kind": b, "start": c, "stop": d, "sentences": list(e)} for a, b, c, d, e in f] for f in found], match),
                ],
                names=["key", "n_sentences", "licenses", "matches"],
            )

    out = rows.mapInArrow(scan, f"key {kind}, n_sentences bigint, licenses array<string>, matches array<struct<license string, kind string, start bigint, stop bigint, sentences array<string>>>")
    return out.withColumnRenamed("key", key)
