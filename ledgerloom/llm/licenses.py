"""License scans: Dice coefficient over word bigrams against license templates.

Texts and templates are normalised to lower-cased runs of letters and digits.  A
template with m distinct bigrams is compared with windows of the text.  Dice at least t
needs a window of at most m * (2 - t) / t bigrams that shares at least m * t / (2 - t)
of the template's; these size bounds prune most templates from the count of hits alone,
and the rest of the work to windows that begin and end with a hit.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ship, text_or_empty

_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License"
_CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

# SPDX identifier and notice or text.
TEMPLATES = (
    ("0BSD", "Licensed under the BSD Zero Clause License."),
    ("0BSD", f"{_GRANT}. {_ISC_END}"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{_BSD_2} {_BSD_END}"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", _CC.format("")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", _CC.format("-NonCommercial")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", _CC.format("-NonCommercial-NoDerivatives")),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", _CC.format("-NonCommercial-ShareAlike")),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", _CC.format("-NoDerivatives")),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", _CC.format("-ShareAlike")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format("General Public License", "3")),
    ("ISC", "Released under the ISC License."),
    ("ISC", f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
)
MATCHES = "array<struct<license:string,template:int,dice:double,begin:int,end:int>>"
CACHED = 200_000
_WORD = re.compile(r"[^\W_]+")


def bigrams(words: np.ndarray) -> np.ndarray:
    return (words[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ words[1:]


def settled(windows: list[tuple]) -> dict[str, tuple]:
    """Of each license the best of its windows (-shared, -dice, first, last, template,
    license) that doesn't overlap a better one.

    Better is what shares more bigrams with its template, as a notice may be part of the
    texts of several licenses; then what has the higher Dice, is first, is shorter, and
    has the first template.
    """
    best: dict[str, tuple] = {}
    taken: list[tuple[int, int]] = []
    for _, d, first, last, i, license_ in sorted(windows):
        if all(last < a or first > b for a, b in taken):
            taken.append((first, last))
            best.setdefault(license_, (d, first, last, i))
    return best


class Matcher:
    def __init__(self, templates=TEMPLATES, dice: float = 0.8):
        self.known: dict[str, int] = {}
        self.dice = dice
        self.templates = []
        for i, (license_, text) in enumerate(templates):
            own = set(bigrams(self._words(text.lower())).tolist())
            if own:
                least = math.ceil(len(own) * dice / (2 - dice) - 1e-9)
                most = math.floor(len(own) * (2 - dice) / dice + 1e-9)
                self.templates.append((i, license_, own, least, most))
        self.any = np.unique(np.array([b for t in self.templates for b in t[2]], dtype=np.uint64))

    def _words(self, lower: str) -> np.ndarray:
        known = self.known
        if len(known) > CACHED:
            known.clear()
        hashes = []
        for w in _WORD.findall(lower):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            hashes.append(h)
        return np.array(hashes, dtype=np.uint64)

    def matches(self, text: str) -> list[dict]:
        """The best window of each license, where its Dice reaches the asked one and no
        window of another license that it overlaps is better."""
        words = self._words(text.lower())
        if len(words) < 2 or not len(self.any):
            return []
        all_ = bigrams(words)
        at = np.minimum(np.searchsorted(self.any, all_), len(self.any) - 1)
        hits = np.flatnonzero(self.any[at] == all_)
        if not len(hits):
            return []
        got = set(all_[hits].tolist())
        windows: list[tuple] = []
        for i, license_, own, least, most in self.templates:
            if len(got & own) < least:
                continue
            places = [int(p) for p in hits if int(all_[p]) in own]
            for n, first in enumerate(places):
                shared: set[int] = set()
                window: set[int] = set()
                upto = first
                for last in places[n:]:
                    if last - first + 1 > most:
                        break
                    window.update(all_[upto : last + 1].tolist())
                    upto = last + 1
                    shared.add(int(all_[last]))
                    d = 2 * len(shared) / (len(own) + len(window))
                    if d >= self.dice - 1e-12:
                        windows.append((-len(shared), -d, first, last, i, license_))
        best = settled(windows)
        if not best:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        if len(spans) != len(words):  # lower-casing made other words of it
            spans = [m.span() for m in _WORD.finditer(text.lower())]
        return [
            {"license": s, "template": i, "dice": -d, "begin": spans[first][0], "end": spans[last + 1][1]}
            for s, (d, first, last, i) in sorted(best.items())
        ]


def match_column(templates=TEMPLATES, dice: float = 0.8) -> Column:
    kind = pa.list_(
        pa.struct([("license", pa.string()), ("template", pa.int32()), ("dice", pa.float64()), ("begin", pa.int32()), ("end", pa.int32())])
    )

    @F.arrow_udf(MATCHES)
    def found(texts: pa.Array) -> pa.Array:
        matcher = Matcher(templates, dice)
        return pa.array([matcher.matches(t) for t in texts.to_pylist()], kind)

    return found(text_or_empty())


def find_licenses(docs: DataFrame, templates=TEMPLATES, dice: float = 0.8) -> DataFrame:
    """doc_id, license, template (its number), dice, begin and end of each license found.

    A document has one row per license: of the windows that reach the asked Dice the one
    that shares most bigrams with its template, ties to the higher Dice, the first, the
    shortest, and the first template.  Where windows of different licenses overlap, the
    better one counts and the other doesn't: a notice is of one license, however much its
    neighbours share with it.  begin and end are code points of
    the text.  A window has at most as many bigrams as the size bound allows, repeats
    counted; Dice compares sets.  Null and empty texts and texts of one word have no
    license.  Repeated rows are reported each.  Other columns aren't read.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", F.explode(match_column(templates, dice)).alias("m")).select("doc_id", "m.*")
