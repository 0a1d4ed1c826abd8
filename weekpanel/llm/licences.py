"""Operator 9: licence notices, found by the Dice coefficient over word bigrams.

Texts and licence templates are compared as words, in lower case and with ASCII punctuation as spaces. A passage is a
run of words of a document; it matches a template when 2 * shared / (its bigrams + the template's), over distinct
bigrams, reaches ``DICE``. A passage can only do so if its number of bigrams lies between n * t / (2 - t) and
n * (2 - t) / t for a template of n: that bounds the passages that are looked at, and a template is left out where
too few of its bigrams lie that close together. Every passage between two bigrams of the template within those bounds
is scored; of passages that overlap, the one with most shared bigrams beyond those that are not shared is kept (then the
one with the highest score, the larger template, the earlier one): a whole text with a name changed wins over a shorter
notice that it begins with word by word.

Every document is read once and nothing is shuffled but what is found; the templates are a fixed list.

Defined results: null, empty and blank texts match nothing; repeated rows give repeated rows; an empty table gives no
rows; further columns are left alone.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.llm.decontaminate import plain_words
from weekpanel.llm.tokens import slices

DICE = 0.8

#: Parts that notices share.
_AS_IS_BSD = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE"
    " USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_THIRD_BSD = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
_AS_IS_ISC = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL'
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
    " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN"
    " AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
    " PERFORMANCE OF THIS SOFTWARE."
)


def _gnu(licence: str, version: str, what: str = "program", tail: str = "") -> str:
    """The notice of a GNU licence, alone or with the warranty paragraph and where to find a copy."""
    notice = (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {licence} as"
        f" published by the Free Software Foundation, either version {version} of the License, or (at your option) any"
        " later version."
    )
    if not tail:
        return notice
    where = {
        "url": "see https://www.gnu.org/licenses/.",
        "post": (
            "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
        ),
    }
    return (
        f"{notice} This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even"
        f" the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {licence} for more"
        f" details. You should have received a copy of the GNU {licence} along with this {what}. If not, {where[tail]}"
    )


def _gnu_notices() -> dict[str, str]:
    """Each licence in every form, so that the form of a notice never speaks for another licence."""
    out = {}
    lesser, every = "Lesser General Public License", ("program", "library")
    for name, licence, version, words in (
        ("GPL-2.0", "General Public License", "2", every[:1]),
        ("GPL-3.0", "General Public License", "3", every[:1]),
        ("AGPL-3.0", "Affero General Public License", "3", every[:1]),
        ("LGPL-2.1", lesser, "2.1", every),
        ("LGPL-3.0", lesser, "3", every),
    ):
        for what in words:
            for tail in ("", "url", "post"):
                parts = [name, "header", *([what] if len(words) > 1 else []), *([tail] if tail else [])]
                out["-".join(parts)] = _gnu(licence, version, what, tail)
    return out


#: Notices and texts of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in'
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        ' software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS'
        " OF ANY KIND, either express or implied. See the License for the specific language governing permissions and"
        " limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
        " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        ' substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,'
        " EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A"
        " PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY"
        " CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF"
        " OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
        " hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met: Redistributions of source code must retain the above copyright notice,"
        " this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the"
        " above copyright notice, this list of conditions and the following disclaimer in the documentation and/or"
        " other materials provided with the distribution."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "all-rights-reserved": "All rights reserved.",
} | _gnu_notices()
TEMPLATES["ISC-text"] = TEMPLATES["ISC"] + _AS_IS_ISC
TEMPLATES["BSD-2-Clause-text"] = TEMPLATES["BSD-2-Clause"] + _AS_IS_BSD
TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"] + _THIRD_BSD
TEMPLATES["BSD-3-Clause-text"] = TEMPLATES["BSD-3-Clause"] + _AS_IS_BSD


@dataclass
class Template:
    name: str
    bigrams: np.ndarray  # distinct, ascending
    dice: float

    @property
    def size(self) -> int:
        return len(self.bigrams)

    @property
    def most(self) -> int:
        """Largest number of bigrams of a passage that can match."""
        return int(self.size * (2 - self.dice) / self.dice + 1e-9)

    @property
    def least_shared(self) -> int:
        """A match shares t / (2 - t) of the template's bigrams at least: then the passage has no others."""
        return max(1, int(np.ceil(self.size * self.dice / (2 - self.dice) - 1e-9)))


def templates_of(texts: dict[str, str], dice: float = DICE) -> list[Template]:
    names = list(texts)
    found = plain_words([texts[n].encode() for n in names])
    bigrams, first = found.shingles(2, short=False)
    made = [Template(n, np.unique(bigrams[first[k] : first[k + 1]]), dice) for k, n in enumerate(names)]
    return [t for t in made if t.size]


def passages(bigrams: np.ndarray, template: Template) -> list[tuple[float, int, int]]:
    """(score, first bigram, end) of the passages of one text that reach the score, each from and to a bigram of the
    template; of those with the same beginning the best."""
    at = np.minimum(np.searchsorted(template.bigrams, bigrams), template.size - 1)
    hits = np.flatnonzero(template.bigrams[at] == bigrams)
    need = template.least_shared
    if len(hits) < need:
        return []
    near = hits[need - 1 :] - hits[: len(hits) - need + 1] < template.most
    out = []
    for k in np.flatnonzero(near):
        begin = int(hits[k])
        kinds, shared, best = set(), set(), (0.0, 0, 0)
        is_hit = set(hits[k : k + template.most].tolist())
        for place in range(begin, min(begin + template.most, len(bigrams))):
            kinds.add(int(bigrams[place]))
            if place in is_hit:
                shared.add(int(bigrams[place]))
                score = 2 * len(shared) / (template.size + len(kinds))
                if score > best[0]:
                    best = (score, begin, place + 1)
        if best[0] >= template.dice - 1e-12:
            out.append(best)
    return out


def notices(bigrams: np.ndarray, templates: list[Template]) -> list[tuple[str, float, int, int]]:
    """(template, score, first word, end) of the notices of one text that do not overlap, in text order."""
    found = []
    for t in templates:
        for score, begin, end in passages(bigrams, t):
            sizes = t.size + len(np.unique(bigrams[begin:end]))
            found.append((sizes - round(1.5 * score * sizes), -score, -t.size, begin, end, t.name))
    kept: list[tuple[int, int, str, float]] = []  # apart from each other, by their first words
    for _, score, _, begin, end, name in sorted(found):
        at = bisect.bisect_left(kept, (begin,))
        if (at == 0 or kept[at - 1][1] <= begin) and (at == len(kept) or end + 1 <= kept[at][0]):
            kept.insert(at, (begin, end + 1, name, -score))
    return [(name, score, begin, end) for begin, end, name, score in kept]


FOUND = "doc_id long, licence string, dice double, first_word long, end_word long"


def _scan(batches: Iterable[pa.RecordBatch], templates: list[Template]) -> Iterator[pa.RecordBatch]:
    every = np.unique(np.concatenate([t.bigrams for t in templates]))
    least = min(t.least_shared for t in templates)
    for batch, texts in slices(batches):
        bigrams, first = plain_words(texts).shingles(2, short=False)
        rows = []
        if len(bigrams):
            at = np.minimum(np.searchsorted(every, bigrams), len(every) - 1)
            hits = np.searchsorted(first, np.flatnonzero(every[at] == bigrams), side="right") - 1
            docs = batch.column("doc_id").to_pylist()
            for text in np.flatnonzero(np.bincount(hits, minlength=len(texts)) >= least):
                for notice in notices(bigrams[first[text] : first[text + 1]], templates):
                    rows.append((docs[text], *notice))
        columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(5)]
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
        names = ["doc_id", "licence", "dice", "first_word", "end_word"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def licence_notices(docs: DataFrame, texts: dict[str, str] | None = None, dice: float = DICE) -> DataFrame:
    """One row per notice: doc_id, licence, dice, and the words of the normalised text it covers."""
    templates = templates_of(TEMPLATES if texts is None else texts, dice)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(lambda it: _scan(it, templates), FOUND) if templates else slim.sparkSession.createDataFrame(
        [], FOUND
    )
