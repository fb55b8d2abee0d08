"""Licence scans: Dice coefficient over word bigrams against licence templates.

Texts are normalised (lower case, runs of anything but letters and digits to one space).  A
document is compared whole, by paragraph (blocks between blank lines) and by line, as sets of
word bigrams, and then by any run of words: notices of several paragraphs or lines, and those amid prose.  ``dice = 2 |A & B| / (|A| + |B|)`` is at most ``2 min / (|A| + |B|)``, so a
template of b bigrams can reach the threshold t only against units of ``b t / (2 - t)`` to
``b (2 - t) / t`` bigrams; units and templates outside these bounds are never compared.

Complete licence texts are files of ``license_texts``; the shorter ones and the notices that stand for a licence are listed
here.  An index from bigrams to templates tells which templates share enough with a unit to be compared at all.

One Arrow pass without a shuffle; memory is one unit's bigrams and the templates, a constant of the program (about 200
kilobytes of text), extended through a parameter and broadcast.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

THRESHOLD = 0.8

TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0 1.0."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without permission."],
}

# complete licences: what the notices above leave out follows them
TEMPLATES["BSD-3-Clause"].append(TEMPLATES["BSD-3-Clause"][-1] + ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.')
TEMPLATES["ISC"].append(TEMPLATES["ISC"][-1] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.')

TEMPLATES["BSD-2-Clause"] = [re.sub(r" 3[.] Neither.*?permission[.]", "", TEMPLATES["BSD-3-Clause"][-1])]
TEMPLATES["Unlicense"] = [
    "This is free and unencumbered software released into the public domain.",
    'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/',
]
TEMPLATES["GPL-2.0"] = ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."]
TEMPLATES["LGPL-2.1"] = ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."]
TEMPLATES["AGPL-3.0"] = ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."]


def all_templates() -> dict[str, list[str]]:
    """The notices above and every complete text of ``license_texts``, by licence."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for f in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        if f.name.endswith(".txt"):
            out.setdefault(f.name.removesuffix(".txt"), []).append(f.read_text("utf-8"))
    return out


_WORD = re.compile(r"[^\W_]+")
_BLANK = re.compile(r"\n[ \t]*\n")


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


class Table(NamedTuple):
    rows: list[tuple[str, set, int, int]]  # (licence, bigrams, least, most) with the sizes of units that can match, by size
    index: dict[tuple[str, str], tuple[int, ...]]  # bigram -> rows that hold it

    def sharing(self, own: set) -> list[int]:
        """Rows that share as many bigrams as the smallest unit has that could match them."""
        hits = Counter(r for g in own & self.index.keys() for r in self.index[g])
        return sorted(r for r, n in hits.items() if n >= self.rows[r][2])


def compiled(templates: dict[str, list[str]], threshold: float) -> Table:
    rows = []
    for name, texts in templates.items():
        for t in texts:
            b = bigrams(_WORD.findall(t.lower()))
            if b:
                low, high = len(b) * threshold / (2 - threshold), len(b) * (2 - threshold) / threshold
                rows.append((name, b, math.ceil(low - 1e-9), math.floor(high + 1e-9)))
    rows.sort(key=lambda x: (x[2], x[0]))
    index: dict[tuple[str, str], list[int]] = {}
    for r, (_, b, _, _) in enumerate(rows):
        for g in b:
            index.setdefault(g, []).append(r)
    return Table(rows, {g: tuple(r) for g, r in index.items()})


def units(text: str) -> list[str]:
    """The whole text, then its paragraphs if there are several, then lines likewise."""
    out = [text]
    paragraphs = _BLANK.split(text)
    out += paragraphs if len(paragraphs) > 1 else []
    lines = text.split("\n")
    return out + (lines if len(lines) > 1 else [])


def windows(grams: list[tuple[str, str]], b: set, high: int, threshold: float) -> Iterator[tuple[float, int, int]]:
    """(dice, first word, last word) of runs of words that reach the threshold, the best of those that overlap.

    The best run from a word ends where some bigram of the template comes up first, so only those ends are tried.
    """
    places: dict[tuple[str, str], list[int]] = {}
    for p, g in enumerate(grams):
        if g in b:
            places.setdefault(g, []).append(p)
    best, free, need = None, 0, len(b) * threshold / (2 - threshold) - 1e-9
    nexts = {g: iter(ps[1:]) for g, ps in places.items()}
    ends = sorted(ps[0] for ps in places.values())  # where each bigram comes up first from word i on
    while len(ends) >= need and ends:
        i, tried = ends[0], ends.copy()
        del ends[0]
        if (later := next(nexts[grams[i]], None)) is not None:
            bisect.insort(ends, later)
        if best and i > best[2]:
            yield best[0], best[1], best[2] + 1
            best, free = None, best[2] + 1
        if i < free:
            continue
        seen, p = set(), i
        for n, e in enumerate(tried, 1):
            while p <= e and len(seen) <= high:
                seen.update(grams[p : min(p + high, e + 1)])
                p += high
            p = e + 1
            if len(seen) > high:
                break
            dice = 2.0 * n / (len(seen) + len(b))
            if dice >= threshold and (not best or dice > best[0]):
                best = (dice, i, e)
    if best:
        yield best[0], best[1], best[2] + 1


def _spans(text: str) -> list[tuple[int, int]]:
    """First word and the one after the last of each unit."""
    out, total = [], len(_WORD.findall(text))
    out.append((0, total))
    for parts in (_BLANK.split(text), text.split("\n")):
        if len(parts) > 1:
            ends = list(itertools.accumulate(len(_WORD.findall(x)) for x in parts))
            out += zip([0, *ends], ends)
    return out


def matches(text: str, table: Table, threshold: float) -> Iterator[tuple[str, float, int]]:
    """(licence, dice, unit number) of every pair that reaches the threshold.

    Then those of runs of words that meet no matching unit of the same licence, numbered on after the units.
    """
    least, seen, got = table.rows[0][2] if table.rows else 0, {}, []
    for no, unit in enumerate(units(text)):
        if unit in seen:
            found = seen[unit]
        else:
            words = _WORD.findall(unit.lower())
            found = []
            if table.rows and len(words) - 1 >= least:
                own = bigrams(words)
                for r in table.sharing(own):
                    name, b, low, high = table.rows[r]
                    if low <= len(own) <= high:
                        dice = 2.0 * len(own & b) / (len(own) + len(b))
                        if dice >= threshold:
                            found.append((name, dice))
            if len(unit) < 4096:
                seen[unit] = found
        for name, dice in found:
            got.append((name, no))
            yield name, dice, no
    words, spans, no = _WORD.findall(text.lower()), None, no + 1
    grams, runs = list(zip(words, words[1:])), []
    whole = {name for name, u in got if u == 0}  # any run meets the whole text
    for r in table.sharing(set(grams)) if table.rows else ():
        name, b, _, high = table.rows[r]
        for dice, first, last in windows(grams, b, high, threshold) if name not in whole else ():
            spans = spans or (_spans(text) if got else [])
            if not any(n == name and spans[u][0] <= last and first < spans[u][1] for n, u in got):
                runs.append((first, last, name, dice))
    for k, (_, _, name, dice) in enumerate(sorted(runs)):
        yield name, dice, no + k


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, license, dice, unit_no, n_matches, licenses``.

    The best match (highest Dice, then licence name, then unit), the number of (unit, template)
    matches, and all licences found, sorted and comma-joined.

    Nulls: a null or empty text, or one of fewer than two words in each unit, matches nothing: ``license`` and
    ``dice`` are null, ``unit_no`` is -1, ``n_matches`` 0 and ``licenses`` empty.  Repeated rows each give a
    row; a null id is passed on.  An empty table gives no rows.
    """
    common.small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(compiled(templates or all_templates(), threshold))
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {key}, license string, dice double, unit_no int, n_matches int, licenses string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = list(matches(text, table, threshold)) if text else []
                best = min(found, key=lambda m: (-m[1], m[0], m[2]), default=(None, None, -1))
                rows.append((*best, len(found), ",".join(sorted({m[0] for m in found}))))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "license", "dice", "unit_no", "n_matches", "licenses"])

    return common.mapped(docs.select(common.column(docs, id_col).alias("doc_id"), common.column(docs, text_col).cast("string").alias("text")), run, schema)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))


def oracle_sql(templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> str:
    """The same in SQL, comparing every unit with every template whose size lets them reach the threshold; it has no runs of words that aren't units."""
    rows = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, ts in (templates or all_templates()).items() for t in ts)
    words = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH t AS (SELECT license, {pairs} AS b FROM (SELECT license, {words.format("text")} AS w FROM (VALUES {rows}) v(license, text))),
x AS (SELECT doc_id, coalesce(text, '') AS text, regexp_split_to_array(coalesce(text, ''), '\n[ \t]*\n') AS p, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
y AS (SELECT doc_id, unnest([text] || CASE WHEN len(p) > 1 THEN p ELSE [] END || CASE WHEN len(l) > 1 THEN l ELSE [] END) AS unit,
  unnest(range(1 + CASE WHEN len(p) > 1 THEN len(p) ELSE 0 END + CASE WHEN len(l) > 1 THEN len(l) ELSE 0 END)) AS unit_no FROM x),
u AS (SELECT doc_id, unit_no, {pairs} AS b FROM (SELECT doc_id, unit_no, {words.format("unit")} AS w FROM y) WHERE len(w) > 1),
m AS (SELECT doc_id, unit_no, license, 2.0::DOUBLE * len(list_intersect(u.b, t.b)) / (len(u.b) + len(t.b)) AS dice FROM u JOIN t ON len(u.b) BETWEEN len(t.b) * {threshold / (2 - threshold)} - 1e-6 AND len(t.b) * {(2 - threshold) / threshold} + 1e-6
  WHERE len(list_intersect(u.b, t.b)) * 2 >= {threshold} * (len(u.b) + len(t.b)) - 1e-9),
g AS (SELECT doc_id, arg_min((license, dice, unit_no), (-dice, license, unit_no)) AS best, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS ls FROM m GROUP BY doc_id)
SELECT d.doc_id, best[1] AS license, best[2] AS dice, coalesce(best[3], -1)::INT AS unit_no, coalesce(n, 0)::INT AS n_matches, coalesce(ls, '') AS licenses
FROM documents d LEFT JOIN g USING (doc_id)
"""
