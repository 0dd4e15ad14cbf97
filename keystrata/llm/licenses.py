"""License scan: normalised text against licence templates by Dice coefficient over word bigrams.

A text is cut into paragraphs at lines without a letter or digit (blank ones, or those that
hold comment signs only).  Its units are its lines, its paragraphs of several lines, windows of 2 to
``PARAGRAPHS`` consecutive paragraphs, and the whole text.  A window holds at most as many words as the
largest template allows.  A unit is lower-cased, everything but letters and digits becomes a
space, and its distinct word bigrams A are compared with a template's B:
2 |A n B| / (|A| + |B|) >= 0.8.

A template of b bigrams can only match a unit of 2b/3 to 3b/2 of them, and one that holds at
least 2b/3 of its own.  So texts go before any word is cut, if for every template words
that touch more than a third of its bigrams are missing (``clauses``); units go by size; then units that
hold none of any template's anchors, which are its longest third of bigrams and one more; and each of
the others meets only the templates whose bounds it fits.  All of these are exact.
Spark functions only; nothing but rows of matches is shuffled.

Null and empty texts match nothing.  A unit that matches several templates counts for
the best (ties: the first name), and one that lies in a larger unit that matches doesn't count
beside it.  Repeated rows add up.  Texts have no greatest length: one text is
held by its task as words, about eight times its size.  Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUM, DEN = 4, 5  # Dice of 0.8
PARAGRAPHS = 6  # in a window

_BSD_1_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT_END = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_END = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_UNLICENSE_END = ' Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.' + _MIT_END.replace(" OR COPYRIGHT HOLDERS", "") + " For more information, please refer to <http://unlicense.org/>"


def _gnu(kind: str, version: str, stop: str) -> str:
    return f"This program is free software{stop[0]} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{stop[1]} either version {version} of the License, or (at your option) any later version."


# Licence names and the texts that grant them.  Short licences are whole; besides, notices and those
# paragraphs that stand apart by blank lines and belong to one of these licences only (long licences: their titles).
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "BSD-2-Clause": [_BSD_1_2 + _BSD_END, "Licensed under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "BSD-3-Clause": [_BSD_1_2 + "3. " + _BSD_3, _BSD_1_2 + "3. " + _BSD_3 + _BSD_END, _BSD_3, "Licensed under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _gnu("", "2", ";;"), "This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _gnu("Lesser ", "3", ":,"), "This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.' + _MIT_END, "Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'],
    "MPL-2.0": ['1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.', "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain." + _UNLICENSE_END, "This is free and unencumbered software released into the public domain."],
}


def _bigrams(text: str) -> list[str]:
    words = re.sub(r"[^0-9a-z]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def templates(licences: dict[str, list[str]] | None = None) -> list[tuple[str, list[str]]]:
    """(name, bigrams) of every text that has two words."""
    known = [(name, _bigrams(t)) for name, texts in (TEMPLATES if licences is None else licences).items() for t in texts]
    return [(name, b) for name, b in known if b]


def bounds(size: int) -> tuple[int, int]:
    """The least and the greatest number of bigrams of a unit that can match a template of this many."""
    return -(-NUM * size // (2 * DEN - NUM)), (2 * DEN - NUM) * size // NUM


def clauses(known: list[tuple[str, list[str]]]) -> list[list[tuple[str, ...]]]:
    """For every template groups of words; a text that matches it holds a word of each group.

    The words of a group touch more bigrams than a match may lack.  Long words first, as they are
    rare, and those that other templates' groups have already.
    """
    pool: set[str] = set()
    out = []
    for _, b in sorted(known, key=lambda t: (-len(t[1]), t)):
        slack, touch = len(b) - bounds(len(b))[0], {}
        for i, pair in enumerate(b):
            for w in pair.split(" "):
                touch.setdefault(w, set()).add(i)
        groups, left = [], set(touch)
        while True:
            group, held = [], set()
            while len(held) <= slack and left:
                best = max(left, key=lambda w: (len(touch[w] - held) / 3.0 ** max(0, 8 - len(w)) * (4 if w in pool else 1), w))
                group.append(best)
                held |= touch[best]
                left.remove(best)
            if len(held) <= slack:
                break
            groups.append(tuple(group))
            pool |= set(group)
        groups.sort(key=lambda g: (sum(3.0 ** -len(w) for w in g), g))
        out.append(groups)
    # A template whose groups include all of another's lets no further text through.
    sets = [set(g) for g in out]
    return [g for i, g in enumerate(out) if not any((sets[j] < sets[i]) or (sets[j] == sets[i] and j < i) for j in range(len(out)))]


def _literal(value: str | int | list) -> str:
    """An array of words, or of such arrays, as SQL text: one literal of the plan."""
    return "array(" + ", ".join(map(_literal, value)) + ")" if isinstance(value, list) else repr(value)


def possible(lower: Column, known: list[tuple[str, list[str]]]) -> Column:
    """Whether a text in lower case can hold a unit that matches any template."""
    needed = [[list(g) for g in groups] for groups in clauses(known)]
    pool = F.expr(_literal(sorted({w for groups in needed for g in groups for w in g})))
    # Lambdas, so that a text is cut only once.
    have = F.array(F.array_intersect(F.split(lower, r"[^0-9\p{L}]+"), pool))
    return F.exists(have, lambda words: F.exists(F.expr(_literal(needed)), lambda groups: F.forall(groups, lambda g: F.arrays_overlap(g, words))))


def anchors(known: list[tuple[str, list[str]]]) -> list[str]:
    """Bigrams of which every unit that matches holds one: of each template one more than a match may lack."""
    return sorted({x for _, b in known for x in sorted(b, key=lambda x: (-len(x), x))[: len(b) - bounds(len(b))[0] + 1]})


BLANK = r"\n[^0-9\p{L}]*\n"


UNIT = "array<struct<w: array<string>, low: bigint, high: bigint>>"
LAST = (1 << 32) - 1


def _let(value: Column, body) -> Column:
    """body of a value that is computed once for a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def units(lower: Column, longest: int) -> Column:
    """The units of a text in lower case: words w, and from where (low) to where (high) they reach.

    longest: most words of a window of paragraphs.  A place is paragraph * 2**32 + line.
    """
    words = lambda t: F.split(F.trim(F.regexp_replace(t, r"[^0-9\p{L}]+", " ")), " ")
    some = lambda w: F.element_at(w, 1) != ""
    place = lambda p, line: p.cast("bigint") * (LAST + 1) + line
    unit = lambda w, low, high: F.struct(w.alias("w"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))
    none = F.array().cast(UNIT)
    # Paragraphs of lines of words, without those that have no words.
    parted = F.transform(F.split(lower, BLANK), lambda p: F.filter(F.transform(F.split(p, "\n"), words), some))
    parted = F.filter(parted, lambda p: F.size(p) > 0)

    def with_sizes(parts: Column, whole: Column, short: Column) -> Column:
        n = F.size(whole)
        reach = lambda i, k: F.aggregate(F.slice(short, i, k), F.lit(0), lambda s, x: s + x)
        near = lambda k: F.filter(F.sequence(F.lit(1), n - k + 1), lambda i: reach(i, k) <= longest)
        window = lambda k: F.transform(near(k), lambda i: unit(F.flatten(F.slice(whole, i, k)), place(i, F.lit(0)), place(i + k - 1, F.lit(LAST))))
        windows = F.flatten(F.transform(F.sequence(F.lit(2), F.least(F.lit(PARAGRAPHS), n - 1)), window))
        lines = F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda w, j: unit(w, place(i + 1, j), place(i + 1, j)))))
        several = F.transform(parts, lambda p, i: unit(F.when(F.size(p) > 1, F.flatten(p)), place(i + 1, F.lit(0)), place(i + 1, F.lit(LAST))))
        everything = F.array(unit(F.flatten(whole), F.lit(0), place(n, F.lit(LAST))))
        return F.concat(lines, F.filter(several, lambda u: u["w"].isNotNull()), F.when(n > 2, windows).otherwise(none), F.when(n > 1, everything).otherwise(none))

    sizes = lambda whole: F.transform(whole, lambda w: F.least(F.size(w), F.lit(longest + 1)))
    return _let(parted, lambda parts: _let(F.transform(parts, F.flatten), lambda whole: _let(sizes(whole), lambda short: with_sizes(parts, whole, short))))


def matches(lower: Column, known: list[tuple[str, list[str]]]) -> Column:
    """Array of (license, dice, low, high) of every unit of a text in lower case that matches a template."""
    least = min(bounds(len(b))[0] for _, b in known)
    most = max(bounds(len(b))[1] for _, b in known)
    own = F.filter(units(lower, most + 1), lambda u: F.size(u["w"]) > least)
    pairs = lambda w: F.array_distinct(F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.element_at(w, (i + 2).cast("int")))))
    own = F.transform(own, lambda u: F.struct(pairs(u["w"]).alias("a"), u["low"].alias("low"), u["high"].alias("high")))
    fitting = F.filter(own, lambda u: F.size(u["a"]).between(least, most) & F.arrays_overlap(u["a"], F.expr(_literal(anchors(known)))))
    table = F.expr("array(" + ", ".join(f"named_struct('license', {name!r}, 'b', {_literal(b)}, 'least', {bounds(len(b))[0]}, 'most', {bounds(len(b))[1]})" for name, b in known) + ")")

    def best(u: Column) -> Column:
        a = u["a"]
        near = F.filter(table, lambda t: F.size(a).between(t["least"], t["most"]))
        dice = lambda t: F.size(F.array_intersect(a, t["b"])) * F.lit(2.0) / (F.size(a) + F.size(t["b"]))
        found = F.array_min(F.transform(near, lambda t: F.struct((-F.round(dice(t), 6)).alias("d"), t["license"].alias("license"))))
        return F.struct(found["license"].alias("license"), (-found["d"]).alias("dice"), u["low"].alias("low"), u["high"].alias("high"))

    return F.filter(F.transform(fitting, best), lambda m: m["dice"] >= NUM / DEN)


def widest(found: Column) -> Column:
    """Of matches those that lie in no larger one, each with the best coefficient of all matches of its licence."""
    larger = lambda x, y: (y["low"] <= x["low"]) & (y["high"] >= x["high"]) & ((y["low"] < x["low"]) | (y["high"] > x["high"]))
    best = lambda m, x: F.array_max(F.transform(F.filter(m, lambda y: y["license"] == x["license"]), lambda y: y["dice"]))
    return _let(found, lambda m: F.transform(F.filter(m, lambda x: ~F.exists(m, lambda y: larger(x, y))), lambda x: F.struct(x["license"].alias("license"), best(m, x).alias("dice"))))


def scan(docs: DataFrame, licences: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, license, n_units, dice): the licences found in each document, widest units that match, best coefficient.

    licences: names and texts to look for, whole texts or parts of them; ``TEMPLATES`` if not given.  They are
    part of the plan, so they should be hundreds of texts at most.
    """
    known = templates(licences)
    t = docs.select("doc_id", F.lower(F.col("text").cast("string")).alias("text")).where(possible(F.col("text"), known))
    t = t.select("doc_id", F.explode(widest(matches(F.col("text"), known))).alias("m"))
    return t.groupBy("doc_id", F.col("m.license").alias("license")).agg(F.count("*").alias("n_units"), F.max("m.dice").alias("dice"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    known = templates()
    rows = ", ".join(f"('{n}', ['" + "', '".join(b) + "'])" for n, b in known)
    longest = max(bounds(len(b))[1] for _, b in known) + 1
    return rf"""
WITH tpl(license, b) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL),
p0 AS (SELECT r, doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (SELECT r, doc_id, regexp_split_to_array(t, '\n[^0-9\p{{L}}]*\n') AS p FROM d)),
l AS (SELECT r, doc_id, i, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM (SELECT r, doc_id, i, string_split(p, chr(10)) AS x FROM p0)),
lw AS (SELECT r, doc_id, i, j, string_split(trim(regexp_replace(x, '[^0-9\p{{L}}]+', ' ', 'g')), ' ') AS w FROM l),
ln AS (SELECT * FROM lw WHERE w[1] <> ''),
pw AS (SELECT r, doc_id, i AS p, row_number() OVER (PARTITION BY r ORDER BY i) AS i, count(*) OVER (PARTITION BY r) AS n, lines, w FROM (SELECT r, doc_id, i, count(*) AS lines, flatten(list(w ORDER BY j)) AS w FROM ln GROUP BY r, doc_id, i)),
win AS (SELECT a.r, a.doc_id, a.p, max(b.p) AS q, flatten(list(b.w ORDER BY b.i)) AS w FROM pw a JOIN range(2, {PARAGRAPHS} + 1) t(k) ON k < a.n AND a.i + k - 1 <= a.n JOIN pw b ON b.r = a.r AND b.i BETWEEN a.i AND a.i + k - 1 GROUP BY a.r, a.doc_id, a.p, a.i, k HAVING sum(len(b.w)) <= {longest}),
w AS (
  SELECT row_number() OVER () AS k, * FROM (
    SELECT r, doc_id, i * 4294967296 + j AS low, i * 4294967296 + j AS high, w FROM ln
    UNION ALL SELECT r, doc_id, p * 4294967296, p * 4294967296 + 4294967295, w FROM pw WHERE lines > 1
    UNION ALL SELECT r, doc_id, p * 4294967296, q * 4294967296 + 4294967295, w FROM win
    UNION ALL SELECT r, doc_id, 0, max(p) * 4294967296 + 4294967295, flatten(list(w ORDER BY i)) FROM pw WHERE n > 1 GROUP BY r, doc_id)
), a AS (SELECT * EXCLUDE (w), list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS a FROM w WHERE len(w) >= 2
), m AS (
  SELECT r, k, doc_id, low, high, license, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS dice FROM a, tpl WHERE len(list_intersect(a, b)) > 0
), best AS (SELECT * FROM m WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY k ORDER BY dice DESC, license) = 1
), top AS (SELECT *, max(dice) OVER (PARTITION BY r, license) AS top FROM best
), inner_ones AS (SELECT DISTINCT x.k FROM best x JOIN best y ON x.r = y.r AND y.low <= x.low AND y.high >= x.high AND (y.low < x.low OR y.high > x.high))
SELECT doc_id, license, count(*) AS n_units, CAST(max(top) AS DOUBLE) AS dice FROM top WHERE k NOT IN (SELECT k FROM inner_ones) GROUP BY doc_id, license
"""


ORACLE_OP4 = _oracle()
