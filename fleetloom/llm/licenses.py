"""Licence scans by Dice coefficient over word bigrams. Native expressions only."""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pick
from .native import hashes, longer

#: The public notices of licences, and the grants, conditions and disclaimers by which their texts are known.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-2.0": ["This program is licensed under the GNU General Public License, version 2."],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Proprietary": ["All rights reserved."],
}

#: ASCII that is neither letter nor digit; what lies between such runs is a word.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a text, sorted."""
    words = [w for w in re.split(BREAK, text.translate(str.maketrans(UPPER, LOWER))) if w]
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(size: int, threshold: Fraction) -> tuple[int, int]:
    """Sizes of bigram sets that can reach the threshold with a set of this size."""
    low, high = size * threshold / (2 - threshold), size * (2 - threshold) / threshold
    return -(-low.numerator // low.denominator), high.numerator // high.denominator


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """(doc_id, license, dice, n_matches): each document's best licence notice.

    A whole text is normalised (A-Z lower-cased, ASCII other than letters and digits between words), and
    spans of it, wherever lines or sentences end, are held as sets of word bigrams against each
    template: 2 * common / (own + template's). Spans begin and end with a bigram of the template, which
    the best ones do anyway, and have as many bigrams as can reach the threshold, so most texts are
    compared with no template. n_matches counts the places where a span that reaches it begins, without
    those less than the template's size after another; license and dice are of the best span, of equals
    the one whose name comes last. Bigrams are told by 64-bit hashes.

    Null, empty or clean text: license null, dice 0, n_matches 0. Null doc_id: kept. Repeated rows stay
    rows. Work grows with a text's length, and with the square of a template's where its words are. No
    documents: no rows.
    """
    known = [(name, bigrams(t)) for name, ts in (templates or TEMPLATES).items() for t in ts]
    known = [(name, grams) for name, grams in known if grams]
    every = sorted({g for _, grams in known for g in grams})
    told = docs.sparkSession.createDataFrame([(g, *g.split(" ")) for g in every], "g string, a string, b string")
    code = {r.g: r.h for r in told.select("g", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).collect()}
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    each = pick(docs, "doc_id", "text").withColumn("w", F.array_remove(F.split(lower, BREAK), ""))
    each = each.withColumn("h", hashes("w")).withColumn("b", longer("h", "h", 2))
    # The places of all templates' bigrams; from here on texts are short.
    each = each.withColumn("hits", F.filter(F.transform("b", lambda x, i: F.struct(x.alias("x"), i.alias("p"))), lambda s: s["x"].isin(list(code.values()))))
    found = []
    for k, (name, grams) in enumerate(known):
        own, n = [code[g] for g in grams], len(grams)
        lo, hi = bounds(n, threshold)
        each = each.withColumn(f"g{k}", F.filter("hits", lambda s: s["x"].isin(own)))  # noqa: B023
        g = f"g{k}"
        least = max(1, lo)  # bigrams that are common to both
        starts = f"filter(sequence(0, size({g}) - {least}), i -> get({g}, i + {least} - 1).p - get({g}, i).p < {hi})"
        dice = f"2.0D * size(array_distinct(transform(slice({g}, i + 1, j - i + 1), x -> x.x))) / (size(array_distinct(slice(b, get({g}, i).p + 1, get({g}, j).p - get({g}, i).p + 1))) + {n})"
        best = f"array_max(transform(filter(sequence(i + {least} - 1, least(size({g}) - 1, i + {hi} - 1)), j -> get({g}, j).p - get({g}, i).p < {hi}), j -> {dice}))"
        t = threshold.numerator / threshold.denominator
        spans = f"filter(transform({starts}, i -> named_struct('dice', {best}, 'name', '{name}', 'p', get({g}, i).p)), x -> x.dice >= {t!r}D)"
        first = f"filter(s, (x, i) -> i = 0 or x.p - get(s, i - 1).p >= {n})"
        empty = "cast(array() as array<struct<dice: double, name: string, p: int>>)"
        each = each.withColumn(f"s{k}", F.expr(f"if(size({g}) >= {least}, {spans}, {empty})"))
        found.append((f"s{k}", f"transform(array(s{k}), s -> size({first}))[0]"))
    top = F.array_max(F.concat(*[F.transform(s, lambda x: F.struct(x["dice"], x["name"])) for s, _ in found]))
    return each.select("doc_id", top.alias("top"), F.expr(" + ".join(n for _, n in found)).cast("long").alias("n_matches")).select("doc_id", F.col("top.name").alias("license"), F.coalesce("top.dice", F.lit(0.0)).alias("dice"), "n_matches")


def op6_license_scan(spark, sf_dir):
    """Contract query of operator 6 over all of documents."""
    from ._common import table

    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = [(n, bigrams(t)) for n, ts in TEMPLATES.items() for t in ts]
    rows = ", ".join(f"({i}, {quoted(n)}, [{', '.join(map(quoted, g))}], {bounds(len(g), Fraction(4, 5))[1]})" for i, (n, g) in enumerate(known))
    return f"""
WITH t(tid, name, g, hi) AS (VALUES {rows}),
tg AS (SELECT tid, unnest(g) AS x FROM t),
d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAK}'), lambda y: y <> '') AS w FROM documents
), b AS (
  SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM d
), e AS (
  SELECT doc_id, unnest(range(1, len(b) + 1)) AS p, unnest(b) AS x FROM b
), h AS (
  SELECT doc_id, tid, p, x FROM e JOIN tg USING (x)
), s AS (
  SELECT l.doc_id, l.tid, l.p AS a, r.p AS z, count(DISTINCT m.x) AS c
  FROM h l JOIN t USING (tid) JOIN h r ON r.doc_id = l.doc_id AND r.tid = l.tid AND r.p >= l.p AND r.p - l.p < t.hi
  JOIN h m ON m.doc_id = l.doc_id AND m.tid = l.tid AND m.p BETWEEN l.p AND r.p GROUP BY ALL
), q AS (
  SELECT doc_id, tid, name, a, len(g) AS n, max(2.0::DOUBLE * c / (len(list_distinct(b[a:z])) + len(g))) AS dice
  FROM s JOIN t USING (tid) JOIN b USING (doc_id) GROUP BY ALL HAVING max(2.0::DOUBLE * c / (len(list_distinct(b[a:z])) + len(g))) >= 0.8
), f AS (
  SELECT *, a - lag(a) OVER (PARTITION BY doc_id, tid ORDER BY a) AS gap FROM q
), r AS (
  SELECT doc_id, count(*) FILTER (WHERE gap IS NULL OR gap >= n) AS n, max(struct_pack(dice := dice, name := name)) AS top FROM f GROUP BY doc_id
)
SELECT d.doc_id, r.top.name AS license, coalesce(r.top.dice, 0) AS dice, coalesce(r.n, 0)::BIGINT AS n_matches
FROM d LEFT JOIN r USING (doc_id)
"""


OP6_SQL = _sql()
