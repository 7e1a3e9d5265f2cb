"""License scan: an exact set-similarity join of text blocks with license templates, native only.

The words of the templates are ordered by the number of documents that have them, rarest first, over
all documents.  A block that holds the threshold share of a template's words must hold
one of its few rarest ones (prefix filter), have enough words (length filter), and have enough
left after the first one in common (positional filter); what passes is counted exactly.  The
template index has the size of the template list, so the join is map-side: no shuffle of text.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import table, text_of
from keysift.llm.secrets import let

# The phrases every scan counts, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: What parts words, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Texts of licenses and notices.
TEXTS = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
        OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
        WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions
        in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
        EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
        AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
        OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
        from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
        it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim
        that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
        is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This
        notice may not be removed or altered from any source distribution.""",
    ),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
        copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed
        under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
        useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details. You should have received a copy of the GNU General Public License along with this program.""",
    ),
    (
        "public-domain",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
        this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions
        that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We
        make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt
        act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    ),
)

#: Templates, (label, text), of any length.  A list of the caller's own may take its place.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided"),
    ("bsd", "released under the bsd license"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("reserved", "copyright all rights reserved"),
    *TEXTS,
)
#: Share of a template's distinct words a block must hold.
THRESHOLD = 0.9
#: A block is a window of so many words; windows begin every half of that.  A longer template has blocks of the least doubling
#: of it whose half holds the template, so every run of as many words lies within a block.
BLOCK_WORDS = 40


def lowered(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(column: Column) -> Column:
    """The words of a text; of a text without any, an empty array."""
    line = F.trim(F.regexp_replace(lowered(column), BETWEEN, " "))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def strings(values: list[str]) -> Column:
    """An array of strings as one literal."""
    return F.split(F.lit(" ".join(values)), " ") if values else F.array().cast("array<string>")


def frequencies(tokenised: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that have each word of the templates; one number for each comes to the driver."""
    own = tokenised.select(F.explode(F.array_intersect("words", strings(vocabulary))).alias("word"))
    return {r["word"]: r["count"] for r in own.groupBy("word").count().collect()}


def template_words(text: str) -> list[str]:
    """The words of a template, as those of a text."""
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    return re.sub(BETWEEN, " ", lower).split(" ") if re.sub(BETWEEN, "", lower) else []


def block_words(text: str) -> int:
    """Words in the blocks that a template is held against."""
    n, size = len([w for w in template_words(text) if w]), BLOCK_WORDS
    while size < 2 * n:
        size *= 2
    return size


class Index:
    """Templates of one block size under a global word order: words are numbered from 1, the rarest first."""

    def __init__(self, templates, counts: dict[str, int], threshold: float, size: int = BLOCK_WORDS) -> None:
        self.size = size
        sets = [(label, sorted({w for w in template_words(text) if w})) for label, text in templates]
        self.order = sorted({w for _, s in sets for w in s}, key=lambda w: (counts.get(w, 0), w))
        at = {w: i for i, w in enumerate(self.order, 1)}
        self.rows = []
        for label, own in sets:
            ranks = sorted(at[w] for w in own)
            need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            self.rows.append((label, ranks, need, ranks[: len(ranks) - need + 1]))
        self.prefix_words = sorted({self.order[r - 1] for row in self.rows for r in row[3]})

    def column(self) -> Column:
        """Array of (label, ranks, need, prefix), a constant."""
        numbers = lambda values: F.array(*map(F.lit, values))
        return F.array(
            *[
                F.struct(F.lit(label).alias("label"), numbers(ranks).alias("ranks"), F.lit(need).alias("need"), numbers(prefix).alias("prefix"))
                for label, ranks, need, prefix in self.rows
            ]
        )


def _matches(own: Column, index: Index) -> Column:
    """Array of (label, containment) of the templates that some block of a document's words meets."""
    half = index.size // 2
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(own) - 1), F.lit(half))

    def block(start: Column) -> Column:
        common = F.array_intersect(F.slice(own, start + 1, index.size), strings(index.order))
        ranks = F.sort_array(F.transform(common, lambda w: F.array_position(strings(index.order), w).cast("int")))

        def joined(have: Column) -> Column:
            def meets(t: Column) -> Column:
                # Prefix filter: the first word in common, if any, is one of the template's rarest.
                first = F.array_min(F.array_intersect(t["prefix"], have))
                template_left = F.size(t["ranks"]) - F.array_position(t["ranks"], first)
                block_left = F.size(have) - F.array_position(have, first)
                return (
                    (F.size(have) >= t["need"])
                    & first.isNotNull()
                    & (1 + F.least(template_left, block_left) >= t["need"])
                    & (F.size(F.array_intersect(t["ranks"], have)) >= t["need"])
                )

            found = F.filter(index.column(), meets)
            return F.transform(found, lambda t: F.struct(t["label"].alias("label"), (F.size(F.array_intersect(t["ranks"], have)) / F.size(t["ranks"])).alias("share")))

        return let(ranks, joined)

    return F.flatten(F.transform(starts, block))


def _places(own: Column) -> Column:
    """Array of (place, label) of all phrases."""

    def at(word: Column, i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in PHRASES.items():
            first, *rest = phrase.split()
            same = word == first
            for k, other in enumerate(rest, 1):
                same = same & (F.get(own, i + k) == other)
            label = F.when(same, F.lit(name)).otherwise(label)
        return F.struct(i.cast("long").alias("place"), label.alias("label"))

    return F.filter(F.transform(own, at), lambda x: x["label"].isNotNull())


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share of a matching template's words in a block, 0 where none matches.
    Null text counts as empty: no words, no labels.  A null doc_id stays null, repeated rows get a
    row each, an empty table gives no rows, other columns are ignored.  Texts are looked at whole.
    """
    # A template without a word is met by nothing.
    templates = [(label, text) for label, text in templates if template_words(text)]
    vocabulary = sorted({w for p in PHRASES for w in p.split()} | {w for _, text in templates for w in template_words(text) if w})
    tokenised = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(text_of()).alias("words"))
    counts = frequencies(tokenised, vocabulary)
    sizes = sorted({block_words(text) for _, text in templates})
    indexes = [Index([t for t in templates if block_words(t[1]) == size], counts, threshold, size) for size in sizes]
    own = F.col("words")
    triggers = sorted({min(p.split(), key=lambda w: (counts.get(w, 0), w)) for p in PHRASES})
    nothing = F.array().cast("array<struct<place:bigint,label:string>>")
    no_match = F.array().cast("array<struct<label:string,share:double>>")
    found = tokenised.select(
        "doc_id",
        F.size(own).cast("long").alias("n_words"),
        # Every phrase has one of its rarest words, every match a prefix word; most documents have neither.
        F.when(F.arrays_overlap(own, strings(triggers)), _places(own)).otherwise(nothing).alias("base"),
        F.concat(no_match, *[F.when(F.arrays_overlap(own, strings(index.prefix_words)), _matches(own, index)).otherwise(no_match) for index in indexes]).alias("found"),
    )
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.place").alias("first_word"),
        F.array_max("base.place").alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.concat("base.label", "found.label")).alias("labels"),
        F.coalesce(F.array_max("found.share"), F.lit(0.0)).alias("score"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in SQL: every template against every window of its size, without any filter."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    values = []
    for label, text in templates:
        own = [w for w in template_words(text) if w]
        words = ", ".join(quoted(w) for w in sorted(set(own)))
        values.append(f"({quoted(label)}, [{words}], {block_words(text)}, {max(1, math.ceil(threshold * len(set(own)) - 1e-9))})")
    places = []
    for phrase, label in PHRASES.items():
        same = " AND ".join(f"words[i + {k}] = {quoted(w)}" for k, w in enumerate(phrase.split()))
        places.append(f"SELECT doc_id, i - 1 AS place, {quoted(label)} AS label FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w) WHERE {same}")
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), base AS ({" UNION ALL ".join(places)}),
templates(label, own, size, need) AS (VALUES {", ".join(values)}),
blocks AS (
  SELECT doc_id, size, list_distinct(words[start + 1:start + size]) AS block FROM
  (SELECT doc_id, words, size, unnest(range(0, greatest(1, len(words)), size // 2)) AS start FROM w, (SELECT DISTINCT size FROM templates))
), found AS (
  SELECT doc_id, label, max(share) AS share FROM
  (SELECT doc_id, label, len(list_intersect(block, own)) AS common, need, len(list_intersect(block, own)) / len(own) AS share FROM blocks JOIN templates USING (size))
  WHERE common >= need GROUP BY doc_id, label
), counted AS (
  SELECT doc_id, count(*) AS n, min(place) AS first, max(place) AS last, list(DISTINCT label) AS labels FROM base GROUP BY doc_id
), met AS (SELECT doc_id, list(label) AS labels, max(share) AS score FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(counted.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(counted.labels, []), coalesce(met.labels, [])))), ','), '') AS labels,
       coalesce(score, 0.0) AS score
FROM w LEFT JOIN counted USING (doc_id) LEFT JOIN met USING (doc_id)
"""


#: Equal to op7_licenses for tables without repeated ids.
ORACLE = oracle()
