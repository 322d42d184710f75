"""License scans by diagonal voting (DataFrame functions only).

The words of a text and of the license templates are cut into rolling k-grams.  A
join on their hashes gives pairs (place in the text, place in the template); pairs of
one unbroken copy lie on one diagonal (the difference of the two places).  Diagonals
are counted, neighbouring ones (a few words put in or left out) merged, and a merged
span is verified: only grams whose first and last words are those of the template
count, and it is believed if they hold enough of the template's distinct places.

Short phrases are templates of 2-grams that must be whole, so the diagonal of a
whole phrase is the place where it starts.  Long templates use 5-grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower case.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE_K, TEXT_K = 2, 5
#: Diagonals this near each other are one span.
GAP = 4
#: Share of a long template's places that a span must hold, or so many places of it.
COVERAGE, PASSAGE = 0.6, 40

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Public licenses, whole where they are short, else the notice that files bear; by label.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def license_words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, BREAKS), lambda w: w != "")


#: Bits of the map that tells which hashes no template has, and of its words.
MAP_BITS, WORD_BITS = 16, 6


def hash_map(hashes: list[int]) -> Column:
    """A map of MAP_BITS bits as an array of longs: a hash whose bit is not set is none of these."""
    words = [0] * (1 << (MAP_BITS - WORD_BITS))
    for h in hashes:
        bit = h & ((1 << MAP_BITS) - 1)
        words[bit >> WORD_BITS] |= 1 << (bit & 63)
    return F.lit([w - (1 << 64) if w >> 63 else w for w in words])


def _may_be(gram: Column, known: Column) -> Column:
    word = F.get(known, F.shiftright(gram, WORD_BITS).bitwiseAND(F.lit((1 << (MAP_BITS - WORD_BITS)) - 1).cast("long")).cast("int"))
    bit = F.call_function("shiftrightunsigned", word, gram.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return bit.bitwiseAND(F.lit(1).cast("long")) == 1


def _grams(words: str, k: int, known: Column | None = None) -> Column:
    """An array of (place, hash of the k words there, the first and the last of them); none if there are fewer words.

    With a map of known hashes only grams that may be one of them are given.
    """
    n = F.size(words)
    word = lambda i: F.get(words, i.cast("int"))
    at = lambda i: F.xxhash64(F.lit(k), *[word(i + j) for j in range(k)])
    places = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(places, lambda i: F.struct(i.alias("place"), at(i).alias("gram")))
    if known is not None:
        hashed = F.filter(hashed, lambda g: _may_be(g["gram"], known))
    return F.transform(hashed, lambda g: F.struct(g["place"].alias("place"), g["gram"].alias("gram"), word(g["place"]).alias("first"), word(g["place"] + k - 1).alias("last")))


def template_grams(spark: SparkSession, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """template, label, k, n_grams, tplace, gram, first and last (its words). Made of the given texts alone, whatever the corpus."""
    rows = [(f"phrase:{t}", label, PHRASE_K, t) for t, label in phrases.items()] + [(f"text:{label}", label, TEXT_K, t) for label, t in templates.items()]
    given = spark.createDataFrame(rows, "template string, label string, k int, text string").withColumn("words", license_words(F.col("text")))
    parts = []
    for k in (PHRASE_K, TEXT_K):
        cut = given.filter(F.col("k") == k).withColumn("grams", _grams("words", k))
        parts.append(cut.select("template", "label", "k", F.size("grams").alias("n_grams"), F.explode("grams").alias("g")))
    return parts[0].unionByName(parts[1]).select("template", "label", "k", "n_grams", F.col("g.place").alias("tplace"), F.col("g.gram").alias("gram"), F.col("g.first").alias("first"), F.col("g.last").alias("last"))


def spans(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, passage: int = PASSAGE) -> DataFrame:
    """A row for each license passage, and one with a null template for each document.

    doc_id, text_key, n_words, copies (rows of that document and text), template, label,
    k, n_grams, held (distinct template places), start, end (words from 0), places.
    """
    words = docs.select(F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), license_words(F.col("text")).alias("words"))
    # the gram null-safe place -1 marks the document itself, so that one pass over the texts is enough
    itself = F.array(F.struct(F.lit(-1).alias("place"), F.lit(0).cast("long").alias("gram"), F.lit("").alias("first"), F.lit("").alias("last")))
    known = template_grams(docs.sparkSession, phrases, templates)
    # grams that no template can have don't become rows; the templates' own hashes are as few as their words
    map_of = hash_map([r["gram"] for r in known.select("gram").collect()])
    grams = F.concat(itself, _grams("words", PHRASE_K, map_of), _grams("words", TEXT_K, map_of))
    cut = words.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.explode(grams).alias("g"))
    cut = cut.select("doc_id", "text_key", "n_words", F.col("g.place").alias("place"), F.col("g.gram").alias("gram"), F.col("g.first").alias("first_word"), F.col("g.last").alias("last_word"))
    mark = docs.sparkSession.range(1).select(F.lit(None).cast("string").alias("template"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("k"), F.lit(0).alias("n_grams"), F.lit(-1).alias("tplace"), F.lit(0).cast("long").alias("gram"), F.lit("").alias("first"), F.lit("").alias("last"))
    # the templates are a fixed list of the caller's, not data: a few thousand rows at most
    hits = cut.join(F.broadcast(known.unionByName(mark)), "gram").filter((F.col("place") < 0) == (F.col("tplace") < 0))
    # grams of equal hash are verified by their words: those between are the ends of neighbours
    hits = hits.filter((F.col("first_word") == F.col("first")) & (F.col("last_word") == F.col("last"))).drop("first", "last")
    copy = ["doc_id", "text_key", "n_words"]
    diagonal = hits.groupBy(*copy, "template", "label", "k", "n_grams", (F.col("place") - F.col("tplace")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"),
        F.collect_set("tplace").alias("tplaces"),
        F.min("place").alias("first"),
        F.max("place").alias("last"),
    )
    # the null template's row counts how often this very document and text occur
    near = W.partitionBy(*copy, "template").orderBy("diagonal")
    opens = (F.col("k") == PHRASE_K) | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > GAP, F.lit(True))
    merged = diagonal.withColumn("opens", opens.cast("int")).withColumn("span", F.sum("opens").over(near))
    merged = merged.groupBy(*copy, "template", "label", "k", "n_grams", "span").agg(
        F.sum("votes").alias("votes"),
        F.size(F.array_distinct(F.flatten(F.collect_list("tplaces")))).alias("held"),
        F.min("first").cast("long").alias("start"),
        (F.max("last") + F.max("k") - 1).cast("long").alias("end"),
    )
    whole = F.when(F.col("k") == PHRASE_K, F.col("held") == F.col("n_grams")).otherwise((F.col("held") >= coverage * F.col("n_grams")) | (F.col("held") >= passage))
    return merged.filter(F.col("template").isNull() | whole).drop("span")


def scan(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Needs doc_id and text; other columns are ignored.  A null or empty text has no words,
    no places and score 0.  Equal rows give equal results; an empty table gives none.
    score: the largest share of a template (a phrase: 1) that a believed span holds.
    """
    found = spans(docs, **options)
    phrase = F.col("template").startswith("phrase:")
    per = found.groupBy("doc_id", "text_key", "n_words").agg(
        F.max(F.when(F.col("template").isNull(), F.col("votes"))).alias("copies"),
        # equal rows share a group; each phrase place was voted for once by each of them
        F.count(F.when(phrase, 1)).alias("n_base"),
        F.min(F.when(phrase, F.col("start"))).alias("first_word"),
        F.max(F.when(phrase, F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(phrase, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("template").isNotNull(), F.col("held") / F.col("n_grams"))), F.lit(0.0)).alias("score"),
    )
    one = per.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__row"))
    return one.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
