"""License scans in DataFrame expressions.

Texts are read as overlapping windows of hashed five-word shingles, one window
length for each size class of templates. A window and a template that agree in
one of the MinHash bands make a candidate; the template's shingles must then be
contained, by their text, to the asked share in the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
#: Bands of one row each. A window that holds a share c of a template of its
#: class has a Jaccard similarity of at least c / 2 / (1.5 + (1 - c) / 2); at
#: c = 0.75 that is 0.23, so 32 bands miss with (1 - 0.23) ** 32 = 0.0002.
BANDS = 32

#: Texts of licenses and notices as they are commonly printed.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_2 = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", APACHE_2],
    "bsd-3-clause": [BSD_3],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3", GPL_3],
    "isc": [ISC],
    "mit": ["Released under the MIT License", MIT],
}


def _words(text: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+", -1), lambda w: w != "")


def _starts(words: F.Column) -> F.Column:
    """Numbers of the words at which a shingle starts."""
    return F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(0), F.size(words) - SHINGLE)).otherwise(F.array().cast("array<int>"))


def _shingles(words: str) -> F.Column:
    return F.transform(_starts(F.col(words)), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))


def _texts(words: str) -> F.Column:
    return F.transform(_starts(F.col(words)), lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " "))


def _ranked(h: F.Column, k: F.Column) -> F.Column:
    return F.xxhash64(h, k)


def _minima(h: F.Column) -> F.Column:
    """(band, key) pairs of a window."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.struct(k.alias("band"), F.array_min(F.transform(h, lambda x: _ranked(x, k))).alias("key")))


def _made(df: DataFrame, **columns: F.Column) -> DataFrame:
    """Adds columns that the optimiser takes as they are: a filter on one would
    otherwise repeat its expression for every element of a lambda."""
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def template_table(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """(license, template, size_class, hashes, shingles) of templates of five
    words or more; the class is the next power of two of their shingles."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(k).alias("template"), F.lit(text).alias("text")) for name, texts in sorted(templates.items()) for k, text in enumerate(texts)])
    table = spark.range(1).select(F.explode(rows).alias("t")).select("t.*")
    table = _made(_made(table, w=_words(F.col("text"))), hashes=F.array_distinct(_shingles("w")), shingles=F.array_distinct(_texts("w")))
    size = F.size("hashes")
    return table.where(size > 0).select("license", "template", F.pow(F.lit(2), F.ceil(F.log2(size.cast("double")))).cast("int").alias("size_class"), "hashes", "shingles")


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, share: float = 0.75) -> DataFrame:
    """(doc_id, license, template, containment, first_word, windows) for each
    template that some window of a document contains to ``share`` or more.

    Words are runs of letters a-z and digits, in lower case. A window of a class
    of size c is 1.5 c shingles long and starts every c / 2, so each occurrence
    lies in one whole; it is verified over half a class more on either side.
    Null, empty and short texts match nothing; repeated rows count together; an
    empty table gives an empty result; extra columns are not read. Templates are
    a parameter of the caller's, and what is broadcast is theirs alone.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates or TEMPLATES)
    bands = table.select("license", "template", "size_class", F.explode(_minima(F.col("hashes"))).alias("b")).select("license", "template", "size_class", "b.band", "b.key")
    # a window's minimum equals a template's only where the shingle behind it stands in the text
    keyed = table.select(F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.transform(F.filter(F.col("hashes"), lambda h: _ranked(h, k) == F.array_min(F.transform(F.col("hashes"), lambda x: _ranked(x, k)))), lambda h: h)))).alias("h"))
    marks = sorted(r.h for r in keyed.distinct().collect())  # of the templates
    classes = sorted(r.size_class for r in table.select("size_class").distinct().collect())
    if not classes:
        return docs.select("doc_id").where("false").selectExpr("doc_id", "'' license", "0 template", "0D containment", "0 first_word", "0L windows")

    hashed = _made(_made(docs.select("doc_id", F.xxhash64("text").alias("row"), F.coalesce("text", F.lit("")).alias("_text")), words=_words(F.col("_text"))), hashes=_shingles("words")).drop("_text")
    held = hashed.where(F.arrays_overlap("hashes", F.array(*map(F.lit, marks)))).select("doc_id", "row", "words", "hashes")

    def windows(c: int) -> F.Column:
        length, stride = c + c // 2, max(1, c // 2)
        starts = F.sequence(F.lit(0), F.size("hashes") - 1, F.lit(stride))
        near = F.filter(starts, lambda i: F.arrays_overlap(F.slice("hashes", i + 1, length), F.array(*map(F.lit, marks))))

        def cut(i):
            first = F.greatest(i - stride, F.lit(0))
            return F.struct(F.lit(c).alias("size_class"), first.alias("at"), F.slice("words", first + 1, length + 2 * stride + SHINGLE - 1).alias("region"), _minima(F.slice("hashes", i + 1, length)).alias("bands"))

        return F.transform(near, cut)

    cut = held.select("doc_id", "row", F.explode(F.flatten(F.array(*[windows(c) for c in classes]))).alias("w"))
    cut = cut.select("doc_id", "row", "w.size_class", "w.at", "w.region", F.explode("w.bands").alias("b"))
    found = cut.select("doc_id", "row", "size_class", "at", "region", "b.band", "b.key").join(F.broadcast(bands), ["size_class", "band", "key"])
    found = found.groupBy("doc_id", "row", "license", "template", "at", "size_class").agg(F.first("region").alias("region"))
    sized = found.join(F.broadcast(table.select("license", "template", "shingles")), ["license", "template"])
    sized = _made(sized, held=F.array_distinct(_texts("region"))).withColumn("containment", F.size(F.array_intersect("held", "shingles")) / F.size("shingles"))
    exact = sized.where(F.col("containment") >= share).withColumn("first_word", F.col("at") + F.coalesce(F.array_min(F.filter(F.transform(F.col("shingles"), lambda s: F.array_position(_texts("region"), s).cast("int")), lambda p: p > 0)) - 1, F.lit(0)))
    return exact.groupBy("doc_id", "license", "template").agg(F.round(F.max("containment"), 6).alias("containment"), F.min("first_word").cast("long").alias("first_word"), F.count("*").alias("windows"))
