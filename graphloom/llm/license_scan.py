"""License notices found by MinHash bands over overlapping windows, then verified exactly.

Texts and templates become words (letters and digits in lower case) and shingles of five
words. Every run of ``size`` shingles is a window; windows overlap at every place. The
minimum of a window under a hash is a band of one row, and a text is a candidate for a
template if any window of it shares any band with one of the template.

The size is chosen so that a text that holds a share ``least`` of a template's shingles must
hold one window whole, which then collides in every band for certain. A template of ``n``
shingles may lose ``x = (1 - least) * n`` of them. A change within it costs four at least (that
many shingles of five words lie across any place), so there are at most ``x // 4`` gaps, and one
of the ``x // 4 + 1`` stretches between them has a length of ``(n - x) / (x // 4 + 1)`` or more. The
largest of the sizes 1, 2, 4 and 8 that fits in it is taken; eight is reached from 24 shingles
on for a share of 0.8. Changes that leave a window only in part are found with probability
``1 - (1 - j)^b`` more, for a share ``j`` of equal shingles and ``b`` bands.

Templates are a table like any other: texts meet its bands in a join, and only candidates are
read a second time and verified against the template's shingles. All of it is DataFrame
expressions. Tables of bands or candidates are broadcast only behind a count of their rows.

Defined results: a text of fewer than five words (null, empty) matches nothing; templates
need five words; repeated rows are reported each; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import written

WORDS = 5
SIZES = (1, 2, 4, 8)
SEEDS = (0, 0x5DEECE66D2B1A9F3)
#: Rows up to which a table of bands or of candidates is broadcast.
BROADCAST = 500_000

#: The wording of public license notices, and of short licenses as a whole.
TEMPLATES: dict[str, str] = {
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}


def templates_in(spark: SparkSession, path: str) -> DataFrame:
    """``(license, text)`` of a folder of text files, each named by its license."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.substring_index("_metadata.file_path", "/", -1), r"\.[^.]*$", "").alias("license"), F.col("value").alias("text"))
    return files


def _table(spark: SparkSession, templates: dict[str, str] | DataFrame) -> DataFrame:
    if isinstance(templates, DataFrame):
        return templates.select("license", "text")
    return spark.createDataFrame(sorted(templates.items()), "license string, text string")


def with_shingles(rows: DataFrame, text_col: str) -> DataFrame:
    """Column ``shingles``: hashes of all runs of five words, in order; empty for fewer words or no text.

    Each step is a column of its own that later steps name several times, so that it is
    computed once per row and not once per use.
    """
    rows = rows.withColumn("_words", F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}]+"))
    rows = rows.withColumn("_words", F.transform(F.filter("_words", lambda w: w != ""), lambda w: F.xxhash64(w)))
    at = F.sequence(F.lit(0), F.size("_words") - WORDS)
    runs = F.transform(at, lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WORDS))))
    return rows.withColumn("shingles", F.when(F.size("_words") >= WORDS, runs).otherwise(F.array().cast("array<bigint>"))).drop("_words")


def with_bands(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """Column ``bands``: for every size and seed the distinct minima of all windows, from ``shingles``.

    A window's minimum is the smaller one of its two halves. A shingle is its own hash under
    the first seed, and the one window of one shingle under all of them.
    """
    kept, parts = rows.columns, []
    for band, seed in enumerate(SEEDS):
        first = "shingles"
        if band:
            first = f"b1_{band}"
            rows = rows.withColumn(first, F.transform("shingles", lambda x, s=seed: F.xxhash64(x, F.lit(s))))
        half, at = first, 1
        while True:
            if at in sizes and (at > 1 or not band):
                parts.append(F.array_distinct(half))
            if at == max(sizes):
                break
            n = F.greatest(F.size(half) - at, F.lit(0))
            rows = rows.withColumn(f"b{2 * at}_{band}", F.zip_with(F.slice(half, F.lit(1), n), F.slice(half, F.lit(at + 1), n), lambda x, y: F.least(x, y)))
            half, at = f"b{2 * at}_{band}", 2 * at
    return rows.withColumn("bands", F.array(*parts)).select(*kept, "bands")


def keys_of(rows: DataFrame, *columns: str) -> DataFrame:
    """``(*columns, part, key)``: each band value with the size and seed that it belongs to.

    The outer forms of explode, since the others filter by the size of the array, which would
    compute all steps once more.
    """
    rows = rows.select(*columns, F.posexplode_outer("bands").alias("part", "values"))
    return rows.select(*columns, "part", F.explode_outer("values").alias("key"))


def window_size(n: Column, least: float) -> Column:
    """The largest size of which a text with the share ``least`` of ``n`` shingles holds one window whole."""
    # the least number of shingles to be found, as verification counts them
    found = F.ceil(F.lit(least) * n)
    stretch = F.ceil(found / (F.floor((n - found) / (WORDS - 1)) + 1))
    return F.greatest(*(F.when(stretch >= s, F.lit(s)).otherwise(1) for s in SIZES))


def prepared(templates: DataFrame, least: float) -> DataFrame:
    """``(license, wanted, n_shingles, size, bands)`` of each template; ``wanted`` are its distinct shingles."""
    rows = with_shingles(templates, "text").withColumn("n_shingles", F.size(F.array_distinct("shingles")).cast("long"))
    short = F.concat(F.lit("template "), "license", F.lit(f" has fewer than {WORDS} words"))
    rows = rows.withColumn("size", F.when(F.col("n_shingles") > 0, window_size(F.col("n_shingles"), least)).otherwise(F.raise_error(short).cast("int")))
    return with_bands(rows, list(SIZES)).select("license", F.array_distinct("shingles").alias("wanted"), "n_shingles", "size", "bands")


#: The size of each part of the bands of all sizes.
PARTS = [*SIZES, *SIZES[1:] * (len(SEEDS) - 1)]


def _bounded(table: DataFrame) -> DataFrame:
    """A table marked for broadcast if it has few rows."""
    return F.broadcast(table) if table.limit(BROADCAST + 1).count() <= BROADCAST else table


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, license, n_shingles, n_found, containment)`` of every template found in every whole text."""
    spark = docs.sparkSession
    known = written(prepared(_table(spark, templates), least), "templates")
    # a template is looked up by the bands of its own size only; texts have bands of all sizes
    of_size = F.get(F.array(*map(F.lit, PARTS)), F.col("part"))
    keys = _bounded(written(keys_of(known, "license", "size").where(of_size == F.col("size")).select("license", "part", "key").distinct(), "bands"))
    # a row is known by its id and its text; equal rows are verified as one and reported each
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_h", F.xxhash64("_text"))
    banded = keys_of(with_bands(with_shingles(rows, "_text").drop("_text"), list(SIZES)), "_id", "_h").join(keys, ["part", "key"]).select("_id", "_h", "license")
    candidates = _bounded(written(banded.distinct(), "candidates"))
    own = candidates.select(F.col("_id").alias("_of"), F.col("_h").alias("_g"), "license")
    met = rows.join(own, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_h") == F.col("_g"))).select("_id", "_text", "license")
    met = with_shingles(met.join(known.select("license", "wanted", "n_shingles"), "license"), "_text")
    # the partition's number keeps the filter from pulling all steps into itself
    met = met.withColumn("n_found", F.size(F.array_intersect("wanted", "shingles")).cast("long")).withColumn("_barrier", F.spark_partition_id())
    met = met.where((F.col("n_found") >= F.lit(least) * F.col("n_shingles")) & (F.col("_barrier") >= 0))
    return met.select(F.col("_id").alias(id_col), "license", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))
