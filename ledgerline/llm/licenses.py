"""License scans by MinHash bands over overlapping text windows, with DataFrame functions alone.

Texts and templates become word shingles. A text is read in windows of 2 * BLOCK shingles, each of
which overlaps the next by half; a template is cut into parts of BLOCK shingles, so that a copy of a
part lies whole in some window. Windows and parts that agree on a band, that is on the minimum of one
hash function, retrieve the template; it is then verified exactly around the retrieved windows: it is a
match if some stretch of the text holds a share of CONTAINED of its distinct shingles. A stretch starts
at a multiple of BLOCK shingles and is a quarter longer than the template, and one block more, so that
words may be inserted; shingles that lie scattered over a text make no match.

There are BANDS bands of one minimum. Of a template that is held to 0.8, some part has all of its four
shingles in the text, or it has at most 15 and some part has three of four; a window with them agrees
on a band with probability 3 / 9 or more, and a template of three shingles in all with 3 / 8, so that a
match is missed by all bands with probability (6 / 9) ** 32, under 0.000003. That supposes no words put
between those shingles; a template has as many chances as parts of which that is true.
Windows without any shingle of any template can't agree on a band and aren't hashed for one.

Templates are a list of fixed size that goes to all tasks; texts are scanned in place and not shuffled.

Defined results: null, empty and wordless texts match nothing; a text of fewer words than a shingle
matches only templates that are as short and equal; repeated rows are scanned as rows of their own;
without templates the result is empty; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 3
BLOCK = 4
BANDS = 32
CONTAINED = 0.8

# Fixed texts: license texts and the notices by which documents refer to licenses.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation"
_GNU_END = "{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
_CREATIVE = "This work is licensed under the Creative Commons {0} 4.0 International License"
TEMPLATES = {
    "0BSD": _ISC + ". " + _ISC_END,
    "AGPL-3.0-notice": "This program is free software: " + _GNU.format("Affero General Public License") + ", either version 3 of the License, or (at your option) any later version. " + _GNU_END.format("This program", "Affero General Public License"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-terms": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TWO + _BSD_END,
    "BSD-3-Clause": _BSD_HEAD + _BSD_TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "BSD-conditions": _BSD_HEAD,
    "BSL-1.0": "Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "Beerware": "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return.",
    "CC-BY-4.0": _CREATIVE.format("Attribution"),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-4.0-notice": _CREATIVE.format("Attribution-NonCommercial"),
    "CC-BY-NC-ND-4.0-notice": _CREATIVE.format("Attribution-NonCommercial-NoDerivatives"),
    "CC-BY-NC-SA-4.0-notice": _CREATIVE.format("Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND-4.0-notice": _CREATIVE.format("Attribution-NoDerivatives"),
    "CC-BY-SA-4.0-notice": _CREATIVE.format("Attribution-ShareAlike"),
    "CC0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "GPL-2.0-notice": "This program is free software; " + _GNU.format("General Public License") + "; either version 2 of the License, or (at your option) any later version. " + _GNU_END.format("This program", "General Public License"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: " + _GNU.format("General Public License") + ", either version 3 of the License, or (at your option) any later version. " + _GNU_END.format("This program", "General Public License"),
    "GPL-notice": "This program is free software: " + _GNU.format("General Public License"),
    "ISC": _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END,
    "LGPL-2.1-notice": "This library is free software; " + _GNU.format("Lesser General Public License") + "; either version 2.1 of the License, or (at your option) any later version. " + _GNU_END.format("This library", "Lesser General Public License"),
    "MIT": "Released under the MIT License",
    "MIT-full": _GRANT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-grant": _GRANT,
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def words_of(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def shingles(words: Column) -> Column:
    """Hashes of runs of WIDTH words, in order; fewer words are one shingle."""
    n = F.size(words)
    after = lambda k: F.slice(words, k, F.greatest(n - (WIDTH - 1), F.lit(0)))
    runs = F.transform(F.arrays_zip(*[after(k + 1).alias(f"w{k}") for k in range(WIDTH)]), lambda r: F.xxhash64(*[r[f"w{k}"] for k in range(WIDTH)]))
    return F.when(n >= WIDTH, runs).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def _keys(window: Column) -> Column:
    """The bands of a window, each as a hash of its number and its minimum."""
    bands = F.sequence(F.lit(1), F.lit(BANDS))
    return F.transform(bands, lambda j: F.xxhash64(j, F.array_min(F.transform(window, lambda h: F.xxhash64(h, j)))))


def _starts(hashes: Column) -> Column:
    """Numbers of the blocks of a list of shingles."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(F.size(hashes) / BLOCK) - 1, F.lit(0)).cast("int"))


def _run(hashes: Column, block: Column, blocks: int | Column) -> Column:
    return F.slice(hashes, block * BLOCK + 1, F.lit(blocks) * BLOCK)


def prepare(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """Of each template: name, band keys, distinct shingles and the blocks of a stretch that is to hold it."""
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("text")) for k, v in sorted(templates.items())])).alias("t"))
    rows = rows.select("t.name", shingles(words_of(F.col("t.text"))).alias("inner")).filter(F.size("inner") > 0)
    keys = F.array_distinct(F.flatten(F.transform(_starts(F.col("inner")), lambda b: _keys(_run(F.col("inner"), b, 1)))))
    blocks = (F.ceil(1.25 * F.size("inner") / BLOCK) + 1).cast("int")
    return [r.asDict() for r in rows.select("name", keys.alias("keys"), F.array_distinct("inner").alias("shingles"), blocks.alias("blocks")).collect()]


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", contained: float = CONTAINED) -> DataFrame:
    """(doc_id, license, n_found, n_shingles): a row for each document and template that it holds, with the most shingles in a stretch."""
    known = prepare(docs.sparkSession, templates) if templates else []
    if not known:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("license"), F.lit(0).cast("long").alias("n_found"), F.lit(0).cast("long").alias("n_shingles")).limit(0)
    listed = F.from_json(F.lit(json.dumps(known)), "array<struct<name: string, keys: array<bigint>, shingles: array<bigint>, blocks: int>>")
    anything = F.from_json(F.lit(json.dumps(sorted({x for t in known for x in t["shingles"]}))), "array<bigint>")
    hashes = F.col("hashes")
    # explode of one element, so that what stands on top doesn't work out words, shingles and shared ones again, these for each window
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(words_of(F.col(text_col)))).alias("words")).select("doc_id", F.explode(F.array(shingles(F.col("words")))).alias("hashes"))
    near = rows.select("doc_id", "hashes", F.explode(F.array(F.array_intersect(hashes, anything))).alias("shared")).filter(F.size("shared") > 0)
    windows = F.filter(_starts(hashes), lambda b: F.arrays_overlap(_run(hashes, b, 2), F.col("shared")))
    met = near.withColumn("windows", F.transform(windows, lambda b: F.struct(b.alias("block"), _keys(_run(hashes, b, 2)).alias("keys"))))

    def most(t: Column) -> Column:
        retrieved = F.filter("windows", lambda w: F.arrays_overlap(w["keys"], t["keys"]))
        starts = F.array_distinct(F.flatten(F.transform(retrieved, lambda w: F.sequence(F.greatest(w["block"] - t["blocks"] + 1, F.lit(0)), w["block"] + 1))))
        return F.array_max(F.transform(starts, lambda s: F.size(F.array_intersect(t["shingles"], _run(hashes, s, t["blocks"])))))

    found = F.transform(listed, lambda t: F.struct(t["name"].alias("license"), most(t).cast("long").alias("n_found"), F.size(t["shingles"]).cast("long").alias("n_shingles")))
    return met.select("doc_id", F.explode(F.filter(found, lambda m: m["n_found"] >= contained * m["n_shingles"])).alias("m")).select("doc_id", "m.*")
