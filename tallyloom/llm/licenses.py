"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates are lower-cased words of letters and digits, taken as hashed five-word shingles. A template of m
shingles is looked for in windows of m + s shingles that start every s = max(1, m / 2), so every stretch of m lies whole
in a window. A window that contains four fifths of the template has a Jaccard similarity of at least
0.8 m / (m + s + 0.2 m), about 0.47, to it; with 16 bands of one sample it misses all bands with a probability under
0.53^16 = 4e-5. Retrieved windows are then measured exactly: distinct template shingles in the window over m.

The templates are a table of their names, sizes, shingles and samples: the shingle that hashes least in each band. A
window meets a template in a band if its own least hash is the template's, so it must hold the template's sampled shingle.
The samples therefore index the windows: only windows around sampled shingles are banded, and no other could meet a band.
All other shingles of the templates take no part in retrieval. All work is by row, so nothing is shuffled. DataFrame
functions only; the table is one literal, so the expression is the same for any number of templates.

Defined cases: a null or short text has no license; templates shorter than a shingle are one shingle; repeated rows are
scanned alike; an empty table gives an empty result; other columns pass through, except that ``licenses`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.textcols import boxed, let, unboxed

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS'
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."

# Public license texts and notices, and the short lines that stand for them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": f"{_BSD_TWO} {_BSD_END}",
    "bsd-3-clause": f"{_BSD_TWO} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "bsl-1.0": f"Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit": "Released under the MIT License.",
    "mit-text": f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS} OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
SHINGLE = 5
BANDS = 16
CONTAINMENT = 0.8
FOUND = "array<struct<license:string,start:int,containment:double>>"
TABLE = "array<struct<name:string,size:int,step:int,shingles:array<bigint>,samples:array<bigint>,bands:array<bigint>>>"


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), "")


def shingle_hashes(text: Column) -> Column:
    """Hashes of the runs of SHINGLE words, in order; fewer words are one run, none no run."""
    runs = lambda ws: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(ws) - SHINGLE, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(SHINGLE)]),
    )
    return let(word_list(text), lambda ws: F.when(F.size(ws) > 0, runs(ws)).otherwise(F.array().cast("array<bigint>")))


def _band_hash(shingle: Column, band: Column) -> Column:
    return F.xxhash64(shingle, band)


def _bands() -> Column:
    return F.sequence(F.lit(0), F.lit(BANDS - 1))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """A row for each template: name, size, step of its windows, distinct shingles, and for each band the sampled shingle and its hash."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    rows = rows.withColumn("shingles", F.array_distinct(shingle_hashes(F.col("text"))))
    least = F.transform(_bands(), lambda b: F.array_min(F.transform("shingles", lambda h: F.struct(_band_hash(h, b).alias("hash"), h.alias("shingle")))))
    rows = rows.withColumn("least", least).withColumn("size", F.size("shingles"))
    step = F.greatest(F.lit(1), F.floor(F.col("size") / 2).cast("int"))
    return rows.select("name", "size", step.alias("step"), "shingles", F.transform("least", lambda x: x["shingle"]).alias("samples"), F.transform("least", lambda x: x["hash"]).alias("bands"))


def _windows(hashes: Column, hits: Column, template: Column) -> Column:
    """Starts of the template's windows that hold one of its sampled shingles, from the places of all sampled shingles."""
    step, length = template["step"], template["size"] + template["step"]
    first = lambda p: F.greatest(F.ceil((p - length + 1) / step), F.lit(0)).cast("int")
    mine = F.filter(hits, lambda p: F.array_contains(template["samples"], F.get(hashes, p)))
    return F.array_distinct(F.flatten(F.transform(mine, lambda p: F.sequence(first(p), F.floor(p / step).cast("int")))))


def _matches(hashes: Column, starts: Column, template: Column) -> Column:
    """Windows that meet the template in a band and contain enough of it."""

    def measured(w: Column, held: Column) -> Column:
        meets = F.exists(_bands(), lambda b: F.array_min(F.transform(held, lambda h: _band_hash(h, b))) == F.get(template["bands"], b))
        share = F.when(meets, F.size(F.array_intersect(held, template["shingles"])) / template["size"])
        return F.struct(template["name"].alias("license"), (w * template["step"]).alias("start"), share.alias("containment"))

    window = lambda w: F.slice(hashes, w * template["step"] + 1, template["size"] + template["step"])
    found = F.transform(starts, lambda w: let(window(w), lambda held: measured(w, held)))
    return F.filter(found, lambda m: m["containment"] >= CONTAINMENT)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, every_window: bool = False) -> DataFrame:
    """docs with licenses: for each template found, its name, first word of the best window, and containment.

    every_window bands all windows of all templates, without the index of sampled shingles: the same result, for tests.
    """
    table = template_table(docs.sparkSession, templates or TEMPLATES)
    made = F.from_json(F.lit(table.agg(F.to_json(F.array_sort(F.collect_list(F.struct("*"))))).head()[0]), TABLE)
    samples = sorted({h for row in table.select("samples").collect() for h in row["samples"]})
    hashed = docs.select(boxed(docs), shingle_hashes(F.coalesce("text", F.lit(""))).alias("h_"))

    def matches(h: Column, hits: Column) -> Column:
        every = lambda t: F.sequence(F.lit(0), F.floor((F.size(h) - 1) / t["step"]).cast("int"))
        starts = every if every_window else lambda t: _windows(h, hits, t)
        return F.flatten(F.transform(made, lambda t: let(starts(t), lambda s: _matches(h, s, t))))

    hits = lambda h: F.filter(F.transform(h, lambda x, i: F.when(x.isin(samples), i)), lambda i: i.isNotNull())
    some = F.size("h_") > 0 if every_window else F.size("p_") > 0
    hashed = hashed.withColumn("p_", hits(F.col("h_")))
    seen = hashed.select("row_", F.when(some, matches(F.col("h_"), F.col("p_"))).otherwise(F.array().cast(FOUND)).alias("m_"))
    best = lambda name: F.array_max(
        F.transform(F.filter(F.col("m_"), lambda m: m["license"] == name), lambda m: F.struct(m["containment"].alias("containment"), (-m["start"]).alias("before")))
    )
    listed = F.transform(
        F.array_sort(F.array_distinct(F.transform("m_", lambda m: m["license"]))),
        lambda name: let(best(name), lambda b: F.struct(name.alias("license"), (-b["before"]).alias("start"), b["containment"].alias("containment"))),
    )
    return seen.select(*unboxed(docs, ("licenses",)), listed.alias("licenses"))
