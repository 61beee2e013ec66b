"""License scans with built-in functions only.

Words are runs of ASCII letters and digits of the lower-cased text; shingles are five words. Texts are cut into windows
of 16 shingles that overlap by half; templates of ``LONG`` = 24 shingles or more are cut into windows of 16 at every
shingle, so that a text window inside a whole copy has a template window with the very same shingles. A window's signature
is four MinHash values, a band each: the least and the greatest hash, and the same after an exclusive or. Equal windows
share all bands; a window that one changed word cuts from 16 shingles to 11 in common, a similarity of 11 / 21, is missed
with probability (10 / 21) ** 4, under 0.06, and any one of the copy's windows is enough. In shorter templates and for
them, windows are single shingles, where one band is certain.

Retrieved templates are then verified exactly: the distinct shingles of the template that stand in the document, within
the stretch where a whole copy could stand, over the template's shingles, must be 0.8 or more.

Scale: one narrow pass over the texts. Template signatures are constants of the plan; their number is checked against
``MOST_BANDS`` and depends on the catalog only. No row is exploded but for windows that hit.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
WINDOW = 16
LONG = 24
BANDS = 4
#: Turns the order of hashes over for the second pair of bands.
MASK = 0x5A5A_A5A5_3C3C_C3C3
LEAST = 0.8
MOST_BANDS = 20_000

#: Short notices of public licences, as their stewards word them.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "LGPL-3.0-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>",
}


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingles(text: Column) -> Column:
    """64-bit hashes of the five-word shingles in order; none if there are fewer words."""
    hashes = F.transform(F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), ""), lambda w: F.xxhash64(w))
    at = lambda h, i, k: F.get(h, i + k)
    made = lambda h: F.transform(F.slice(h, 1, F.greatest(F.lit(0), F.size(h) - (SHINGLE - 1))), lambda a, i: F.xxhash64(a, *(at(h, i, k) for k in range(1, SHINGLE))))
    return _let(hashes, made)


def _windows(shingles: Column, step: int) -> Column:
    """(first, mins) of each window of ``WINDOW`` shingles, one every ``step``; the last ones may be shorter."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(shingles) - 1), F.lit(step))
    cut = lambda x, s: F.slice(x, s + 1, F.lit(WINDOW))
    both = lambda h: F.array(h, F.transform(h, lambda x: x.bitwiseXOR(F.lit(MASK))))
    mins = lambda a, b: F.array(F.array_min(a), F.array_max(a), F.array_min(b), F.array_max(b))
    made = lambda p: F.transform(starts, lambda s: F.struct(s.alias("first"), mins(cut(F.get(p, F.lit(0)), s), cut(F.get(p, F.lit(1)), s)).alias("mins")))
    return _let(_let(shingles, both), made)


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license, shingles, windows) of the catalog: the MinHash values of each window; one shingle each for short ones."""
    texts = TEMPLATES if texts is None else texts
    df = spark.createDataFrame(list(texts.items()), "license string, text string")
    df = df.select("license", _shingles(F.col("text")).alias("shingles")).where(F.size("shingles") > 0)
    cut = F.when(F.size("shingles") < LONG, F.transform("shingles", lambda h: F.array(h))).otherwise(F.transform(_windows(F.col("shingles"), 1), lambda w: w["mins"]))
    return df.select("license", "shingles", cut.alias("windows"))


def scan(docs: DataFrame, texts: dict[str, str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, license, n_template, n_found, containment, first_shingle): the licences of which a document holds 0.8 or
    more of the shingles, with the place of the best copy.

    Null, empty and wordless texts hold none. Rows that repeat a key give their rows each; null keys are kept; other
    columns are not read. An empty table, or an empty catalog, gives no rows.
    """
    spark = docs.sparkSession
    catalog = templates(spark, texts).collect()  # a row for each template
    found: dict[tuple[int, int], set[str]] = {}  # band -1: the shingles of short templates
    sets: dict[str, list[int]] = {}
    for r in catalog:
        sets[r.license] = list(dict.fromkeys(r.shingles))
        for b, m in ((b, m) for mins in r.windows for b, m in enumerate(mins)):
            found.setdefault((b if len(r.shingles) >= LONG else -1, m), set()).add(r.license)
    if len(found) > MOST_BANDS:
        raise ValueError(f"the catalog has {len(found)} bands; scan it in parts of {MOST_BANDS} at most")

    if not found:
        return docs.limit(0).select(F.col(f"`{key}`").alias(key), *(F.lit(None).cast(k).alias(n) for n, k in (("license", "string"), ("n_template", "long"), ("n_found", "long"), ("containment", "double"), ("first_shingle", "long"))))
    values = {k: sorted({m for b, m in found if b == k}) for k in range(-1, BANDS)}
    as_hit = lambda first, band, m: F.struct(first.cast("int").alias("first"), F.lit(band).alias("band"), m.alias("m"))
    band = lambda w, k: F.get(w["mins"], F.lit(k))
    any_ = lambda w: F.coalesce(*(F.when(band(w, k).isin(values[k]), True) for k in range(BANDS)), F.lit(False))
    met = lambda w: F.array(*(F.when(band(w, k).isin(values[k]), as_hit(w["first"], k, band(w, k))) for k in range(BANDS)))
    known = lambda xs: F.filter(xs, lambda x: x.isNotNull())

    def retrieves(h: Column) -> Column:
        tests = [F.exists(h, lambda x: x.isin(values[-1]))] * bool(values[-1]) + [F.exists(_windows(h, WINDOW // 2), any_)] * bool(values[0])
        return F.greatest(*tests) if len(tests) > 1 else tests[0]

    def retrieved(h: Column) -> Column:
        alone = known(F.transform(h, lambda x, i: F.when(x.isin(values[-1]), as_hit(i, -1, x)))) if values[-1] else None
        windows = known(F.flatten(F.transform(F.filter(_windows(h, WINDOW // 2), any_), met))) if values[0] else None
        return F.concat(*(x for x in (alone, windows) if x is not None))

    # the first filter sees every text; what follows it works on the few that hit
    hits = docs.where(_let(_shingles(F.col(f"`{text}`")), retrieves))
    rows = hits.select(F.col(f"`{key}`").alias(key), _shingles(F.col(f"`{text}`")).alias("_h"))
    rows = rows.withColumn("_hits", retrieved(F.col("_h")))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    hit = rows.select(key, "_row", "_h", F.explode("_hits").alias("hit")).select(key, "_row", "_h", "hit.first", "hit.band", "hit.m")
    names = spark.createDataFrame([(b, m, n) for (b, m), ns in sorted(found.items()) for n in sorted(ns)], "band int, m long, license string")
    hit = hit.join(F.broadcast(names), ["band", "m"])
    sizes = spark.createDataFrame([(n, x) for n, x in sorted(sets.items())], "license string, _t array<long>")
    hit = hit.select(key, "_row", "_h", "license", "first").join(F.broadcast(sizes), "license")
    # any copy that this window belongs to stands within a template's length of it
    near = F.greatest(F.lit(0), F.col("first") - F.size("_t"))
    region = F.slice("_h", near + 1, 2 * F.size("_t") + WINDOW)
    shared = F.array_intersect(region, F.col("_t"))
    hit = hit.withColumn("_shared", shared).withColumn("n_found", F.size("_shared").cast("long"))
    at = near + F.array_position(F.transform(region, lambda h: F.array_contains(F.col("_shared"), h)), F.lit(True)) - 1
    hit = hit.where(F.col("n_found") * 10 >= F.size("_t") * 8).select(key, "_row", "license", F.size("_t").cast("long").alias("n_template"), "n_found", at.cast("long").alias("at"))
    best = hit.groupBy("_row", key, "license", "n_template").agg(F.max(F.struct("n_found", (-F.col("at")).alias("at"))).alias("best"))
    return best.select(key, "license", "n_template", F.col("best.n_found").alias("n_found"), (F.col("best.n_found") / F.col("n_template")).alias("containment"), (-F.col("best.at")).alias("first_shingle"))
