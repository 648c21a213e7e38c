"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line of a file, every two and three neighbouring lines, and every block (a run of
lines without an empty one between, of any length) are headers to be compared with the
templates; in licence files (LICENSE, COPYING and the like) the text as a whole is
compared too.  Templates are notices, usual headers, titles, and the texts of the short
licenses, whole and by their blocks.  Weights come from
the document frequencies of all words over all files.  Lines that share none
of the words without which no cosine can reach the threshold are passed over, which
loses nothing.  A file without a license of its own gets that of the nearest directory
above it that has a licence file.  All steps are DataFrame operations.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import store
from quillon.llm.store import small, unused

# Notices by license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "LGPL-2.1": "under the terms of the GNU Lesser General Public License version 2.1",
}
MIT_TEXT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
BSD_TEXT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "http://www.apache.org/licenses/LICENSE-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
)
_FSF = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation; either version {3} of the License, or (at your option) any later version."
_FSF_END = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
# Titles, usual headers, and the texts of the short licenses, whole and by the blocks that no other license shares.
TEXTS = {
    "Apache-2.0": ("Apache License", "Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", APACHE_HEADER[0], " ".join(APACHE_HEADER)),
    "MIT": ("MIT License", "The MIT License", MIT_TEXT[0], " ".join(MIT_TEXT), "MIT License Copyright (c) " + " ".join(MIT_TEXT)),
    "GPL-3.0": ("GNU General Public License Version 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "The GNU General Public License is a free, copyleft license for software and other kinds of works.", _FSF.format("program", ":", "General Public License", "3"), " ".join((_FSF.format("program", ":", "General Public License", "3"), _FSF_END.format("program", "General Public License")))),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International", "Creative Commons Attribution-NonCommercial 4.0 International Public License", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International", "Creative Commons Attribution 4.0 International Public License", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", BSD_TEXT[3], " ".join(BSD_TEXT), "BSD 3-Clause License Copyright (c) All rights reserved. " + " ".join(BSD_TEXT)),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "GNU Lesser General Public License Version 2.1", _FSF.format("library", ";", "Lesser General Public License", "2.1"), " ".join((_FSF.format("library", ";", "Lesser General Public License", "2.1"), _FSF_END.format("library", "Lesser General Public License")))),
}
# Identifiers as they stand in source files, as one word (see ``tokens``).
SPDX = {"Apache-2.0": ("apache20",), "MIT": ("mit",), "GPL-3.0": ("gpl30", "gpl30only", "gpl30orlater"), "CC-BY-NC-4.0": ("ccbync40",), "CC-BY-4.0": ("ccby40",), "BSD-3-Clause": ("bsd3clause",), "MPL-2.0": ("mpl20",), "LGPL-2.1": ("lgpl21", "lgpl21only", "lgpl21orlater")}
SPDX_TAG = r"(?i)spdx-license-identifier:[ \t]*([a-z0-9]+)[-.+]?([a-z0-9]*)[-.+]?([a-z0-9]*)[-.+]?([a-z0-9]*)[-.+]?([a-z0-9]*)[-.+]?([a-z0-9]*)"
LICENSE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice)(?:\.[a-z]+)?$"
LEAST = 0.7


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; an SPDX tag with its identifier is one word."""
    plain = F.when(F.contains(F.lower(text), F.lit("spdx-")), F.regexp_replace(text, SPDX_TAG, "spdx$1$2$3$4$5$6 ")).otherwise(text)
    return F.filter(F.split(F.lower(plain), "[^a-z0-9]+"), lambda w: w != "")


def windows(files: DataFrame) -> DataFrame:
    """``path``, ``k``, ``w``: the words of each line, of each two and three neighbouring ones, of each longer block between empty lines, and of a licence file's whole text."""
    blocks = F.filter(F.split("text", "\n(?:[^A-Za-z0-9\n]*\n)+"), lambda b: b.rlike(r"\n[^\n]*\n[^\n]*\n"))
    whole = F.when(F.col("path").rlike(LICENSE_FILE), F.array(F.col("text"))).otherwise(F.array().cast("array<string>"))
    # Columns, as expressions would be worked out anew for each window.
    d = files.select("path", F.transform(F.split("text", "\n"), tokens).alias("x"), F.transform(F.concat(blocks, whole), tokens).alias("y"))
    few = lambda x, start, less: F.slice(x, start, F.greatest(F.size("x") - less, F.lit(0)))
    two = lambda less: F.zip_with(few("x", 1, less), few("x", 2, less), lambda a, b: F.concat(a, b))
    three = F.zip_with(two(2), few("x", 3, 2), lambda a, b: F.concat(a, b))
    return d.select("path", F.posexplode(F.concat("x", two(1), three, "y")).alias("k", "w"))


def vectors(df: dict[str, int], n: int, templates: dict[str, str]) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """Weights of the templates' words, and unit vectors of the templates.

    A word that stands ``m`` times counts as 1 + ln(m), so that texts aren't told by their articles.
    """
    count = {k: Counter(re.findall("[a-z0-9]+", t.lower())) for k, t in templates.items()}
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for c in count.values() for w in c}
    unit = {}
    for k, c in count.items():
        x = {w: (1 + math.log(m)) * idf[w] for w, m in c.items()}
        norm = math.sqrt(sum(y * y for y in x.values()))
        unit[k] = {w: y / norm for w, y in x.items()}
    return idf, unit


def gates(unit: dict[str, dict[str, float]], least: float, light: float = 0.1) -> list[tuple[dict[str, float], int, float]]:
    """For each template: the squared weights of its heavy words, and how many of them, and what sum, a text must have for a cosine of ``least``.

    A cosine is at most the root of the squares of the template's weights whose words the text has.
    The lightest words, whose squares add up to ``light`` at most, are left out and taken to be there.
    """
    out = []
    for v in unit.values():
        words = sorted(v, key=lambda w: (v[w], w))
        rest = 0.0
        while rest + v[words[0]] ** 2 <= light:
            rest += v[words.pop(0)] ** 2
        goal = least * least - rest - 1e-9
        have, need = 0.0, 0
        for w in reversed(words):
            if have >= goal:
                break
            have += v[w] ** 2
            need += 1
        out.append(({w: v[w] ** 2 for w in sorted(words)}, need, goal))
    return out


def gate(templates: list[tuple[dict[str, float], int, float]], w: Column) -> Column:
    """Whether the words ``w`` hold enough heavy words of any template, by number and then by weight."""
    strings, numbers = (lambda x: F.array(*map(F.lit, x))), (lambda x: F.array(*[F.lit(float(y)) for y in x]))
    lists = F.array(*[F.struct(strings(words).alias("w"), numbers(words.values()).alias("y"), F.lit(need).alias("need"), F.lit(goal).alias("goal")) for words, need, goal in templates])
    heavy = strings(sorted({x for words, _, _ in templates for x in words}))
    weight = lambda held, t: F.aggregate(F.zip_with(t["w"], t["y"], lambda x, y: F.when(F.array_contains(held, x), y).otherwise(0.0)), F.lit(0.0), lambda a, y: a + y)
    enough = lambda held, t: F.when(F.size(F.array_intersect(held, t["w"])) >= t["need"], weight(held, t) >= t["goal"]).otherwise(False)
    # The variable of a lambda is worked out once; an expression would be for each template.
    return F.get(F.transform(F.array(F.array_intersect(w, heavy)), lambda held: (F.size(held) > 0) & F.exists(lists, lambda t: enough(held, t))), F.lit(0))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of given rows, as one literal that the optimizer reads once."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def matches(files: DataFrame, least: float = LEAST, templates: dict[str, str] | None = None) -> DataFrame:
    """``path``, ``license``, ``cosine`` of each file that has a license of its own: its best line, window of lines, block or whole text.

    Ties go to the license that comes first by name.
    """
    # Templates by license and number.
    if templates:
        templates = {f"{k}\t0": t for k, t in templates.items()}
    else:
        templates = {f"{k}\t{i}": t for k in TEMPLATES for i, t in enumerate([TEMPLATES[k], *TEXTS[k], *(f"spdx{x}" for x in SPDX[k])])}
    spark = files.sparkSession
    vocabulary = sorted({w for t in templates.values() for w in re.findall("[a-z0-9]+", t.lower())})
    # One row for each word of the files, and one for their number.
    held = F.concat(F.array_distinct(tokens(F.coalesce("text", F.lit("")))), F.array(F.lit("")))
    counts = store.materialize(files.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "license-words")
    df = {r["term"]: r["df"] for r in counts.filter(F.col("term").isin("", *vocabulary)).collect()}
    n = df.pop("", 0)
    idf, unit = vectors(df, n, templates)
    need = gates(unit, least)
    part = windows(files.filter(gate(need, tokens(F.col("text"))))).filter(gate(need, F.col("w")))
    # ``words`` is counted here, as beside a generator it would be counted for each row that this makes.
    part = store.materialize(part.withColumn("words", F.size(F.array_distinct("w"))), "license-parts")
    # The products with the templates need the templates' words alone, so they are exact.
    # Rows of the template "" gather a text's own length.
    entries = [{"term": w, "template": k, "y": x} for k, v in unit.items() for w, x in v.items()] + [{"term": w, "template": "", "y": 0.0} for w in idf]
    entries = _table(spark, [e | {"idf": idf[e["term"]]} for e in entries], "term:string,template:string,y:double,idf:double")
    # Broadcast: the templates' words, here and below.
    said = part.select("path", "k", "words", F.explode("w").alias("term")).join(F.broadcast(entries.select("term").distinct()), "term", "left_semi")
    said = said.groupBy("path", "k", "words", "term").agg((1 + F.log(F.count("*").cast("double"))).alias("tf"))
    x = F.col("tf") * F.col("idf")
    said = said.join(F.broadcast(entries), "term").groupBy("path", "k", "words", "template").agg(F.sum(x * F.when(F.col("template") == "", x).otherwise(F.col("y"))).alias("dot"), F.count("*").alias("held"))
    own = lambda c: F.max(F.when(F.col("template") == "", F.col(c)))
    said = said.groupBy("path", "k", "words").agg(own("dot").alias("square"), own("held").alias("held"), F.max(F.when(F.col("template") != "", F.col("dot"))).alias("most"), F.collect_list(F.when(F.col("template") != "", F.struct("template", "dot"))).alias("dots"))
    # In a text's length its other words count 1 at least; what is below the threshold even so can't reach it.  The margin is for rounding.
    said = store.materialize(said.filter(F.col("most") >= (least - 1e-6) * F.sqrt(F.col("square") + F.col("words") - F.col("held"))), "license-bounds")
    rest = part.join(small(said.select("path", "k")), ["path", "k"], "left_semi").select("path", "k", F.explode("w").alias("term"))
    rest = store.materialize(rest.filter(~F.col("term").isin(vocabulary)).groupBy("path", "k", "term").agg((1 + F.log(F.count("*").cast("double"))).alias("tf")), "license-lines")
    terms = store.materialize(rest.select("term").distinct(), "license-terms")
    weights = store.materialize(counts.join(small(terms), "term", "left_semi").select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")), "license-weights")
    weight = F.col("tf") * F.col("idf")
    more = rest.join(small(weights), "term").groupBy("path", "k").agg(F.sum(weight * weight).alias("more"))
    scored = said.join(more, ["path", "k"], "left").select("path", F.sqrt(F.col("square") + F.coalesce("more", F.lit(0.0))).alias("length"), F.explode("dots").alias("t"))
    cosine = F.round(F.col("t.dot") / F.col("length"), 6)
    best = scored.select("path", F.substring_index("t.template", "\t", 1).alias("license"), cosine.alias("cosine")).filter(F.col("cosine") >= least).groupBy("path", "license").agg(F.max("cosine").alias("cosine"))
    return best.groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b")).select("path", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def directory(path: Column) -> Column:
    """The path before the last slash; empty at the top."""
    return F.regexp_extract(path, "^(.*)/", 1)


def scan(files: DataFrame, least: float = LEAST, templates: dict[str, str] | None = None) -> DataFrame:
    """The columns of ``files`` but ``text`` (and any named like the three results), with ``license``, ``cosine`` and ``origin`` for each row.

    ``origin``: ``own``, the directory that the license comes from, or null where there is
    no license.  Null and empty texts have no license of their own.  Files of one path
    count as one; of several licence files in a directory the closest counts, ties going
    to the license that comes first by name.  Null paths have and inherit no license.
    """
    own = store.materialize(matches(files.filter("path IS NOT NULL").select("path", "text"), least, templates), "licenses")
    given = own.filter(F.col("path").rlike(LICENSE_FILE)).groupBy(directory(F.col("path")).alias("up")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("g"))
    given = given.select("up", F.col("g.license").alias("l"), (-F.col("g.c")).alias("c"))
    given = store.materialize(given, "license-directories")
    # Each directory once; its ancestors are its leading parts, itself included, and the top.
    dirs = files.filter("path IS NOT NULL").select(directory(F.col("path")).alias("dir")).distinct()
    split = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(split)))).alias("depth"))
    ups = ups.select("dir", "depth", F.array_join(F.slice(split, 1, F.col("depth")), "/").alias("up"))
    near = ups.join(small(given), "up").groupBy("dir").agg(F.max(F.struct("depth", "l", "c", "up")).alias("g")).select("dir", "g.l", "g.c", "g.up")
    near = store.materialize(near, "license-inheritance")
    rest = [c for c in files.columns if c not in ("text", "license", "cosine", "origin")]
    p, d, m, u = (unused(files.columns, x) for x in ("own_path", "directory", "own_match", "inherited"))
    mine = own.select(F.col("path").alias(p), F.struct("license", "cosine").alias(m))
    ups = near.select(F.col("dir").alias(f"{u}_dir"), F.struct("l", "c", "up").alias(u))
    out = files.select(*rest, directory(F.col("path")).alias(d)).join(mine, F.col("path") == F.col(p), "left").join(small(ups), F.col(d) == F.col(f"{u}_dir"), "left")
    return out.select(*rest, F.coalesce(f"{m}.license", f"{u}.l").alias("license"), F.coalesce(f"{m}.cosine", f"{u}.c").alias("cosine"), F.when(F.col(m).isNotNull(), "own").otherwise(F.col(f"{u}.up")).alias("origin"))
