"""License scans: sparse TF-IDF cosine against templates, then inheritance from the nearest ancestor directory.

Passages: a line is a candidate if it shares at least two longer terms with the templates, wherever it stands; all terms of
all templates count, so the search needs no list of cues.  Candidate lines, runs of them, paragraphs around them and regions
of neighbouring paragraphs are the passages, so that a one-line notice in prose, a header that is wrapped over lines and a whole
licence file are each weighed in a form of their own.  Comment marks before a line are no terms.

Terms of passages and templates make sparse TF-IDF vectors; document frequencies are counted over all passages of the corpus and
the templates.  The cosine of passage and template is the sum over their shared terms (a join on the term), and a passage
takes the template with the largest cosine, if that is large enough.  Of a file's passages those that match well count first,
then the longest.

A file is a licence file if its name says so or if most of its words are in licence passages; such a file's licence holds for
its directory.  A file without a licence of its own takes that of its nearest ancestor directory that has one: the
ancestors of each distinct directory are joined by path to the directories that have a licence, the deepest match wins,
and files look up their directory.

Templates are a parameter: ``templates_from`` reads a folder of full licence texts.  The default ones are whole texts of short
licences, and of long ones the notices, titles and standard headers that name them.

Edge cases: a null text has no passages; very long texts have as many passages as candidate lines; a null path gives a file
without directory, which inherits nothing; a null id is kept; of several licences in a directory the best cosine wins, then the smaller
name; an empty table gives no rows; rows that repeat an id and a path share their result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataflow.llm.common import SPACE_CHARS, n_words_of, written

# Texts and notices of common licences, by SPDX identifier.
_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_TAIL = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
_GNU_HEAD = "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "


def _gnu(name: str, version: str, date: str) -> list[str]:
    head, tail = _GNU_HEAD.format(name, version), _GNU_TAIL.format(name)
    return [head, head + tail, f"{name} Version {version}, {date}", f"This work is licensed under the {name}, version {version}.", f"Licensed under the {name} version {version} or later."]


TEMPLATES: dict[str, list[str]] = {
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER '
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3", "19 November 2007"),
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "BSD-2-Clause": [_CONDITIONS + _DISCLAIMER, "Released under the BSD 2-Clause License.", "This software is licensed under the simplified BSD License."],
    "BSD-3-Clause": [_CONDITIONS + _ENDORSE + _DISCLAIMER, "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Creative Commons Legal Code CC0 1.0 Universal", "Released under CC0 1.0 Universal public domain dedication."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Eclipse Public License - v 2.0"],
    "GPL-2.0": _gnu("GNU General Public License", "2", "June 1991"),
    "GPL-3.0": _gnu("GNU General Public License", "3", "29 June 2007"),
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER '
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Released under the ISC License.",
    ],
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "2.1", "February 1999"),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "3", "29 June 2007"),
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, '
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, '
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
}
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"
#: Least cosine of a passage and a template, and the one from which a match is a good one.
MIN_COSINE = 0.6
GOOD_COSINE = 0.8
#: Per cent of a file's words in licence passages that make it a licence file.
FILE_PERCENT = 50
#: Length of a term that makes a line a candidate, and how many of them it needs.
LONG_TERM = 5
LONG_TERMS = 2
_TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_TAG = "spdx-license-identifier"
#: What may stand before a comment's text.
_MARKS = r"^[ \t]*(?:[#*;%/-]+|//+|<!--|--|rem )?[ \t]*"


def templates_from(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """Full licence texts of a folder, by file name without its ending."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.txt|\.md)?$", 1).alias("name"), "value")
    return {r["name"]: [r["value"]] for r in files.collect()}  # as many as there are licences, whatever the corpus


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def passages(files: DataFrame, templates: dict[str, list[str]]) -> DataFrame:
    """(file, passage, text, words) from rows (file, text): candidate lines, their runs, paragraphs and regions."""
    terms = {t for notices in templates.values() for n in notices for t in re.findall(_TERM, n.lower())}
    anchors = sorted(t for t in terms if len(t) >= LONG_TERM and t[0].isalpha())
    shared = lambda x: F.size(F.array_distinct(F.filter(_terms(x), lambda t: t.isin(anchors)))) >= LONG_TERMS
    rows = files.where(F.col("text").isNotNull()).withColumn("lines", F.split("text", "\n")).drop("text")
    rows = rows.withColumn("hit", F.transform("lines", lambda x: shared(x) | F.lower(x).contains(_TAG))).where(F.exists("hit", lambda x: x))
    # The lines beside a candidate go with it.
    n = F.size("hit")
    near = F.transform("hit", lambda x, i: x | F.coalesce(F.get("hit", i - 1), F.lit(False)) | F.coalesce(F.get("hit", i + 1), F.lit(False)))
    zipped = F.arrays_zip(F.col("lines").alias("line"), F.col("hit").alias("hit"), near.alias("near"))
    lines = rows.where(n > 0).select("file", F.posexplode(zipped).alias("pos", "x")).where("x.near")
    lines = lines.select("file", "pos", F.regexp_replace("x.line", _MARKS, "").alias("text"), "x.hit")
    lines = lines.withColumn("blank", F.btrim("text", F.lit(SPACE_CHARS)) == "")
    lines = written(lines, "lines")

    def islands(part: DataFrame, kind: str) -> DataFrame:
        """Lines that follow one another, joined to one passage; those of one line are there already."""
        place = F.col("pos") - F.row_number().over(W.partitionBy("file").orderBy("pos"))
        runs = part.withColumn("run", place).groupBy("file", "run").agg(F.count("*").alias("n"), F.min("pos").alias("at"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("a")).where("n > 1")
        return runs.select("file", F.concat(F.lit(kind), F.col("at")).alias("passage"), F.array_join(F.col("a.text"), " ").alias("text"))

    single = lines.where("hit").select("file", F.concat(F.lit("l"), F.col("pos")).alias("passage"), "text")
    found = single.unionByName(islands(lines.where("hit"), "h")).unionByName(islands(lines.where("not blank"), "p")).unionByName(islands(lines, "r"))
    # Equal runs, paragraphs and regions are one passage.
    found = found.groupBy("file", "text").agg(F.min("passage").alias("passage"))
    return found.select("file", "passage", "text", n_words_of(F.col("text")).alias("words"))


def template_cosines(found: DataFrame, templates: dict[str, list[str]], min_cosine: float) -> DataFrame:
    """Adds (license, cosine) to passages that are near enough to a template.

    The templates' vectors are a table of a few thousand rows, whatever the corpus; they alone are broadcast.
    """
    spark = found.sparkSession
    notices = [(name, i, text) for name, whole in templates.items() for i, text in enumerate(whole)]
    fixed = spark.createDataFrame(notices, "license string, notice int, text string").coalesce(1)
    tf = fixed.select("license", "notice", F.explode(_terms(F.col("text"))).alias("term")).groupBy("license", "notice", "term").agg(F.count("*").alias("tf"))
    terms = written(found.select("file", "passage", F.explode(_terms(F.col("text"))).alias("term")).groupBy("file", "passage", "term").agg(F.count("*").alias("n")), "terms")
    n_docs = found.count() + len(notices)
    df = terms.select("term").unionByName(tf.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = written(df.select("term", (F.log(F.lit(float(n_docs + 1)) / (F.col("df") + 1)) + 1).alias("idf")), "idf")
    vectors = tf.join(idf, "term").select("license", "notice", "term", "idf", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("license", "notice")))
    vectors = written(vectors.select("license", "notice", F.col("term").alias("t"), "idf", (F.col("w") / norm).alias("w")), "templates")
    # Weights of the templates' terms, of which some are in every passage, are looked up in the broadcast; those of all other
    # terms by a join.
    fixed_idf = vectors.select(F.col("t").alias("term"), F.col("idf").alias("own")).distinct()
    known = terms.join(F.broadcast(fixed_idf), "term", "left")
    weigh = lambda rows: rows.withColumn("u", (1 + F.log("n")) * F.col("idf"))
    mine = weigh(known.where("own is not null").withColumn("idf", F.col("own")))
    rest = weigh(known.where("own is null").join(idf, "term"))
    length = mine.select("file", "passage", "u").unionByName(rest.select("file", "passage", "u")).groupBy("file", "passage").agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("length"))
    dots = mine.select("file", "passage", "term", "u").join(F.broadcast(vectors.select("license", "notice", "t", "w")), F.col("term") == F.col("t")).groupBy("file", "passage", "license", "notice").agg(F.sum(F.col("u") * F.col("w")).alias("dot"))
    scored = dots.join(length, ["file", "passage"]).withColumn("cosine", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("cosine") >= min_cosine)
    best = scored.groupBy("file", "passage").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    return found.join(best, ["file", "passage"]).select("file", "passage", "words", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def tagged(found: DataFrame, templates: dict[str, list[str]]) -> DataFrame:
    """(file, passage, words, license, cosine) of lines with an SPDX tag that names a template, alone or with its versions."""
    names = [((name + end).lower(), name) for name in templates for end in ("", "-only", "-or-later", "+")]
    known = found.sparkSession.createDataFrame(names, "tag string, license string")
    tag = F.regexp_extract(F.lower("text"), _TAG + r"[: \t(]+([a-z0-9.+-]*[a-z0-9+])", 1)
    lines = found.where(F.col("passage").startswith("l") & F.lower("text").contains(_TAG)).withColumn("tag", tag)
    return lines.join(F.broadcast(known), "tag").select("file", "passage", "words", "license", F.lit(1.0).alias("cosine"))


def _ancestors(directory: Column) -> Column:
    """A directory and all above it, as paths; the top is the empty path."""
    parts = F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def scan_licenses(files: DataFrame, id_col: str, path_col: str, text_col: str, templates: dict[str, list[str]] = TEMPLATES, min_cosine: float = MIN_COSINE, file_percent: int = FILE_PERCENT) -> DataFrame:
    """id, path, own_license, own_cosine, is_license_file, license, inherited_from and basis of every file."""
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("file", F.struct("id", "path"))
    found = written(passages(rows.select("file", "text"), templates), "passages")
    plain = found.where(~F.lower("text").contains(_TAG))
    matched = written(template_cosines(plain, templates, min_cosine).unionByName(tagged(found, templates)), "licences")
    # A good match before others, then the longer passage, then the better match.
    order = F.struct((F.col("cosine") < GOOD_COSINE).alias("weak"), (-F.col("words") * F.col("cosine")).alias("size"), "license", (-F.col("cosine")).alias("c"))
    own = matched.groupBy("file").agg(F.min(order).alias("b"), F.max("words").alias("licence_words"))
    own = own.select(F.col("file").alias("f"), F.col("b.license").alias("own_license"), (-F.col("b.c")).alias("own_cosine"), "licence_words")
    names = rows.select("file", "id", "path", n_words_of(F.col("text")).alias("n_words"))
    base = names.join(own, F.col("file") == F.col("f"), "left").drop("f")
    name = F.element_at(F.split("path", "/"), -1)
    says = F.coalesce(name.rlike(LICENSE_FILE), F.lit(False)) | F.coalesce(100 * F.col("licence_words") >= file_percent * F.col("n_words"), F.lit(False))
    base = base.withColumn("is_license_file", F.col("own_license").isNotNull() & says)
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    base = written(base.withColumn("dir", directory), "files")
    holders = base.where("is_license_file and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("own_cosine")).alias("c"), F.col("own_license").alias("l"))).alias("b"))
    holders = holders.select(F.col("dir").alias("holder"), F.col("b.l").alias("dir_license"))
    # Ancestors are made once for each distinct directory, not for each file.
    dirs = base.where("dir is not null and own_license is null").select("dir").distinct()
    up = dirs.select("dir", F.posexplode(_ancestors(F.col("dir"))).alias("depth", "ancestor"))
    nearest = up.join(holders, F.col("ancestor") == F.col("holder")).groupBy("dir").agg(F.max(F.struct("depth", "holder", "dir_license")).alias("n"))
    nearest = nearest.select(F.col("dir").alias("d"), F.col("n.holder").alias("inherited_from"), F.col("n.dir_license").alias("dir_license"))
    out = base.join(nearest, (F.col("dir") == F.col("d")) & F.col("own_license").isNull(), "left")
    basis = F.when(F.col("own_license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return out.select("id", "path", "own_license", "own_cosine", "is_license_file", F.coalesce("own_license", "dir_license").alias("license"), "inherited_from", basis.alias("basis"))


def document_path(id_col: str = "doc_id", source_col: str = "source") -> Column:
    """A path for rows that have none: source, then two levels of directories by id.

    The directories are made up, so what a document inherits in the query shows the join and says nothing of its licence.
    """
    n = F.col(id_col).cast("long")
    return F.concat_ws("/", F.coalesce(F.col(source_col), F.lit("unknown")), F.concat(F.lit("b"), F.floor(n / 5000)), F.concat(F.lit("d"), F.floor(n / 250)), F.concat(n, F.lit(".txt")))
