"""License scans: sparse TF-IDF cosine to templates, then inheritance along directories.

A file's passages are its blocks (header comments and paragraphs, set apart by blank lines) and its lines with a licence
cue, and the whole of a licence file. A passage's terms are weighted by their frequency and the templates' inverse document
frequency (a term in no template weighs most), and its cosine to a template is a join on the term.
A file takes its best template at or above ``LEAST``; ties go to the template of more terms, then to the name that sorts first.
A file without one inherits from the licence file in the nearest ancestor directory, by a
join of its ancestors' paths with the directories that have one.

Built-in functions only. Templates are a parameter of fixed size; a term that most passages share is joined
with them, not with other passages, and a directory that holds most files is one row on the other side.

A null or empty text has no passage; rows of one path are versions of one file, of which the best passage counts,
and give one row; a null path is the root's; a directory with several licence files takes the best score, then the first name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

# The short forms, tags, titles, headers and bodies by which files name their licence.
SHORT = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This file is distributed under the MIT License. See LICENSE for details."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
)
TAGS = (
    "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense",
)
TITLES = (
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("GPL", "GNU General Public License"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission."
)
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software."
)
_MIT_END = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BODIES = (
    ("AGPL-3.0", _GNU_HEADER.format(name="Affero General Public License", version="3")),
    ("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You "
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    )),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("GPL-2.0", _GNU_HEADER.format(name="General Public License", version="2")),
    ("GPL-3.0", _GNU_HEADER.format(name="General Public License", version="3")),
    ("ISC", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    )),
    ("LGPL-2.1", _GNU_HEADER.format(name="Lesser General Public License", version="2.1")),
    ("LGPL-3.0", _GNU_HEADER.format(name="Lesser General Public License", version="3")),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_END),
    ("MPL-2.0", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    )),
    ("Unlicense", (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    )),
)
TEMPLATES = (*SHORT, *((t, f"SPDX-License-Identifier: {t}") for t in TAGS), *TITLES, *BODIES)
LEAST = 0.75
CUE = r"(?i)licen[cs]e|copyright|spdx|public domain|permission is hereby|permission to use|redistribution and use|free software"
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
BLANK = r"\n[ \t]*\n"
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def _terms(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term, tf)"""
    term = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TERM), F.lit(0)))
    return rows.select(*keys, term.alias("term")).groupBy(*keys, "term").agg(F.count("*").cast("double").alias("tf"))


def passages(files: DataFrame) -> DataFrame:
    """(path, passage) of ``files`` (path, text): blocks and lines with a cue, and whole licence files."""
    whole = files.filter(F.col("path").rlike(LICENSE_FILE) & F.col("text").rlike("[A-Za-z]")).select("path", F.col("text").alias("passage"))
    blocks = files.filter(F.col("text").rlike(CUE)).select("path", F.explode(F.split("text", BLANK)).alias("passage")).filter(F.col("passage").rlike(CUE))
    lines = blocks.filter(F.contains("passage", F.lit("\n"))).select("path", F.explode(F.split("passage", "\n")).alias("passage")).filter(F.col("passage").rlike(CUE))
    return whole.unionByName(blocks).unionByName(lines)


def matches(found: DataFrame, templates: DataFrame) -> DataFrame:
    """(path, license, score): the best template of each path, whatever its score; ``templates``: (id, license, template)."""
    terms = _terms(templates, ["id"], "template")
    total = templates.agg(F.count("*").alias("total"))
    sizes = terms.groupBy("id").agg(F.count("*").alias("terms"))
    spread = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = spread.crossJoin(total).select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    most = templates.select(F.log(1.0 + F.count("*")).alias("v")).first()["v"] + 1
    weighed = terms.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    sides = weighed.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("side"))

    # numbers of passages are fixed once written
    found = saved(found.select(F.coalesce("path", F.lit("")).alias("path"), "passage").withColumn("n", F.monotonically_increasing_id()), "passages")
    own = _terms(found, ["n"], "passage").join(idf, "term", "left")
    own = saved(own.select("n", "term", (F.col("tf") * F.coalesce("idf", F.lit(most))).alias("w")), "weights")
    lengths = own.groupBy("n").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = own.join(sides, "term").groupBy("n", "id").agg(F.sum(F.col("w") * F.col("side")).alias("dot"))
    scores = dots.join(lengths, "n").join(templates.join(sizes, "id").select("id", "license", "terms"), "id").select("n", "license", "terms", F.round(F.col("dot") / F.col("length"), 6).alias("score"))
    best = scores.groupBy("n").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("terms")).alias("t"), "license")).alias("best"))
    best = found.select("n", "path").join(best, "n").groupBy("path").agg(F.min("best").alias("best"))
    return best.select("path", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"))


def parent(path: F.Column) -> F.Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, templates: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """One row per path: path, license, score, origin (text, directory or none), directory."""
    spark = files.sparkSession
    if templates is None:
        templates = spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "id int, license string, template string")
    files = files.select(F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    own = saved(matches(passages(files), templates).filter(F.col("score") >= least), "own")
    paths = files.select("path").distinct()
    direct = paths.join(own, "path", "left")
    grants = own.filter(F.col("path").rlike(LICENSE_FILE)).select(parent(F.col("path")).alias("directory"), "license", "score")
    grants = grants.groupBy("directory").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    grants = grants.select("directory", F.col("best.license").alias("granted"), (-F.col("best.s")).alias("by"))
    names = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda n: F.struct(n.alias("depth"), F.concat_ws("/", F.slice(names, 1, n)).alias("directory")))
    asking = direct.filter("license is null").select("path", F.inline(above))
    nearest = asking.join(grants, "directory").groupBy("path").agg(F.max(F.struct("depth", "directory", "granted", "by")).alias("g"))
    out = direct.join(nearest, "path", "left")
    return out.select(
        "path",
        F.coalesce("license", "g.granted").alias("license"),
        F.coalesce("score", "g.by").alias("score"),
        F.when(F.col("license").isNotNull(), "text").when(F.col("g").isNotNull(), "directory").otherwise("none").alias("origin"),
        F.when(F.col("license").isNull(), F.col("g.directory")).alias("directory"),
    )


def document_path(doc_id: str = "doc_id", source: str = "source") -> F.Column:
    """Documents as files: source/thousands/hundreds/id, the first of each hundred being its directory's LICENSE."""
    n = F.col(doc_id)
    name = F.when(n % 100 == 0, F.concat(F.lit("LICENSE."), n)).otherwise(F.concat(n, F.lit(".txt")))
    return F.concat_ws("/", F.coalesce(F.col(source), F.lit("")), F.floor(n / 1000), F.floor(n / 100), name)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs.select(document_path().alias("path"), "text"))


_LIST = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))
OP10_SQL = f"""
WITH templates(id, license, template) AS (VALUES {_LIST}),
files AS (
  SELECT coalesce(source, '') || '/' || (doc_id // 1000) || '/' || (doc_id // 100) || '/' ||
         CASE WHEN doc_id % 100 = 0 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS path, text
  FROM documents),
blocks AS (
  SELECT path, b.k AS block, 0 AS line, b.passage AS passage FROM (
    SELECT path, unnest(list_transform(range(1, len(s) + 1), lambda i: {{'k': i, 'passage': s[i]}})) AS b
    FROM (SELECT path, regexp_split_to_array(text, '{BLANK}') AS s FROM files WHERE regexp_matches(text, '{CUE}')))
  WHERE regexp_matches(b.passage, '{CUE}')),
lines AS (
  SELECT path, block, l.line AS line, l.passage AS passage FROM (
    SELECT path, block, unnest(list_transform(range(1, len(s) + 1), lambda i: {{'line': i, 'passage': s[i]}})) AS l
    FROM (SELECT path, block, string_split(passage, chr(10)) AS s FROM blocks WHERE contains(passage, chr(10))))
  WHERE regexp_matches(l.passage, '{CUE}')),
parts AS (
  SELECT * FROM blocks UNION ALL SELECT * FROM lines UNION ALL
  SELECT path, 0, 0, text FROM files WHERE regexp_matches(path, '{LICENSE_FILE}') AND regexp_matches(text, '[A-Za-z]')),
t_terms AS (
  SELECT id, term, count(*)::DOUBLE AS tf
  FROM (SELECT id, unnest(regexp_extract_all(lower(template), '{TERM}')) AS term FROM templates) GROUP BY 1, 2),
idf AS (
  SELECT term, ln((1 + (SELECT count(*) FROM templates)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM t_terms GROUP BY 1),
weighed AS (SELECT id, term, tf * idf AS w FROM t_terms JOIN idf USING (term)),
norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY 1),
own AS (
  SELECT path, block, line, term, tf * coalesce(idf, ln(1.0 + (SELECT count(*) FROM templates)) + 1) AS w
  FROM (SELECT path, block, line, term, count(*)::DOUBLE AS tf
        FROM (SELECT path, block, line, unnest(regexp_extract_all(lower(passage), '{TERM}')) AS term FROM parts) GROUP BY 1, 2, 3, 4)
  LEFT JOIN idf USING (term)),
lengths AS (SELECT path, block, line, sqrt(sum(w * w)) AS length FROM own GROUP BY 1, 2, 3),
dots AS (
  SELECT path, block, line, id, sum(own.w * weighed.w / norm) AS dot
  FROM own JOIN weighed USING (term) JOIN norms USING (id) GROUP BY 1, 2, 3, 4),
scored AS (
  SELECT path, license, round(dot / length, 6) AS score, row_number() OVER (PARTITION BY path ORDER BY round(dot / length, 6) DESC, terms DESC, license) AS r
  FROM dots JOIN lengths USING (path, block, line) JOIN templates USING (id) JOIN (SELECT id, count(*) AS terms FROM t_terms GROUP BY 1) USING (id)),
best AS (SELECT path, license, score FROM scored WHERE r = 1 AND score >= {LEAST}),
paths AS (SELECT DISTINCT path FROM files),
grants AS (
  SELECT directory, granted, by_score FROM (
    SELECT regexp_replace(path, '/?[^/]*$', '') AS directory, license AS granted, score AS by_score,
           row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY score DESC, license) AS r
    FROM best WHERE regexp_matches(path, '{LICENSE_FILE}')) WHERE r = 1),
asking AS (
  SELECT path, d.depth, d.directory FROM (
    SELECT path, unnest(list_transform(range(0, len(s)), lambda n: {{'depth': n, 'directory': array_to_string(s[1:n], '/')}})) AS d
    FROM (SELECT path, string_split(path, '/') AS s FROM paths ANTI JOIN best USING (path)))),
nearest AS (
  SELECT path, directory, granted, by_score, row_number() OVER (PARTITION BY path ORDER BY depth DESC) AS r
  FROM asking JOIN grants USING (directory))
SELECT path, coalesce(license, granted) AS license, coalesce(score, by_score) AS score,
       CASE WHEN license IS NOT NULL THEN 'text' WHEN granted IS NOT NULL THEN 'directory' ELSE 'none' END AS origin,
       CASE WHEN license IS NULL THEN directory END AS directory
FROM paths LEFT JOIN best USING (path) LEFT JOIN (SELECT * FROM nearest WHERE r = 1) USING (path)
"""
