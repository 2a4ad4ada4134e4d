"""Operator 2: licence scan by sparse TF-IDF cosine, then inheritance along directories, in DataFrame operations only.

A file is compared with licence templates (short notices, standard headers, licence texts) as sparse TF-IDF vectors of
its blocks: every line; every sentence, over line ends too, so that a wrapped notice and one within a longer line are
found; every run of lines that are mostly template words, such as a header; and the whole text if it is mostly template
words, as a licence file is. Document frequencies are counted over the whole corpus for the templates' words; every other
word weighs as one never seen. Blocks without any of the rare words that a template cannot do without (needed) cannot reach
MIN_COSINE and are not compared. The block with the best cosine of at least MIN_COSINE names the file's licence.

All vectors of a file are computed within its row: the scan shuffles only counts of template words. A directory takes the
licence of the file in it with the highest cosine. A file without a licence of its own inherits that of its nearest
ancestor directory: distinct directories, not files, are expanded to their ancestors and joined with the licensed
directories by path; the deepest wins. So a directory that holds a third of all files is one row in that join, and files
meet only the answer for their own directory.

Edge cases: null and empty texts have no licence of their own and can inherit; a null path has no directory and inherits
nothing; equal cosines go to the first licence by name, and in a directory to the first file by path; repeated rows get
the same answer each; very long lines are whole vectors, made in time with their length (times its logarithm); extra columns are ignored; empty tables give no rows, and
without templates no file has a licence.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm.shared import let, stored, table

MIN_COSINE = 0.75
#: Notices, standard headers and licence texts by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
}
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Ends a sentence; a line end counts as a blank.
STOP = r"[.;:!?] +"


def terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and dots within a word; the licence numbers keep their dots."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)


def needed(tf: dict[str, int], idf: dict[str, float], min_cosine: float) -> list[str]:
    """The rarest words of a template of which a text must have one to reach the cosine: without them, the words that are
    left have too small a share of the template's norm, which bounds the cosine from above."""
    rarest = sorted(tf, key=lambda t: (-idf[t], t))
    missing, out, most = 0.0, [], (1 - min_cosine**2) * sum((k * idf[t]) ** 2 for t, k in tf.items())
    for t in rarest:
        missing += (tf[t] * idf[t]) ** 2
        out.append(t)
        if missing > most * (1 + 1e-9):
            break
    return out


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """files(file_id, path, text) -> file_id, path, own_licence, cosine, licence, inherited_from."""
    known = [(k, Counter(re.findall(TERM, x.lower()))) for k, notices in sorted(templates.items()) for x in notices]
    vocabulary = sorted({t for _, x in known for t in x})  # the templates' words, a fixed set
    words = F.array(*map(F.lit, vocabulary)).cast("array<string>")
    is_word = lambda x: x.isin(*vocabulary) if vocabulary else F.lit(False)  # noqa: E731  a hash lookup
    n_known = lambda t: F.size(F.filter(t, is_word))
    text = F.coalesce("text", F.lit(""))
    has = F.array_distinct(F.filter(terms(text), is_word))
    rows = stored(files.select("file_id", "path", text.alias("text"), has.alias("has")), "licence-words")
    n = rows.count()
    df = {r[0]: r[1] for r in rows.select(F.explode("has").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # at most the vocabulary
    idf = {t: 1.0 + math.log((n + 1.0) / (df.get(t, 0) + 1)) for t in vocabulary}
    unseen = 1.0 + math.log(n + 1.0)
    critical = sorted({t for _, tf in known for t in needed(tf, idf, min_cosine)})
    can_reach = lambda t: F.exists(t, lambda x: x.isin(*critical)) if critical else F.lit(False)
    sentences = F.transform(F.split(F.regexp_replace("text", "\n", " "), STOP), terms)
    nothing = F.array().cast("array<array<string>>")
    may = can_reach(F.col("has"))
    rows = rows.select("file_id", "path", F.when(may, F.transform(F.split("text", "\n"), terms)).otherwise(nothing).alias("lines"), F.when(may, sentences).otherwise(nothing).alias("sentences"))

    def counted(t: Column) -> Column:
        """Words and their numbers, from the runs of equal words of the sorted block."""
        starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i < F.size(s)) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        runs_of = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("w"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("n")))
        return let(F.sort_array(t), lambda s: let(starts(s), lambda at: runs_of(s, at)))

    # runs of two or more lines of mostly template words; lines without any words, such as blank ones, do not end a run
    mostly = lambda t: 2 * n_known(t) >= F.size(t)
    lines = F.col("lines")
    breaks = F.concat(F.array(F.lit(-1)), F.filter(F.sequence(F.lit(0), F.size(lines)), lambda i: (i == F.size(lines)) | ~mostly(F.get(lines, i))))
    between = lambda at: F.transform(F.slice(at, 2, F.size(at) - 1), lambda end, k: F.slice(lines, F.get(at, k) + 2, end - F.get(at, k) - 1))
    long_enough = lambda r: F.size(F.filter(r, lambda t: F.size(t) > 0)) >= 2
    some_run = F.size(F.filter("lines", lambda t: (F.size(t) > 0) & mostly(t))) >= 2
    runs = F.when(some_run, F.transform(F.filter(let(breaks, between), long_enough), F.flatten)).otherwise(nothing)
    whole = let(F.flatten("lines"), lambda t: F.when((F.size(t) > 0) & mostly(t), F.array(t)).otherwise(nothing))
    # distinct as strings, which are hashed; arrays would be compared with one another
    joined = F.transform(F.filter(F.concat("lines", "sentences", runs, whole), can_reach), lambda t: F.array_join(t, " "))
    blocks = F.transform(F.array_distinct(joined), lambda x: F.split(x, " "))
    vectors = F.transform(blocks, lambda t: F.struct(counted(F.filter(t, is_word)).alias("known"), F.aggregate(counted(F.filter(t, lambda x: ~is_word(x))), F.lit(0).cast("long"), lambda s, x: s + x["n"] * x["n"]).alias("unknown")))
    rows = rows.select("file_id", "path", vectors.alias("vectors"))
    pairs = lambda d: F.create_map(*[F.lit(y) for x in d.items() for y in x])

    def cosines(v: Column) -> Column:
        weigh = lambda by: F.aggregate(v["known"], F.lit(0.0), lambda s, x: s + by(x))
        square = weigh(lambda x: F.pow(x["n"] * F.element_at(pairs(idf), x["w"]), F.lit(2.0))) + v["unknown"] * F.lit(unseen * unseen)
        each = []
        for licence, tf in known:
            norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in tf.items()))
            dot = weigh(lambda x, tf=tf: x["n"] * F.coalesce(F.try_element_at(pairs({t: k * idf[t] ** 2 for t, k in tf.items()}), x["w"]), F.lit(0.0)))
            each.append(F.struct((-F.round(dot / F.sqrt(square) / norm, 6)).alias("c"), F.lit(licence).alias("licence")))
        return F.array_min(F.array(*each))

    none = F.lit(None).cast("struct<c:double,licence:string>")
    best = F.array_min(F.filter(F.transform("vectors", cosines), lambda x: x["c"] <= -min_cosine)) if known else none
    own = F.when(F.size("vectors") > 0, best)
    files_ = rows.select("file_id", "path", own.alias("b")).select("file_id", "path", F.col("b.licence").alias("own_licence"), (-F.col("b.c")).alias("cosine"))
    files_ = stored(files_.withColumn("dir", directory(F.col("path"))), "licence-own")
    by_dir = files_.where("own_licence IS NOT NULL AND dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "own_licence")).alias("b")).select("dir", F.col("b.own_licence").alias("found"))
    depth = F.size(F.split("dir", "/"))
    up = files_.select("dir").where("dir IS NOT NULL").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(F.split("dir", "/"), 1, i), "/"))).alias("above"))
    near = up.join(by_dir.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max(F.struct(F.size(F.split("above", "/")).alias("d"), "above", "found")).alias("b")).select("dir", F.col("b.above").alias("above"), F.col("b.found").alias("found"))
    out = files_.join(stored(near, "licence-near"), "dir", "left")
    inherits = F.col("own_licence").isNull()
    return out.select("file_id", "path", "own_licence", "cosine", F.coalesce("own_licence", "found").alias("licence"), F.when(inherits, F.col("above")).alias("inherited_from"))


def directory(path: Column) -> Column:
    """The path without its last part; null where there is none."""
    return F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(""))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: a source's root, then the digits of the doc_id but for the last as directories."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    digits = F.regexp_replace(ident, "(.)(?=.)", "$1/")
    return docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", F.coalesce("source", F.lit("none")), digits).alias("path"), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(as_files(table(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")


def _sql() -> str:
    quoted = lambda x: x.replace("'", "''")
    values = ", ".join(f"('{k}', {i}, '{quoted(v)}')" for i, (k, v) in enumerate((k, v) for k, x in sorted(TEMPLATES.items()) for v in x))
    return rf"""
WITH k(licence, no, notice) AS (VALUES {values}),
tt AS (SELECT licence, no, term, count(*) AS tf FROM (SELECT licence, no, unnest(regexp_extract_all(lower(notice), '{TERM}')) AS term FROM k) GROUP BY ALL),
voc AS (SELECT list(DISTINCT term) AS v FROM tt),
f AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, 'none') || '/' || regexp_replace(coalesce(doc_id::VARCHAR, 'none'), '(.)', '\1/', 'g') AS p0, coalesce(text, '') AS text FROM documents),
g AS (SELECT rid, doc_id, p0[:-2] AS path, text FROM f),
li AS (SELECT rid, i, t, len(list_filter(t, lambda x: list_contains(v, x))) AS kn FROM (SELECT rid, i, regexp_extract_all(lower(ls[i]), '{TERM}') AS t FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM g))), voc),
se AS (SELECT rid, i, regexp_extract_all(lower(ls[i]), '{TERM}') AS t FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT rid, string_split_regex(replace(text, chr(10), ' '), '{STOP}') AS ls FROM g))),
ru AS (SELECT rid, grp, flatten(list(t ORDER BY i)) AS t FROM (SELECT *, sum(CASE WHEN 2 * kn >= len(t) THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS grp FROM li)
       WHERE 2 * kn >= len(t) GROUP BY rid, grp HAVING count(*) FILTER (WHERE len(t) > 0) >= 2),
wh AS (SELECT rid, flatten(list(t ORDER BY i)) AS t FROM li GROUP BY rid HAVING 2 * sum(kn) >= sum(len(t)) AND sum(len(t)) > 0),
l AS (SELECT rid, 'l' || i AS i, t FROM li UNION ALL SELECT rid, 's' || i, t FROM se UNION ALL SELECT rid, 'r' || grp, t FROM ru UNION ALL SELECT rid, 'w', t FROM wh),
lt AS (SELECT rid, i, term, count(*) AS tf FROM (SELECT rid, i, unnest(t) AS term FROM l WHERE list_has_any(t, (SELECT v FROM voc))) GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n FROM g),
idf AS (SELECT v.term, 1 + ln((n + 1) / (coalesce(df, 0) + 1)) AS idf FROM (SELECT DISTINCT term FROM tt) v CROSS JOIN n
        LEFT JOIN (SELECT term, count(DISTINCT rid) AS df FROM lt GROUP BY term) d ON v.term = d.term),
lv AS (SELECT rid, i, lt.term, tf * coalesce(idf, 1 + ln(n + 1)) AS w FROM lt CROSS JOIN n LEFT JOIN idf ON lt.term = idf.term),
tv AS (SELECT licence, no, term, tf * idf AS w FROM tt JOIN idf USING (term)),
ln_ AS (SELECT rid, i, sqrt(sum(w * w)) AS norm FROM lv GROUP BY ALL), tn AS (SELECT no, sqrt(sum(w * w)) AS norm FROM tv GROUP BY ALL),
c AS (SELECT rid, licence, round(dot / (ln_.norm * tn.norm), 6) AS cosine FROM (SELECT rid, i, licence, no, sum(lv.w * tv.w) AS dot FROM lv JOIN tv ON lv.term = tv.term GROUP BY ALL) JOIN ln_ USING (rid, i) JOIN tn USING (no)),
own AS (SELECT rid, licence AS own_licence, cosine FROM c WHERE cosine >= {MIN_COSINE} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY cosine DESC, licence) = 1),
o AS (SELECT g.rid, doc_id, path, own_licence, cosine, nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), '') AS dir FROM g LEFT JOIN own ON g.rid = own.rid),
d AS (SELECT dir, own_licence AS found FROM o WHERE own_licence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path) = 1),
near AS (SELECT o.dir, d.dir AS above, found FROM (SELECT DISTINCT dir FROM o) o JOIN d ON o.dir = d.dir OR starts_with(o.dir, d.dir || '/')
         QUALIFY row_number() OVER (PARTITION BY o.dir ORDER BY len(d.dir) DESC) = 1)
SELECT doc_id, path, own_licence, cosine, coalesce(own_licence, found) AS licence, CASE WHEN own_licence IS NULL THEN above END AS inherited_from
FROM o LEFT JOIN near ON o.dir = near.dir
"""


SQL = _sql()
