"""Licence scans: TF-IDF cosine of every line (and of licence files as a whole) to templates, then inheritance by directory.

Rarity is counted over all documents, for every word.  A line can reach the threshold only if it holds one of the words left
of a template when its most frequent ones are put aside as long as their squared weights sum to less than the threshold
squared: a prefix of rare words.  Lines without such a word are dropped before anything is gathered; the rest are scored
exactly.  Of a licence file, every two lines in a row (titles are often broken) and the whole text are scored as well.  A file
keeps the licence found in it; others take that of the licence file in the nearest directory above, found once per directory
by joins over the directories' ancestors.

Results in special cases
------------------------
* null or empty text: no licence of its own; null path: a file without directory, which inherits nothing;
* ties between templates: the smaller name; between licence files of a directory: the higher score, then name, then path;
* repeated rows: each is scanned and returned; repeated paths are files of their own;
* very long texts: lines are rows; the template words are a constant list; empty table: empty result;
* further columns, however named, are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import bound
from . import common
from .decontaminate import words_of, words_sql

#: Names and wording of licence notices.
TEMPLATES = {
    "Apache-2.0": "licensed under the apache license version 2.0",
    "BSD-3-Clause": "redistribution and use in source and binary forms with or without modification are permitted",
    "CC-BY-4.0": "licensed under cc by 4.0 creative commons attribution",
    "CC-BY-NC-4.0": "licensed under cc by-nc 4.0",
    "GPL-3.0": "this work is licensed under the gnu general public license version 3",
    "MIT": "released under the mit license",
    "MPL-2.0": "subject to the terms of the mozilla public license v 2.0",
}
#: Standard texts and headers, and near relatives: (name, wording); a name may have several.
WARRANTY = "is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
NO_ENDORSEMENT = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
MIT_END = "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
ISC_GRANT = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
STANDARD = (
    ("MIT", MIT_GRANT),
    ("MIT", f"{MIT_GRANT} {MIT_END}"),
    ("ISC", ISC_GRANT),
    ("ISC", f"{ISC_GRANT} the software {WARRANTY}"),
    ("BSD-2-Clause", f"{BSD} {BSD_END}"),
    ("BSD-3-Clause", f"{BSD} {NO_ENDORSEMENT} {BSD_END}"),
    ("Apache-2.0", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0"),
    *((f"{kind}-{v}", wording) for kind, name, versions in (("GPL", "general public license", ("2.0", "3.0")), ("LGPL", "lesser general public license", ("2.1", "3.0")), ("AGPL", "affero general public license", ("3.0",))) for v in versions for wording in (GNU.format(name, v.removesuffix(".0")), f"gnu {name} version {v.removesuffix('.0')}")),
    ("Apache-2.0", "apache license version 2.0 january 2004"),
    ("MPL-2.0", "mozilla public license version 2.0"),
    ("GPL-2.0", "gnu general public license version 2 june 1991"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007"),
    ("LGPL-2.1", "gnu lesser general public license version 2.1 february 1999"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007"),
    ("AGPL-3.0", "gnu affero general public license version 3 19 november 2007"),
    *((f"CC-{k.upper()}-4.0", f"cc {k} 4.0") for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")),
)
THRESHOLD = 0.6
LICENCE_FILE = r"(?i)^(licen[cs]e|copying)(\.\w+)?$"


def wordings() -> list[tuple[str, str]]:
    """Name and wording of all templates; each name also as a source file's identifier line."""
    named = [*TEMPLATES.items(), *STANDARD]
    return [*named, *((name, f"spdx license identifier {name.lower()}") for name in sorted({n for n, _ in named}))]


def template_words() -> list[tuple[int, str, int]]:
    """Place in `wordings`, word, times."""
    out = []
    for k, (_, text) in enumerate(wordings()):
        words = re.findall(r"[a-z0-9]+", text)
        out += [(k, w, words.count(w)) for w in sorted(set(words))]
    return out


def weight(n: Column, docs: int) -> Column:
    return F.log((F.lit(docs) + 1.0) / (n + 1.0)) + 1.0


def word_counts(files: DataFrame) -> DataFrame:
    """word, n: the number of files that hold it."""
    words = files.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    return common.cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def weighted_templates(files: DataFrame, seen: DataFrame, threshold: float) -> tuple[DataFrame, int, list[str]]:
    """template, wording, word, value (unit length); the number of documents; and the words one of which a line needs."""
    n_docs = files.count()
    ours = sorted({w for _, w, _ in template_words()})
    counts = {r["word"]: r["n"] for r in seen.where(F.col("word").isin(ours)).collect()}  # template words only
    rows, needed = [], set()
    from math import log, sqrt

    idf = {w: log((n_docs + 1.0) / (counts.get(w, 0) + 1.0)) + 1.0 for w in ours}
    for k, (name, _) in enumerate(wordings()):
        mine = sorted((-counts.get(w, 0), w, tf * idf[w]) for t, w, tf in template_words() if t == k)
        total, aside = sum(v * v for *_, v in mine), 0.0
        for _, w, v in mine:  # the most frequent first
            rows.append((name, k, w, v / sqrt(total)))
            aside += v * v
            if aside >= (threshold - 1e-9) ** 2 * total:
                needed.add(w)
    return files.sparkSession.createDataFrame(rows, "template string, wording int, word string, value double"), n_docs, sorted(needed)


def own_licences(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, __row, template, score: the best of each file that reaches the threshold."""
    seen = word_counts(files)
    vectors, n_docs, needed = weighted_templates(files, seen, threshold)
    ours = sorted({w for _, w, _ in template_words()})
    name = F.element_at(F.split("path", "/"), -1)
    # a row per line; of a licence file also its pairs of lines, and the whole
    parts = F.split("text", "\n")
    whole = F.coalesce(name.rlike(LICENCE_FILE), F.lit(False)) & (F.size(parts) > 1)
    pairs = bound(parts, lambda p: F.transform(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(p, i + 1))))
    lines = files.where("text IS NOT NULL").select("doc_id", "path", "__row", F.posexplode(F.when(whole, F.concat(parts, pairs, F.array("text"))).otherwise(parts)).alias("at", "line"))
    tokens = lines.select("doc_id", "path", "__row", "at", words_of(F.col("line")).alias("w")).where(F.arrays_overlap("w", F.array(*map(F.lit, needed))))
    each = tokens.select("doc_id", "path", "__row", "at", F.explode("w").alias("word")).groupBy("doc_id", "path", "__row", "at", "word").agg(F.count(F.lit(1)).alias("tf"))
    # both sides come through exchanges, so words of very many lines can be split
    key = ["doc_id", "path", "__row", "at"]
    sized = each.join(seen, "word").withColumn("size", F.col("tf") * weight(F.col("n"), n_docs))
    held = F.collect_list(F.when(F.col("word").isin(ours), F.struct("word", "size"))).alias("held")
    norms = sized.groupBy(*key).agg(F.sqrt(F.sum(F.col("size") * F.col("size"))).alias("norm"), held)
    dots = norms.select(*key, "norm", F.explode("held").alias("h")).join(F.broadcast(vectors), F.col("h.word") == F.col("word"))
    score = dots.groupBy(*key, "template", "wording").agg((F.sum(F.col("h.size") * F.col("value")) / F.first("norm")).alias("score"))
    good = score.withColumn("score", F.round("score", 9)).where(F.col("score") >= threshold)
    return good.groupBy("doc_id", "path", "__row").agg(F.min(F.struct((-F.col("score")).alias("s"), "template")).alias("b")).select("doc_id", "path", "__row", F.col("b.template").alias("template"), (-F.col("b.s")).alias("score"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per file (doc_id, path, text): doc_id, path, own_licence, own_score, licence, from_dir (null for its own)."""
    files = files.select("doc_id", "path", "text", F.xxhash64("doc_id", "path", "text").alias("__row"))
    own = common.cut(own_licences(files, threshold))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", ""))
    base = common.cut(files.select("doc_id", "path", "__row", folder.alias("dir")))
    # what licence files say of their directories
    said = own.where(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)).select(folder.alias("dir"), F.struct((-F.col("score")).alias("s"), "template", "path").alias("b"))
    said = said.groupBy("dir").agg(F.min("b").alias("b")).select(F.col("dir").alias("above"), F.col("b.template").alias("licence"))
    # each directory once, with all that lie above it; the longest that says something is the nearest
    dirs = base.select("dir").where("dir IS NOT NULL").distinct()
    above = bound(F.split("dir", "/"), lambda steps: F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/")))
    near = dirs.select("dir", F.explode(above).alias("above")).join(common.cut(said), "above")
    near = near.groupBy("dir").agg(F.max_by(F.struct("licence", "above"), F.char_length("above")).alias("n"))
    near = common.cut(near.select(F.col("dir").alias("__dir"), F.col("n.licence").alias("inherited"), F.col("n.above").alias("from_dir")))
    mine = common.cut(own.select(F.col("__row").alias("__its"), F.col("doc_id").alias("__doc"), F.col("path").alias("__at"), "template", "score").distinct())
    same = (F.col("__row") == F.col("__its")) & F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("path").eqNullSafe(F.col("__at"))
    out = base.join(mine, same, "left").join(near, F.col("dir") == F.col("__dir"), "left")
    has = F.col("template").isNotNull()
    return out.select(
        "doc_id", "path", F.col("template").alias("own_licence"), F.col("score").alias("own_score"),
        F.coalesce("template", "inherited").alias("licence"), F.when(~has, F.col("from_dir")).alias("from_dir"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: a directory per source, thousand and hundred; the first of each is its licence file."""
    top = F.concat(F.lit("/"), F.col("source"), F.lit("/d"), F.floor(F.col("doc_id") / 1000).cast("string"))
    sub = F.concat(top, F.lit("/s"), F.floor(F.col("doc_id") / 100).cast("string"))
    path = F.when(F.col("doc_id") % 1000 == 0, F.concat(top, F.lit("/LICENSE"))).when(F.col("doc_id") % 100 == 0, F.concat(sub, F.lit("/LICENSE")))
    return docs.select("doc_id", F.coalesce(path, F.concat(sub, F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(as_files(common.table(spark, sf_dir, "documents")))
    return out.withColumn("own_score", F.round("own_score", 6))


_NAMES = [name for name, _ in wordings()]
_FILE = r"regexp_matches(path, '(?i)(^|/)(licen[cs]e|copying)(\.\w+)?$')"
OP10_SQL = rf"""
WITH files AS (
  SELECT doc_id, text, CASE WHEN doc_id % 1000 = 0 THEN top || '/LICENSE' WHEN doc_id % 100 = 0 THEN sub || '/LICENSE' ELSE sub || '/f' || doc_id || '.txt' END AS path
  FROM (SELECT *, '/' || source || '/d' || doc_id // 1000 AS top, '/' || source || '/d' || doc_id // 1000 || '/s' || doc_id // 100 AS sub FROM documents)
), df AS (SELECT word, ln((SELECT count(*) + 1.0 FROM files) / (count(*) + 1.0)) + 1 AS idf FROM (SELECT unnest(list_distinct({words_sql("text")})) AS word FROM files) GROUP BY word
), raw(k, word, tf) AS (VALUES {", ".join(f"({k}, '{w}', {n})" for k, w, n in template_words())}
), weighed AS (SELECT k, raw.word, tf * coalesce(idf, ln((SELECT count(*) + 1.0 FROM files)) + 1) AS v FROM raw LEFT JOIN df USING (word)
), templates AS (SELECT k, {_NAMES}[k + 1] AS template, word, v / sqrt(sum(v * v) OVER (PARTITION BY k)) AS v FROM weighed
), split AS (SELECT doc_id, path, text, string_split(text, chr(10)) AS l FROM files WHERE text IS NOT NULL
), parts AS (
  SELECT doc_id, path, unnest(range(len(p))) AS pos, unnest(p) AS line FROM (
    SELECT doc_id, path, CASE WHEN {_FILE} AND len(l) > 1 THEN list_concat(l, list_transform(list_zip(l[1:len(l) - 1], l[2:]), lambda x: x[1] || ' ' || x[2]), [text]) ELSE l END AS p FROM split)
), counted AS (SELECT doc_id, path, pos, word, count(*) AS tf FROM (SELECT doc_id, path, pos, unnest({words_sql("line")}) AS word FROM parts) GROUP BY ALL
), sized AS (SELECT *, tf * idf AS size, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id, path, pos)) AS norm FROM counted JOIN df USING (word)
), scores AS (SELECT doc_id, path, template, round(sum(size * v) / any_value(norm), 9) AS score FROM sized JOIN templates USING (word) GROUP BY doc_id, path, pos, k, template HAVING round(sum(size * v) / any_value(norm), 9) >= {THRESHOLD}
), own AS (SELECT doc_id, path, max(score) AS score, arg_min(template, (-score, template)) AS template FROM scores GROUP BY doc_id, path
), said AS (SELECT regexp_replace(path, '/[^/]*$', '') AS above, arg_min(template, (-score, template, path)) AS licence FROM own WHERE {_FILE} GROUP BY ALL
), dirs AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM files
), near AS (SELECT dir, arg_max(licence, length(above)) AS licence, arg_max(above, length(above)) AS above FROM dirs JOIN said ON dir = above OR starts_with(dir, above || '/') GROUP BY dir)
SELECT f.doc_id, f.path, o.template AS own_licence, round(o.score, 6) AS own_score, coalesce(o.template, n.licence) AS licence, CASE WHEN o.template IS NULL THEN n.above END AS from_dir
FROM files f LEFT JOIN own o USING (doc_id, path) LEFT JOIN near n ON n.dir = regexp_replace(f.path, '/[^/]*$', '')
"""
