"""License scans (operator 9): sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Every whole text is cut at line ends and sentence ends; a segment is a header of the template to which its cosine is greatest, if it reaches
``threshold``. The space is the templates' vocabulary, weighed by (1 + ln tf) * idf with document counts over the whole corpus, and each other word with the mean idf.
A segment that shares only a template's lightest terms, whose norm together is below the threshold, cannot reach it, so only segments with one of the
others are compared, which is exact.

A file whose name says licence gives its directory the licence it states. A file without a licence of its own takes that of its nearest ancestor
directory that has one, by joins on paths: directories are resolved once each, and files join their own directory.

A file whose name says licence is first compared as a whole to the full texts in ``licence_texts``, by TF-IDF cosine with counts over those texts; only files
that have enough of a text's heavier words to reach the threshold are, which is exact. A text without such a match or header has the licence of its SPDX line, or of the first title or
notice it contains word for word, whatever stands around it and wherever lines or comment marks break it; its cosine is then 1.

Everything is DataFrame expressions; only the words of distinct whole licence files are shuffled. The vocabulary is of the templates' size, so its weights are literals.

Defined results: null and empty texts have no licence of their own; null paths inherit nothing; ties go to the template listed first; two licence files in a directory
give it the better match, then the one listed first; repeated rows get equal results; an empty table gives an empty table. Extra columns stay out of the way.
"""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.llm.common import materialize, table

# Fixed values: what licence headers say, by SPDX name.
TEMPLATES = {
    "MIT": "Released under the MIT License",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This source code is subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license, BSD 3-Clause",
    "CC-BY-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0, Creative Commons ShareAlike",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1",
    "BSD-2-Clause": "Use of this source code is governed by a BSD-style license, BSD 2-Clause",
    "ISC": "Licensed under the ISC License",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
# Titles and notices, found word for word in this order; the texts of TEMPLATES come after them.
NOTICES = {
    "AGPL-3.0": ["GNU Affero General Public License version 3", "GNU Affero General Public License as published by the Free Software Foundation either version 3"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3", "GNU Lesser General Public License as published by the Free Software Foundation either version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License version 2.1", "GNU Lesser General Public License as published by the Free Software Foundation either version 2.1"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU General Public License as published by the Free Software Foundation either version 2"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU General Public License as published by the Free Software Foundation either version 3"],
    "Apache-2.0": ["Apache License Version 2.0", "Apache License 2.0"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "Mozilla Public License v. 2.0", "Mozilla Public License 2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"],
    "ISC": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "MIT": ["MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"],
    "CC-BY-SA-4.0": ["Attribution-ShareAlike 4.0 International", "CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["Attribution-NonCommercial 4.0 International", "CC BY-NC 4.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International", "CC BY 4.0"],
    "CC0-1.0": ["CC0 1.0 Universal"],
}
SPDX = r"(?i)SPDX-License-Identifier:[\s(]*([a-z0-9.\-]*[a-z0-9])"
WORD = r"[a-z0-9]+(?:[.\-]+[a-z0-9]+)*"
CUTS = r"\n+|(?<=[.!?])\s+"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
THRESHOLD = 0.7


def words_of(text: str) -> list[str]:
    import re

    return re.findall(WORD, text.lower())


def weights(counts: dict[str, int], n_docs: int) -> dict[str, float]:
    return {t: math.log((1 + n_docs) / (1 + counts.get(t, 0))) + 1 for t in sorted({w for s in TEMPLATES.values() for w in words_of(s)})}


def vectors(idf: dict[str, float]) -> dict[str, dict[str, float]]:
    out = {}
    for name, text in TEMPLATES.items():
        words = words_of(text)
        raw = {w: (1 + math.log(words.count(w))) * idf[w] for w in words}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out[name] = {w: x / norm for w, x in sorted(raw.items())}
    return out


def needed(vecs: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Terms of which a segment must have one to reach the threshold with any template."""
    out = set()
    for v in vecs.values():
        light = 0.0
        for w, x in sorted(v.items(), key=lambda a: (a[1], a[0])):
            light += x * x
            if light >= threshold * threshold:
                out.add(w)
    return sorted(out)


def _either(terms: list[str]) -> str:
    return rf"(?<![a-z0-9])(?:{'|'.join(t.replace('.', r'\.').replace('-', r'\-') for t in sorted(terms, key=lambda t: (-len(t), t)))})(?![a-z0-9])"


def _count_of(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def best_template(segment: Column, idf: dict[str, float], vecs: dict[str, dict[str, float]]) -> Column:
    """struct<cosine, order, name> of the nearest template."""
    words = F.regexp_extract_all(F.lower(segment), F.lit(WORD), F.lit(0))
    mean = sum(idf.values()) / len(idf)
    names = F.array(*[F.lit(t) for t in idf])
    scales = F.array(*[F.lit(float(x)) for x in idf.values()])
    own = F.transform(names, lambda t, i: F.when(F.array_contains(words, t), (1 + F.ln(F.size(F.filter(words, lambda w: w == t)).cast("double"))) * F.get(scales, i)).otherwise(F.lit(0.0)))
    others = F.size(F.filter(words, lambda w: ~F.array_contains(names, w)))

    def cosines(x: Column) -> Column:
        v, n = x["v"], x["others"]
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y) + n * F.lit(mean * mean))
        each = []
        for i, (name, vec) in enumerate(vecs.items()):
            dot = F.aggregate(F.zip_with(v, F.array(*[F.lit(float(vec.get(t, 0.0))) for t in idf]), lambda p, q: p * q), F.lit(0.0), lambda a, y: a + y)
            each.append(F.struct(F.round(F.when(norm > 0, dot / norm).otherwise(0.0), 6).alias("cosine"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
        return F.array_max(F.array(*each))

    return F.get(F.transform(F.array(F.struct(own.alias("v"), others.alias("others"))), cosines), F.lit(0))


def stated_word_for_word(text: Column) -> Column:
    """struct<cosine, order, name> by the SPDX line, a title or a notice; null without one."""
    order = {name: -i for i, name in enumerate(TEMPLATES)}
    spdx = F.regexp_replace(F.lower(F.regexp_extract(text, SPDX, 1)), "-(only|or-later)$", "")
    tests = [(name, spdx == name.lower()) for name in TEMPLATES]
    patterns = {name: "|".join("[^a-z0-9]+".join(w.replace(".", r"\.") for w in words_of(p.replace("-", " "))) for p in [*NOTICES[name], TEMPLATES[name]]) for name in NOTICES}
    patterns["BSD-3-Clause"] += r"|redistribution[^a-z0-9]+and[^a-z0-9]+use[^a-z0-9]+in[^a-z0-9]+source[^a-z0-9]+and[^a-z0-9]+binary[^a-z0-9]+forms[\s\S]*neither[^a-z0-9]+the[^a-z0-9]+names?"
    tests += [(name, F.lower(text).rlike(rf"(?<![a-z0-9])(?:{p})(?![a-z0-9])")) for name, p in patterns.items()]
    out = F.coalesce(*[F.when(test, F.struct(F.lit(1.0).alias("cosine"), F.lit(order[name]).alias("order"), F.lit(name).alias("name"))) for name, test in tests])
    return F.when(text.rlike("(?i)licen[cs]e|permission|redistribution|attribution|cc0|cc[^a-z0-9]+by|unencumbered"), out)


def full_texts() -> dict[str, dict[str, float]]:
    """Unit vectors of the full texts, and under "" the idf; a word of none of them has the greatest idf."""
    counts = {p.stem: Counter(words_of(p.read_text(encoding="utf-8"))) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
    df = Counter(w for c in counts.values() for w in c)
    out = {"": {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in df.items()}}
    for name, c in counts.items():
        raw = {w: (1 + math.log(n)) * out[""][w] for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out[name] = {w: x / norm for w, x in raw.items()}
    return out


def heavy_words(vec: dict[str, float], threshold: float, light: float = 0.2) -> tuple[list[str], int]:
    """(words, n): a text that reaches the threshold has n of the words, as its cosine is at most the norm of the words it shares."""
    left, heavy = light, []
    for w, x in sorted(vec.items(), key=lambda a: (a[1], a[0])):
        left -= x * x
        if left < 0:
            heavy.append((x * x, w))
    have, n = 1 - sum(x for x, _ in heavy), 0
    for x, _ in sorted(heavy, reverse=True):
        if have >= threshold * threshold - 1e-9:
            break
        have, n = have + x, n + 1
    return sorted(w for _, w in heavy), n


def best_full_text(files: DataFrame, vecs: dict[str, dict[str, float]], threshold: float) -> DataFrame:
    """files: (whole, words). (whole, full: struct<cosine, order, name>) of the nearest full text that reaches the threshold."""
    idf, order = vecs[""], {name: -i for i, name in enumerate(TEMPLATES)}
    spark = files.sparkSession
    scales = spark.createDataFrame(sorted(idf.items()), "word string, idf double")
    weights_of = spark.createDataFrame([(w, n, order[n], x) for n, v in vecs.items() if n for w, x in sorted(v.items())], "word string, name string, `order` int, x double")
    tf = files.dropDuplicates(["whole"]).select("whole", F.explode("words").alias("word")).groupBy("whole", "word").count()
    own = tf.join(F.broadcast(scales), "word", "left").withColumn("v", (1 + F.ln(F.col("count").cast("double"))) * F.coalesce("idf", F.lit(max(idf.values()))))  # a row a word of the full texts
    norms = own.groupBy("whole").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = own.join(F.broadcast(weights_of), "word").groupBy("whole", "name", "order").agg(F.sum(F.col("v") * F.col("x")).alias("dot"))
    near = dots.join(norms, "whole").select("whole", F.struct(F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"), "order", "name").alias("full"))
    return near.where(F.col("full.cosine") >= threshold).groupBy("whole").agg(F.max("full").alias("full"))


def scan(files: DataFrame, key: str, path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, path, own, cosine, license, inherited_from): own is the file's stated licence, license that or the inherited one."""
    rows = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    vocabulary = sorted(weights({}, 0))
    known = F.array(*[F.lit(t) for t in vocabulary])
    seen = rows.select(F.explode(F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), known)).alias("term"))
    counts = {r["term"]: r["count"] for r in seen.groupBy("term").count().collect()}  # the templates' vocabulary at most
    idf = weights(counts, rows.count())
    vecs = vectors(idf)
    must = F.lit("(?i)" + _either(needed(vecs, threshold)))
    segments = F.when(F.col("text").rlike("(?i)" + _either(needed(vecs, threshold))), F.filter(F.split("text", CUTS), lambda s: F.regexp_like(s, must))).otherwise(F.array().cast("array<string>"))
    best = F.array_max(F.transform("segments", lambda s: best_template(s, idf, vecs)))
    texts = full_texts()
    words = F.when(F.col("path").rlike(LICENCE_FILE), F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))
    enough = F.lit(False)
    for heavy, n in (heavy_words(v, threshold) for name, v in texts.items() if name):
        enough = enough | (F.size(F.array_intersect("words", F.array(*[F.lit(w) for w in heavy]))) >= n)
    found = rows.select("key", "path", "text", segments.alias("segments"), words.alias("words")).select("key", "path", "text", best.alias("best"), F.when(F.col("words").isNotNull() & enough, F.col("words")).alias("words"))
    found = found.withColumn("best", F.when(F.col("best.cosine") >= threshold, F.col("best")).otherwise(stated_word_for_word(F.col("text")))).drop("text")
    found = materialize(found.withColumn("whole", F.when(F.col("words").isNotNull(), F.md5(F.array_join("words", " ")))), "compared")
    full = materialize(best_full_text(found.where("whole is not null").select("whole", "words"), texts, threshold), "full_texts")
    found = found.drop("words").join(full, "whole", "left").select("key", "path", F.coalesce("full", "best").alias("best"))
    found = found.withColumn("dir", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), "")))
    found = materialize(found, "headers")
    stated = found.where(F.col("best").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy("dir").agg(F.max("best").alias("best"))
    stated = stated.select(F.col("dir").alias("above"), F.col("best.name").alias("given"))
    dirs = found.where("dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.when(i == 0, "").otherwise(F.array_join(F.slice(steps, 1, i), "/")).alias("above")))
    chains = dirs.select("dir", F.explode(above).alias("x")).select("dir", "x.depth", "x.above").dropDuplicates(["dir", "above"])
    nearest = chains.join(stated, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    nearest = materialize(nearest.select("dir", F.col("near.above").alias("inherited_from"), F.col("near.given").alias("given")), "directories")
    joined = found.join(nearest, "dir", "left")
    own = F.col("best.name")
    return joined.select(
        "key", "path", own.alias("own"), F.col("best.cosine").alias("cosine"), F.coalesce(own, "given").alias("license"), F.when(own.isNull(), F.col("inherited_from")).alias("inherited_from")
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file source/thousand/hundred/name; the first 20 of a hundred are named as licence files, the first 20 of a thousand as those of the directory above."""
    docs = table(spark, sf_dir, "documents")
    thousand, hundred = F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string")
    whole = F.col("doc_id") % 1000 < 20
    where = F.when(whole, F.concat_ws("/", "source", thousand)).otherwise(F.concat_ws("/", "source", thousand, hundred))
    name = F.when(F.col("doc_id") % 100 < 20, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = scan(docs.select("doc_id", F.concat_ws("/", where, name).alias("path"), "text"), "doc_id")
    return found.withColumnRenamed("key", "doc_id")


def _sql() -> str:
    vocabulary = sorted(weights({}, 0))
    names = ", ".join(f"({-i}, '{n}', [{', '.join(f'{chr(39)}{w}{chr(39)}' for w in words_of(t))}])" for i, (n, t) in enumerate(TEMPLATES.items()))
    listed = "[" + ", ".join(f"'{t}'" for t in vocabulary) + "]"
    return rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, CAST(doc_id // 1000 AS VARCHAR)) || CASE WHEN doc_id % 1000 < 20 THEN '' ELSE '/' || CAST(doc_id // 100 AS VARCHAR) END AS dir,
    CASE WHEN doc_id % 100 < 20 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS file FROM documents
), vocab AS (SELECT unnest({listed}) AS w),
df AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_intersect(list_distinct(regexp_extract_all(lower(text), '{WORD}')), {listed})) AS w FROM docs) GROUP BY w),
idf AS (SELECT w, ln(CAST(1 + (SELECT count(*) FROM docs) AS DOUBLE) / (1 + coalesce(n, 0))) + 1 AS idf FROM vocab LEFT JOIN df USING (w)),
names AS (SELECT * FROM (VALUES {names}) AS x(o, name, words)),
tv AS (SELECT o, name, w, (1 + ln(CAST(count(*) AS DOUBLE))) * any_value(idf) AS x FROM (SELECT o, name, unnest(words) AS w FROM names) JOIN idf USING (w) GROUP BY o, name, w),
tn AS (SELECT o, sqrt(sum(x * x)) AS norm FROM tv GROUP BY o),
segs AS (SELECT doc_id, k, regexp_extract_all(lower(seg[k]), '{WORD}') AS words FROM (
  SELECT doc_id, seg, unnest(range(1, len(seg) + 1)) AS k FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])[ 	

]+', '' || chr(10), 'g'), '
+') AS seg FROM docs))),
st AS (SELECT doc_id, k, w, count(*) AS tf FROM (SELECT doc_id, k, unnest(words) AS w FROM segs) GROUP BY ALL),
sv AS (SELECT doc_id, k, w, tf, idf, (1 + ln(CAST(tf AS DOUBLE))) * idf AS v FROM st LEFT JOIN idf USING (w)),
sn AS (SELECT doc_id, k, sqrt(sum(coalesce(v * v, 0)) + sum(CASE WHEN idf IS NULL THEN tf ELSE 0 END) * (SELECT avg(idf) * avg(idf) FROM idf)) AS norm FROM sv GROUP BY ALL),
cs AS (SELECT doc_id, round(sum(v * x / tn.norm) / any_value(sn.norm), 6) AS c, o, name FROM sv JOIN tv USING (w) JOIN tn USING (o) JOIN sn USING (doc_id, k) GROUP BY doc_id, k, o, name),
best AS (SELECT doc_id, c AS cosine, o, name AS own FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, o DESC) AS r FROM cs) WHERE r = 1 AND c >= {THRESHOLD}),
f AS (SELECT docs.doc_id, dir, dir || '/' || file AS path, own, cosine, o FROM docs LEFT JOIN best USING (doc_id)),
stated AS (SELECT dir AS above, arg_max(own, (cosine, o)) AS given FROM f WHERE own IS NOT NULL AND path LIKE '%/LICENSE.%' GROUP BY dir),
chains AS (SELECT DISTINCT dir, i, array_to_string(string_split(dir, '/')[1 : i], '/') AS above FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS i FROM f)),
near AS (SELECT dir, arg_max(above, i) AS above, arg_max(given, i) AS given FROM chains JOIN stated USING (above) GROUP BY dir)
SELECT doc_id, path, own, cosine, coalesce(own, given) AS license, CASE WHEN own IS NULL THEN near.above END AS inherited_from FROM f LEFT JOIN near USING (dir)
"""


OP9_SQL = _sql()
