"""Operator 7, licence scans. DataFrame operations only.

Every document is read in units: its lines, windows of ``WINDOW`` words each ``HOP`` words (headers and other notices that
are wrapped, or stand inside a longer line), and the whole text (a licence file is one). A unit's sparse TF-IDF vector is compared with the templates by cosine. Document frequencies of the
templates' words are counted over all documents; they are some hundred numbers, so vectors of templates become literals
and a unit is scored inside one projection, without a shuffle of texts. A word that occurs n times has the weight
(1 + ln n) * idf; words that no template has are a dimension each, with the weight of a word that no document has.

Units that cannot reach ``min_score`` are passed over, exactly. By Cauchy and Schwarz the cosine with a template is at
most the norm of the template's part that the unit has: a template's words of least weight whose part stays under
``min_score`` cannot reach it alone, all its others are *telling*, and a unit without one goes. The cosine is also at most
the share of the unit's own norm that lies in template words: r of them weigh 4/e * r * rare**2 at most (since
(1 + ln n)**2 <= 4/e * n), the others rare**2 each.

A document's own licence is that of its best unit, if it reaches ``min_score``; "all rights reserved" is said by open
licences too, so ``LAST`` counts only where no other reaches it. A document is a licence file of its directory if its
path's last part is named like one, or if its whole text reaches ``file_score``. A document without its own licence
inherits that of the nearest directory above it that has a licence file with one: distinct directories are joined with
their ancestors by path, then documents with their directory.

Ties go to the template that is first by name, among licence files to the higher score, then the smaller licence name.

Defined results: null and empty texts have no licence of their own; a null path has no directory and inherits nothing;
repeated rows are kept, each with the same result; lines and texts of any length take time in proportion.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpointed

# Notices by which the licences ask to be named, and their identifiers.
TEMPLATES = {
    "AGPL-3.0": [
        "this program is licensed under the gnu affero general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "Apache-2.0": [
        "licensed under the apache license version 2.0 you may not use this file except in compliance with the license",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "BSD-3-Clause": [
        "redistribution and use in source and binary forms are permitted under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
    ],
    "CC-BY-4.0": ["this work is licensed under a creative commons attribution license cc by 4.0"],
    "CC-BY-NC-4.0": ["licensed under cc by nc 4.0 creative commons attribution noncommercial"],
    "CC0-1.0": ["released into the public domain under cc0 no rights reserved"],
    "GPL-3.0": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "LGPL-3.0": [
        "licensed under the gnu lesser general public license version 3",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "MIT": [
        "released under the mit license permission is hereby granted free of charge",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "MPL-2.0": [
        "this source code form is subject to the terms of the mozilla public license version 2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2.0",
    ],
    "Proprietary": ["copyright all rights reserved"],
}
LAST = "Proprietary"
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"
WINDOW, HOP = 40, 20
MAX_TERMS = 1000


def template_words() -> list[tuple[str, list[str]]]:
    """(licence, words) of each template, by name."""
    return [(name, re.findall("[a-z0-9]+", text)) for name, texts in sorted(TEMPLATES.items()) for text in texts]


def weights(df: dict[str, int], n: int) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """Inverse document frequency of each template word and of a word that no document has; unit vectors of templates."""
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for _, words in template_words() for w in words}
    vectors = []
    for name, words in template_words():
        vector = {w: (1 + math.log(words.count(w))) * idf[w] for w in set(words)}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        vectors.append((name, {w: v / norm for w, v in sorted(vector.items())}))
    return idf, math.log(1 + n) + 1, vectors


def telling_words(vectors: list[tuple[str, dict[str, float]]], min_score: float) -> list[str]:
    """Words without which no unit reaches ``min_score`` with any template."""
    out = set()
    for _, vector in vectors:
        part = 0.0
        for w, v in sorted(vector.items(), key=lambda x: (x[1], x[0])):
            part += v * v
            if part >= min_score * min_score * (1 - 1e-9):
                out.add(w)
    return sorted(out)


def _words(text: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def _frequencies(texts: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    known = texts.select(F.explode(F.array_distinct(F.filter(_words(F.col("text")), lambda w: w.isin(vocabulary)))).alias("w"))
    return {r[0]: r[1] for r in known.groupBy("w").agg(F.count(F.lit(1))).collect()}, texts.count()


def _scorer(idf: dict[str, float], rare: float, vectors: list[tuple[str, dict[str, float]]]):
    """A function from an array of words to the best (score, -place, licence) of it."""
    vocabulary = sorted(idf)
    table = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.struct(F.lit(idf[w]).alias("idf"), F.array(*[F.lit(float(v.get(w, 0.0))) for _, v in vectors]).alias("t")))])
    names = F.array(*[F.lit(name) for name, _ in vectors])
    zeros = F.array(*[F.lit(0.0)] * len(vectors))

    def scored(words: F.Column, known: F.Column) -> F.Column:
        terms = F.transform(F.array_distinct(known), lambda w: F.struct((F.log(F.size(F.filter(known, lambda x: x == w)).cast("double")) + 1).alias("n"), F.element_at(table, w).alias("e")))
        terms = _let(terms, lambda x: F.transform(x, lambda c: F.struct((c["n"] * c["e"]["idf"]).alias("v"), c["e"]["t"].alias("t"))))

        def with_terms(terms: F.Column) -> F.Column:
            norm = F.sqrt(F.aggregate(terms, (F.size(words) - F.size(known)) * F.lit(rare * rare), lambda a, t: a + t["v"] * t["v"]))
            dots = F.aggregate(terms, zeros, lambda a, t: F.zip_with(a, t["t"], lambda x, y: x + y * t["v"]))
            every = lambda n: F.transform(dots, lambda d, k: F.struct((F.element_at(names, k + 1) != LAST).alias("open"), F.round(F.coalesce(d / n, F.lit(0.0)), 6).alias("score"), (-k).alias("order"), F.element_at(names, k + 1).alias("name")))
            return _let(norm, every)

        return _let(terms, with_terms)

    return scored


def _let(value: F.Column, body) -> F.Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(docs: DataFrame, path: F.Column, min_score: float = 0.35, file_score: float = 0.7) -> DataFrame:
    """doc_id, path, own licence and score, and the licence with the directory it comes from (null: its own)."""
    rows = docs.select("doc_id", path.cast("string").alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    vocabulary = sorted({w for _, words in template_words() for w in words})
    if len(vocabulary) > MAX_TERMS:
        raise ValueError(f"templates may have at most {MAX_TERMS} words")
    idf, rare, vectors = weights(*_frequencies(rows, vocabulary))
    telling = telling_words(vectors, min_score)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_whole")), F.lit(HOP)), lambda k: F.slice(F.col("_whole"), k, WINDOW))
    scored, vocabulary = _scorer(idf, rare, vectors), sorted(idf)
    share = min_score * min_score / (1 - min_score * min_score) * math.e / 4
    none = F.array().cast("array<struct<open: boolean, score: double, order: int, name: string>>")

    def best_of(words: F.Column) -> F.Column:
        enough = lambda known: (F.size(known) >= F.lit(share * (1 - 1e-9)) * (F.size(words) - F.size(known))) & F.exists(known, lambda w: w.isin(telling))
        found = lambda known: F.when(enough(known), F.filter(scored(words, known), lambda s: s["score"] >= min_score)).otherwise(none)
        return F.array_max(_let(F.filter(words, lambda w: w != ""), found))

    # words that no template has are empty from here on; each step is a column, so that it is computed once
    lines = F.transform(F.split("text", r"\n"), lambda x: F.transform(_words(x), lambda w: F.when(w.isin(vocabulary), w).otherwise("")))
    found = rows.select("doc_id", "path", lines.alias("_lines")).withColumn("_whole", F.flatten("_lines"))
    found = found.select("doc_id", "path", F.array_max(F.transform(F.concat("_lines", windows), best_of)).alias("_best"), best_of(F.col("_whole")).alias("_all"))
    found = found.select("doc_id", "path", F.greatest("_best", "_all").alias("_top"), F.coalesce("_all.score", F.lit(0.0)).alias("_full"))
    named = F.col("path").rlike(FILE_NAME) | (F.col("_full") >= file_score)
    own = checkpointed(found.select("doc_id", "path", F.regexp_replace("path", r"/?[^/]*$", "").alias("_dir"), F.col("_top.name").alias("own_license"), F.col("_top.score").alias("own_score"), (F.col("_top").isNotNull() & F.coalesce(named, F.lit(False))).alias("is_file")))
    files = own.where(F.col("is_file") & F.col("path").isNotNull()).groupBy(F.col("_dir").alias("_at")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("name"))).alias("_file"))
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("at")))
    ancestors = own.where(F.col("path").isNotNull()).select("_dir").distinct().select("_dir", F.explode(above).alias("_a")).select("_dir", F.col("_a.depth").alias("_depth"), F.col("_a.at").alias("_at")).distinct()
    nearest = ancestors.join(files, "_at").groupBy("_dir").agg(F.max(F.struct("_depth", "_at", "_file")).alias("_from"))
    joined = own.join(nearest, "_dir", "left")
    return joined.select("doc_id", "path", "is_file", "own_license", "own_score", F.coalesce("own_license", F.col("_from._file.name")).alias("license"), F.when(F.col("own_license").isNull(), F.col("_from._at")).alias("inherited_from"))


def query_path() -> F.Column:
    """Documents have no paths: every fourth is taken as its language's licence file in its source, the others lie in one
    of 97 directories below."""
    top = F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"), F.coalesce("lang", F.lit("unknown")))
    below = F.concat(F.lit("/src/"), F.pmod("doc_id", F.lit(97)).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return F.concat(top, F.when(F.pmod("doc_id", F.lit(4)) == 0, "/LICENSE").otherwise(below))


def op7_license_scans(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), query_path())
