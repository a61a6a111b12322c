import math
import re
import time

from pyspark.sql import functions as F

from weftline.llm import license_scan as L

BSD = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software.
"""
HEADER = """# Licensed under the Apache License,
# Version 2.0 (the "License"); you may
# not use this file except in compliance
# with the License.

import os
"""
ROWS = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/b/x.txt", "plain text"),
    (3, "a/b/c/y.txt", "More.\nLicensed under the Apache License, Version 2.0.\nMore words of the text follow here and here and here and then some more of them until the end"),
    (4, "a/b/c/z.txt", "nothing"),
    (5, "d/w.txt", "nothing"),
    (6, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (7, "ab/v.txt", None),
    (8, None, "All rights reserved."),
    (9, "v.txt", ""),
    (9, "v.txt", ""),
    (10, "e/n.txt", "the licence of the poet is something else altogether, she said, and he agreed with her on that"),
    (11, "f/LICENSE", BSD),
    (12, "f/g/h/deep.c", "int main"),
    (13, "m/text.txt", MIT),
    (14, "m/other.txt", "nothing"),
    (15, "h/code.py", HEADER + "print(1)\n" * 50),
    (None, None, "Released under the MIT License."),
]


def units_of(text):
    words = lambda x: re.findall("[a-z0-9]+", x.lower())
    every = words(text)
    windows = [every[k : k + L.WINDOW] for k in range(0, max(1, len(every)), L.HOP)]
    return [every, *map(words, text.split("\n")), *windows]


def brute(texts, min_score):
    """The best (score, licence) of each text, from the definition."""
    words = {w for _, t in L.template_words() for w in t}
    df = {w: sum(w in re.findall("[a-z0-9]+", t.lower()) for t in texts) for w in words}
    n = len(texts)
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1
    out = []
    for text in texts:
        found = []
        for u in units_of(text):
            known = [w for w in u if w in words]
            times = lambda w, known=known: 1 + math.log(known.count(w))
            norm = math.sqrt(sum((times(w) * idf(w)) ** 2 for w in set(known)) + (len(u) - len(known)) * (math.log(1 + n) + 1) ** 2)
            for k, (name, t) in enumerate(L.template_words()):
                size = math.sqrt(sum(((1 + math.log(t.count(w))) * idf(w)) ** 2 for w in set(t)))
                score = round(sum(times(w) * idf(w) * (1 + math.log(t.count(w))) * idf(w) for w in set(known) & set(t)) / norm / size, 6) if known else 0.0
                if score >= min_score:
                    found.append((name != L.LAST, score, -k, name))
        out.append(max(found)[1::2] if found else (None, None))
    return out


def test_own_and_inherited(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, p string, text string")
    rows = L.scan(docs, F.col("p")).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: (r.license, r.inherited_from) for r in rows}
    want = {1: ("MIT", None), 2: ("GPL-3.0", "a/b"), 3: ("Apache-2.0", None), 4: ("GPL-3.0", "a/b"), 5: (None, None), 6: ("GPL-3.0", None), 7: (None, None), 8: ("Proprietary", None), 9: (None, None), 10: (None, None), 11: ("BSD-3-Clause", None), 12: ("BSD-3-Clause", "f"), 13: ("MIT", None), 14: ("MIT", "m"), 15: ("Apache-2.0", None), None: ("MIT", None)}
    assert got == want


def test_scores_equal_brute_force(spark):
    """Also that passing over units without a telling word loses none."""
    texts = [t or "" for *_, t in ROWS] + ["use of this software and the license in any form " * 5, "version 2.0 of all the rights", "public\n\nlicense\n \nfree software", "x " * 90 + "released into the public domain under cc0 " + "y " * 90]
    docs = spark.createDataFrame([(i, "p/q", t) for i, t in enumerate(texts)], "doc_id long, p string, text string")
    for min_score in (0.35, 0.1):
        got = {r.doc_id: (r.own_score, r.own_license) for r in L.scan(docs, F.col("p"), min_score=min_score).collect()}
        for i, (score, name) in enumerate(brute(texts, min_score)):
            assert (got[i][0] is None) == (score is None) and (score is None or abs(got[i][0] - score) < 2e-6), (i, got[i], score)
            assert got[i][1] == name


def test_long_lines_take_time_in_proportion(spark):
    docs = spark.createDataFrame([(1, "p/q", "released under the license " + " ".join(f"w{k}" for k in range(40_000))), (2, "p/q", "the license " * 20_000)], "doc_id long, p string, text string")
    began = time.time()
    assert {r.doc_id for r in L.scan(docs, F.col("p")).collect()} == {1, 2}
    assert time.time() - began < 60


def test_odd_rows(docs, corpus, nothing):
    assert L.scan(docs, F.lit("x/y")).count() == len(corpus)
    assert L.scan(nothing, F.lit("x/y")).count() == 0
    assert L.scan(docs, L.query_path()).where("doc_id is null and path is not null").count() == 0
