import hashlib
import random
from collections import Counter

import numpy as np

from weftline.llm.suffix_dedup import remove_repeated
from weftline.llm.suffix_groups import suffix_array


def test_suffix_array_equals_sorting():
    rng = random.Random(1)
    for _ in range(1500):
        s = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randrange(0, 40))] * rng.choice([1, 1, 3])
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows, width):
    raw = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[k : k + width] for _, b in raw for k in range(len(b) - width + 1))
    out = []
    for i, b in raw:
        keep = np.ones(len(b), bool)
        for k in range(len(b) - width + 1):
            if times[b[k : k + width]] > 1:
                keep[k : k + width] = False
        gone = np.concatenate([[0], (~keep).astype(int)])
        kept = bytes(x for x, y in zip(b, keep, strict=True) if y)
        out.append((i, len(b), int((~keep).sum()), int((np.diff(gone) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def hard(rng):
    """Shared stretches of all lengths around the width, chains of edits, periodic and binary-like texts."""
    base = "".join(rng.choice("abcd ") for _ in range(900))
    rows = [base, "\u0000" * 700, "ab" * 300, "ab" * 99 + "a", "x" * 199, "x" * 200, "x" * 201]
    for _ in range(60):
        a, n = rng.randrange(700), rng.choice([150, 198, 199, 200, 201, 202, 260, 400])
        rows.append("".join(rng.choice("efgh") for _ in range(rng.randrange(0, 150))) + base[a : a + n] + "".join(rng.choice("ijkl") for _ in range(rng.randrange(0, 150))))
    for _ in range(20):
        t = list(rng.choice(rows))
        for _ in range(rng.randrange(0, 4)):
            if t:
                t[rng.randrange(len(t))] = rng.choice("é\u0000z")
        rows.append("".join(t))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(spark, docs, corpus):
    key = lambda r: tuple(str(x) for x in r)
    rows = hard(random.Random(4))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for options in ({}, {"block_bytes": 2000}, {"width": 60, "gram": 20, "block_bytes": 5000}, {"block_bytes": 800, "hot": 2}, {"width": 60, "gram": 20, "block_bytes": 1500, "hot": 4}):
        got = sorted((tuple(r)[:5] for r in remove_repeated(frame, **options).collect()), key=key)
        assert got == sorted(brute(rows, options.get("width", 200)), key=key)
    assert sorted((tuple(r)[:5] for r in remove_repeated(docs).collect()), key=key) == sorted(brute(corpus, 200), key=key)


def test_hot_passages_in_different_surroundings(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    long, short = letters(260), letters(185)  # the second is hot, but no window of 200 bytes repeats
    rows = [(i, letters(90) + (long, short, long[:201])[i % 3] + letters(90)) for i in range(90)] + [(90, "z" * 5000), (91, "z" * 200)]
    key = lambda r: tuple(str(x) for x in r)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r)[:5] for r in remove_repeated(frame, block_bytes=700, hot=5).collect()), key=key)
    assert got == sorted(brute(rows, 200), key=key)


def test_empty_table(nothing):
    assert remove_repeated(nothing).count() == 0
