import random
import re

import numpy as np

from weftline.llm import blocks as B
from weftline.llm.ngram_join import components, keep_one
from weftline.llm.signature_tree import UnionFind, bitmap, bits_for, link_candidates, link_sets


def sets_of(rows):
    out = []
    for _, t in rows:
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(rows, percent=75):
    ids, sets = [i if i is not None else B.NO_ID for i, _ in rows], sets_of(rows)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return [(i, len(s), find(i) if s else i) for i, s in zip(ids, sets, strict=True)]


def variants(rng):
    """Chains of near copies around the threshold, groups of copies, and many texts around one passage."""
    rows, passage = [], [f"p{k}" for k in range(60)]
    for g in range(12):
        words = [f"g{g}w{k}" for k in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, 14)):
            words = list(words)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(words).title() if rng.random() < 0.3 else " ".join(words))
    for k in range(40):
        rows.append(" ".join([f"x{k}a{j}" for j in range(rng.randrange(0, 40))] + passage))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(spark, docs, corpus):
    rows = variants(random.Random(8))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    digest = lambda found: sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
    for options in ({}, {"block_bytes": 3000, "group": 6}):
        got, want = digest(components(frame, **options)), sorted(brute(rows))
        assert [x for x in got if x not in want] == [] and len(got) == len(want)
    assert digest(components(docs)) == sorted(brute(corpus))


def test_trees_equal_all_pairs():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = []
    for _ in range(150):
        if sets and rng.random() < 0.6:
            base = sets[rng.integers(len(sets))]
            s = np.union1d(rng.choice(base, max(1, len(base) - rng.integers(0, 8)), replace=False), rng.choice(pool, rng.integers(0, 5)))
        else:
            s = np.unique(rng.choice(pool, rng.integers(1, 90)))
        sets.append(s)
    similar = {(a, b) for b in range(150) for a in range(b) if 175 * len(np.intersect1d(sets[a], sets[b])) >= 75 * (len(sets[a]) + len(sets[b]))}
    links = link_sets(sets, 75)
    up = list(range(150))
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in similar:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert [links.find(k) for k in range(150)] == [find(k) for k in range(150)]
    doubt = UnionFind(150)
    link_candidates([bitmap(s, bits_for(len(s))) for s in sets], np.array([len(s) for s in sets]), list(range(150)), doubt, 75)
    assert all(doubt.find(a) == doubt.find(b) for a, b in similar)


def test_one_of_each_group_stays(docs, corpus, nothing):
    want = {i for i, _, c in brute(corpus) if i == c} - {B.NO_ID}
    kept = keep_one(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns and {r.doc_id for r in rows if r.doc_id is not None} == want
    assert sum(r.doc_id is None for r in rows) == 2
    assert components(nothing).count() == 0 and keep_one(nothing).count() == 0


def test_null_and_repeated_ids(spark):
    """Null ids are documents of their own, also with equally many shingles; texts of one id are one document."""
    text = lambda name, n=40: " ".join(f"{name}{k}" for k in range(n))
    rows = [(1, text("a") + " x"), (2, text("b") + " x"), (3, text("c") + " x"), (None, text("a")), (None, text("b")), (None, text("c", 39)), (None, text("lone")), (None, text("lone") + " x"), (7, text("d")), (7, text("e")), (4, text("d") + " x"), (8, text("e") + " x")]
    want = sorted([(1, 1), (2, 2), (3, 3), (B.NO_ID, 1), (B.NO_ID, 2), (B.NO_ID, 3), (B.NO_ID, B.NO_ID), (B.NO_ID, B.NO_ID), (7, 4), (7, 4), (4, 4), (8, 4)])
    for options in ({}, {"block_bytes": 400, "group": 3}):
        for slices in (1, 4):
            frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(slices)
            assert sorted((r.doc_id, r.component_id) for r in components(frame, **options).collect()) == want
    assert {r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect() if r.doc_id is not None} == {1, 2, 3, 4}
