import hashlib
import re

from weftline.llm.substring_dedup import remove_repeats


def brute(rows, window=13):
    cut = [(i if i is not None else 1 << 62, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    first = {}
    for i, w in cut:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), (n, w) in zip(rows, cut, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < n:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_equals_brute_force(docs, corpus):
    key = lambda r: tuple(str(x) for x in r)
    for size in (1 << 22, 600):
        got = [tuple(r)[:4] for r in remove_repeats(docs, block_bytes=size).collect()]
        assert sorted(got, key=key) == sorted(brute(corpus), key=key)


def test_empty_table(nothing):
    assert remove_repeats(nothing).count() == 0
