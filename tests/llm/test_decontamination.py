import hashlib
import random
import re

from weftline.llm.decontamination import decontaminate, find_windows, report


def words(t):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, window=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_equals_brute_force(spark, docs, corpus):
    rng = random.Random(3)
    texts = [t for _, t in corpus if t and len(t.split()) > 30]
    long = [(k, " ".join(rng.choice(texts).upper().split()[5:27])) for k in range(12)]
    short = [(50, "w1-w2"), (51, " ".join(texts[3].split()[4:8])), (52, ""), (53, None), (None, " ".join(texts[5].split()[:12])), (54, "nothing like it"), (10, long[0][1])]
    key = lambda r: tuple(str(x) for x in r)
    for items in (long, long + short, [(1, "w7")], []):
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = [tuple(r) for r in report(find_windows(docs, bench)).collect()]
        assert sorted(got, key=key) == sorted(brute(corpus, items), key=key)


def test_spans_are_cut_and_columns_kept(spark, docs, nothing):
    rows = [(1, "Clean text, that stays."), (2, "Before it. " + "alpha beta gamma delta epsilon zeta eta theta iota kappa" + " and after it there is much more text of its own kind"), (3, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate(frame, bench).collect()}
    assert got == {1: rows[0][1], 2: "Before it.  and after it there is much more text of its own kind"}
    assert decontaminate(docs, bench).columns == docs.columns
    assert decontaminate(nothing, bench).count() == 0
