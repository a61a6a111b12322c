import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import secrets_scan as S

PLAIN = {
    "assign": re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute(text):
    out = []
    for k, (name, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text or ""):
            if len(m.group(2) if name == "assign" else m.group()) >= (6, 20, 24)[k]:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


ODD = ["password=hunter2", "PassWord : 'abc'", "token=secret=abcdef", "api_key=\"A1b2C3\" APIkey:zzzzzz", "AKIA" + "A" * 15, "AKIA" + "AKIA" * 5, "x" + "0123456789abcdef" * 3 + "G", "paßword=abcdef", "secret = 'é' secret  =  'abcdef'", "toKen=abcdef ſecret=abcdef", "é🙂 token='" + "f0" * 20 + "'", "a" * 30, "=" * 50, None, ""]


@pytest.fixture(scope="module")
def network(spark):
    rng = random.Random(6)
    rows = [(i, f"some words here {rng.choice(['token', 'password'])}={rng.getrandbits(160):x} and words there") for i in range(150)]
    return S.fit(spark.createDataFrame(rows, "doc_id long, text string"))


def test_base_findings_equal_plain_patterns(spark, network, docs, corpus, nothing):
    rows = list(enumerate(ODD)) + [(100 + i if i is not None else None, t) for i, t in corpus]
    got = [(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string"), network).collect()]
    want = []
    for i, t in rows:
        spans = brute(t)
        want.append((i, *(sum(s.startswith(k + ":") for s in spans) for k in PLAIN), hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert S.scan(docs, network).count() == len(corpus)
    assert S.scan(nothing, network).count() == 0


def test_network_tells_held_out_secrets_from_prose(network):
    made = S._generated(random.Random(77))
    scores = network.scores([S.encode(t, a, b) for t, a, b, _ in made])
    labels = np.array([y for *_, y in made])
    assert np.mean(scores[labels > 0] >= network.threshold) > 0.93
    assert np.mean(scores[labels == 0] >= network.threshold) < 0.07


def test_every_candidate_is_scored(network):
    text = "see note password=abcdef12 and " + "9f" * 20 + "/Zx81kQpR77LmW2 in v2.1-build"
    found = S.find_all([text], network)[0]
    base = S.base_spans(text)
    assert [f[:4] for f in found if f[2] < 3] == base and all(0 <= f[4] <= 1 for f in found)
    rest = [text[a:b] for a, b in S.other_runs(text, base)]
    assert "/Zx81kQpR77LmW2" in rest  # what a base finding leaves of a run
    assert {"recall", "flagged harmless", "temperature"} <= network.report.keys() and network.report["recall"] >= 0.98


def test_very_long_and_repeated(spark, network):
    rows = [(1, "a1" * 50_000), (1, "a1" * 50_000), (2, "x " * 60_000 + "token=abcdef")]
    got = S.scan(spark.createDataFrame(rows, "doc_id long, text string"), network).collect()
    assert sorted(r.n_assign for r in got) == [0, 0, 1] and got[0].spans.count(":") <= 4


def test_scores_do_not_depend_on_the_batch(network):
    samples = [S.encode(t, a, b) for t, a, b, _ in S._generated(random.Random(1))[:20]]
    one = np.concatenate([network.scores([s]) for s in samples])
    assert np.allclose(one, network.scores(samples))


def test_gradients():
    network = S.CharNetwork(seed=9)
    samples, d = [S.encode(t, a, b) for t, a, b, _ in S._generated(random.Random(2))[:3]], np.array([0.3, -0.2, 0.5])
    grads = network.backward(network.forward(samples)[1], d)
    for name in ("k", "w1", "e"):
        at = np.unravel_index(int(np.argmax(np.abs(grads[name]))), grads[name].shape)
        step, values = 1e-5, []
        for sign in (1, -1):
            network.p[name][at] += sign * step
            values.append(float(network.forward(samples)[0] @ d))
            network.p[name][at] -= sign * step
        assert grads[name][at] == pytest.approx((values[0] - values[1]) / (2 * step), rel=1e-3)


def test_redaction(spark, network):
    rows = [(1, "a password=abcdef12 b", 21, "x"), (2, "nothing", 7, None), (3, None, None, "y"), (4, "token = \"" + "0a" * 20 + "\"!", 51, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _h string")
    got = {r.doc_id: r for r in S.redact(docs, network).collect()}
    assert got[1].text == "a password=<assign> b" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "nothing" and got[3].text is None and got[3].n_chars is None
    assert got[4].text == 'token = "<assign>"!' and got[4]["_h"] == "z"
    assert S.redact(docs, network).select(F.count("*")).first()[0] == 4
