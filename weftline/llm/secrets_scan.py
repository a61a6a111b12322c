"""Operator 10, secret scans: a character convolutional network over every candidate and its context.

Three patterns give the base findings, which always stay. Candidates are the base findings and every other run of
``MIN_RUN`` or more characters of ``[A-Za-z0-9+/_.=-]`` with a letter and a digit; of a run that base findings cover in
part, the uncovered rests. The network reads each whole candidate and ``CONTEXT`` characters on either side: character
embeddings, a marker for inside and outside, one convolution, maximum and mean over all places, two dense layers. It gives
every candidate, base findings too, a calibrated probability; candidates of any length are read whole.

It is trained on labelled findings: base findings of a bounded sample of documents are positive; prose words and those
other runs of the sample whose characters are too regular for a key (entropy under ``REGULAR`` bits a character) are
negative; more regular ones stay unlabelled, for a key that no pattern knows may be among them. Generated keys and
harmless runs (dates, paths, hosts, mail names, versions, numbers) are added on both sides. Probabilities are calibrated by
temperature on held-out findings. The threshold is the highest that keeps ``recall`` of those held-out positive ones that
no pattern finds, which are what it decides; candidates at or above it that are no base findings are added as kind
``model``. ``report`` holds recall and the share of harmless runs flagged, on held-out findings.

Training is bounded by ``max_docs`` documents, ``max_samples`` findings and ``max_chars`` characters of one.

``redact`` replaces every found secret by its kind in angle brackets and keeps the rest of the text.

Defined results: null and empty texts have no findings; rows with equal ids or texts are kept, each with the same result;
overlapping base findings of different kinds are all reported, in order of start, then kind; positions are code points,
ends exclusive. A span is the whole match of a pattern; ``redact`` replaces the value only.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import blocks as B
from weftline.llm.networks import Adam, sigmoid, temperature

_any_case = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
NAMES = "|".join([_any_case(w) for w in ("password", "passwd", "secret", "token")] + [_any_case("api") + "_?" + _any_case("key")])
ASSIGN = re.compile(rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_RUN, CONTEXT = 8, 12
REGULAR = 3.0
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_RUN)
WORD, WORDS_OF_A_TEXT = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z]{6,}(?![A-Za-z0-9+/_.=-])"), 4
KINDS = ("assign", "access", "hex", "model")
MAX_TRAIN_DOCS, MAX_SAMPLES, MAX_SAMPLE_CHARS = 4000, 12_000, 1000
DECIDED = 2.0  # label of a positive finding that no pattern finds
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, probabilities string"


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the value) of each base finding, in order."""
    out = []
    if ("=" in text or ":" in text) and ASSIGN.search(text):
        out += [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def other_runs(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Runs outside the base findings, or their parts between them."""
    out, k = [], 0
    covered = sorted((a, b) for a, b, *_ in base)
    for m in RUN.finditer(text):
        at, end = m.span()
        while k < len(covered) and covered[k][1] <= at:
            k += 1
        pieces, j = [], k
        while j < len(covered) and covered[j][0] < end:
            pieces.append((at, covered[j][0]))
            at = max(at, covered[j][1])
            j += 1
        out += [(a, b) for a, b in [*pieces, (at, end)] if b - a >= MIN_RUN and DIGIT.search(text, a, b) and LETTER.search(text, a, b)]
    return out


def entropy(word: str) -> float:
    """Bits a character of the distribution of a word's characters."""
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values())


_CODE = np.zeros(128, np.int64)
for _k, _c in enumerate(string.ascii_letters + string.digits + "+/_.=-:\"' ,;()<>[]{}|@#&%!?\n\t*\\"):
    _CODE[ord(_c)] = _k + 2
N_CODES = int(_CODE.max()) + 1


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character codes of a candidate and its context; the second row marks the candidate."""
    lo, hi = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    raw = np.frombuffer(text[lo:hi].encode("utf-32-le"), np.uint32)
    codes = np.where(raw < 128, _CODE[np.minimum(raw, 127)], 1)
    inside = np.zeros(len(codes), np.int64)
    inside[start - lo : end - lo] = 1
    return np.stack([codes, inside])


class CharNetwork:
    """Embedding, one convolution over ``width`` places, maximum and mean pooling, two dense layers."""

    def __init__(self, embed: int = 10, width: int = 5, filters: int = 24, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.width, self.t, self.threshold, self.report = width, 1.0, 0.5, {}
        self.p = {"e": rng.normal(0, 0.3, (N_CODES, embed)), "k": rng.normal(0, (width * (embed + 1)) ** -0.5, (width * (embed + 1), filters)), "kb": np.zeros(filters), "w1": rng.normal(0, (2 * filters) ** -0.5, (2 * filters, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, hidden**-0.5, hidden), "b2": np.zeros(1)}

    def forward(self, samples: list[np.ndarray]) -> tuple[np.ndarray, dict]:
        """All samples in one row with gaps between, so that no length is special."""
        w, sizes = self.width, np.array([s.shape[1] for s in samples])
        gap = w - 1
        starts = np.concatenate([[0], np.cumsum(sizes + gap)])[:-1]
        codes, inside = np.zeros(int((sizes + gap).sum()) + gap, np.int64), np.zeros(int((sizes + gap).sum()) + gap)
        for s, at in zip(samples, starts, strict=True):
            codes[at + gap // 2 : at + gap // 2 + s.shape[1]], inside[at + gap // 2 : at + gap // 2 + s.shape[1]] = s
        x = np.concatenate([self.p["e"][codes] * (codes > 0)[:, None], inside[:, None]], 1)
        n = len(x) - gap
        cols = np.concatenate([x[i : i + n] for i in range(w)], 1)
        y = np.maximum(cols @ self.p["k"] + self.p["kb"], 0)
        owner = np.repeat(np.arange(len(samples)), sizes)
        rows = np.concatenate([np.arange(a, a + m) for a, m in zip(starts, sizes, strict=True)])
        y = y[rows]
        cuts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        top, mean = np.maximum.reduceat(y, cuts, axis=0), np.add.reduceat(y, cuts, axis=0) / sizes[:, None]
        pooled = np.concatenate([top, mean], 1)
        h = np.tanh(pooled @ self.p["w1"] + self.p["b1"])
        return h @ self.p["w2"] + self.p["b2"], {"codes": codes, "cols": cols, "y": y, "rows": rows, "owner": owner, "sizes": sizes, "top": top, "pooled": pooled, "h": h}

    def backward(self, c: dict, d: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.p["kb"].size
        dh = np.outer(d, p["w2"]) * (1 - c["h"] ** 2)
        dp = dh @ p["w1"].T
        top = (c["y"] == c["top"][c["owner"]]) & (c["y"] > 0)
        dy = np.where(top, dp[:, :f][c["owner"]], 0) + (dp[:, f:] / c["sizes"][:, None])[c["owner"]] * (c["y"] > 0)
        cols = c["cols"][c["rows"]]
        dcols = dy @ p["k"].T
        de, width = np.zeros_like(p["e"]), p["e"].shape[1]
        for i in range(self.width):
            np.add.at(de, c["codes"][c["rows"] + i], dcols[:, i * (width + 1) : i * (width + 1) + width])
        de[0] = 0
        return {"w2": c["h"].T @ d, "b2": np.array([d.sum()]), "w1": c["pooled"].T @ dh, "b1": dh.sum(0), "k": cols.T @ dy, "kb": dy.sum(0), "e": de}

    def fit(self, samples: list[np.ndarray], labels: np.ndarray, recall: float, epochs: int = 12, batch: int = 64, seed: int = 5) -> None:
        """``labels``: 0 harmless, 1 a base finding, ``DECIDED`` a secret that no pattern finds."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(samples))
        held, used = order[: len(order) // 4], order[len(order) // 4 :]
        adam = Adam(self.p, 8e-3)
        for _ in range(epochs):
            used = rng.permutation(used)
            for at in range(0, len(used), batch):
                rows = used[at : at + batch]
                z, cache = self.forward([samples[i] for i in rows])
                adam.step(self.backward(cache, (sigmoid(z) - (labels[rows] > 0)) / len(rows)))
        z = self.forward([samples[i] for i in held])[0]
        self.t = temperature(z, labels[held])
        p = sigmoid(z / self.t)
        good = np.sort(p[labels[held] == DECIDED])
        self.threshold = float(good[int((1 - recall) * len(good))]) if len(good) else 0.5
        share = lambda mask: float(np.mean(p[mask] >= self.threshold)) if mask.any() else None
        self.report = {"recall": share(labels[held] == DECIDED), "base recall": share(labels[held] == 1), "flagged harmless": share(labels[held] == 0), "temperature": self.t, "threshold": self.threshold, "held out": len(held)}

    def scores(self, samples: list[np.ndarray]) -> np.ndarray:
        out, at = [np.zeros(0)], 0
        while at < len(samples):  # bounded memory: some thousand characters at a time, one sample at least
            to, size = at, 0
            while to < len(samples) and (to == at or size + samples[to].shape[1] < 200_000):
                size += samples[to].shape[1]
                to += 1
            out.append(sigmoid(self.forward(samples[at:to])[0] / self.t))
            at = to
        return np.concatenate(out)


def _generated(rng: random.Random) -> list[tuple[str, int, int, float]]:
    """(text, start, end, label) of made-up findings and harmless runs, for contexts that a sample may lack."""
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    word = lambda: pick("abcdehilnorst", rng.randrange(3, 9))
    out = []
    for _ in range(500):
        name = rng.choice(["password", "passwd", "secret", "token", "api_key", "APIKEY", "auth", "key", "private"])
        value = rng.choice([pick(string.ascii_letters + string.digits, rng.randrange(16, 44)), pick("0123456789abcdef", rng.randrange(24, 64)), pick(string.ascii_letters + string.digits + "+/", 40) + "=", "AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghx_" + pick(string.ascii_letters + string.digits, 36)])
        before = rng.choice([f"{name}=", f"{name}: ", f'{name} = "', f"{word()} ", ""])
        out.append((before, value, 1))
        value = rng.choice([f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}T{rng.randrange(24):02}.{rng.randrange(60):02}", f"{word()}/{word()}/{word()}{rng.randrange(99)}.html", f"{word()}.{word()}{rng.randrange(9)}.example.com", f"v{rng.randrange(9)}.{rng.randrange(9)}.{rng.randrange(99)}-{word()}-{word()}", "-".join(word() for _ in range(4)) + str(rng.randrange(99)), f"{word()}_{word()}_{word()}{rng.randrange(10)}", f"{word()}{word()}{word()}{rng.randrange(10)}", f"x={rng.randrange(10 ** 6)}/{rng.randrange(10 ** 8)}.{word()}", f"{word()}.{word()}{rng.randrange(100)}", f"{word()}{rng.randrange(1000)}", f"{rng.randrange(10 ** 9)}", f"{word()}{rng.randrange(10)}-{word()}"])
        out.append((rng.choice([f"{word()} ", "see ", "(", ""]), value, 0))
    made = []
    for before, value, label in out:
        before = f"{word()} {word()} {before}"
        made.append((f"{before}{value}{rng.choice([' ', '.', ',', '@', chr(34)])}{word()} {word()}", len(before), len(before) + len(value), DECIDED if label else 0.0))
    return made


def fit(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS, recall: float = 0.98, max_samples: int = MAX_SAMPLES, max_chars: int = MAX_SAMPLE_CHARS) -> CharNetwork:
    """Train on at most ``max_samples`` findings, of ``max_chars`` characters at most, of at most ``max_docs`` documents,
    the least by a hash of the text."""
    chosen = B.plain(docs).select(F.xxhash64("text").alias("_h"), "doc_id", F.octet_length("text").alias("_n")).orderBy("_h", "doc_id").limit(max_docs)
    bound = F.broadcast(chosen.select("_h").distinct())

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                base = base_spans(text)
                other = [(a, b) for a, b in other_runs(text, base) if entropy(text[a:b]) < REGULAR]
                words = [m.span() for m in WORD.finditer(text)]
                step = max(1, len(words) // WORDS_OF_A_TEXT)
                own = [(a, b, 1) for a, b, *_ in base] + [(a, b, 0) for a, b in other + words[::step]]
                rows += [(encode(text, a, b).astype(np.int16).tobytes(), y) for a, b, y in own if b - a <= max_chars]
            yield pd.DataFrame(rows, columns=["sample", "label"])

    sampled = B.plain(docs).withColumn("_h", F.xxhash64("text")).join(bound, "_h").dropDuplicates(["_h"]).select("text")
    # a finding with both labels is a finding; least by hash, not the first ones met
    found = sampled.mapInPandas(find, "sample binary, label int").groupBy("sample").agg(F.max("label").alias("label"))
    rows = found.orderBy(F.xxhash64("sample"), "sample").limit(max_samples).collect()
    samples = [np.frombuffer(r[0], np.int16).reshape(2, -1).astype(np.int64) for r in rows]
    labels = [float(r[1]) for r in rows]
    for text, start, end, label in _generated(random.Random(11)):
        samples.append(encode(text, start, end))
        labels.append(label)
    network = CharNetwork()
    network.fit(samples, np.array(labels), recall)
    return network


def find_all(texts: list[str], network: CharNetwork) -> list[list[tuple[int, int, int, int, float]]]:
    """(start, end, kind, start of the value, probability) of all findings of each text; every candidate is scored."""
    base = [base_spans(t) for t in texts]
    every = [(k, a, b, kind, v) for k, own in enumerate(base) for a, b, kind, v in own]
    every += [(k, a, b, 3, a) for k, t in enumerate(texts) for a, b in other_runs(t, base[k])]
    out: list[list] = [[] for _ in texts]
    for at in range(0, len(every), 2000):
        some = every[at : at + 2000]
        for (k, a, b, kind, v), p in zip(some, network.scores([encode(texts[k], a, b) for k, a, b, *_ in some]).tolist(), strict=True):
            if kind < 3 or p >= network.threshold:
                out[k].append((a, b, kind, v, p))
    return [sorted(x, key=lambda s: (s[0], s[2])) for x in out]


def scan(docs: DataFrame, network: CharNetwork) -> DataFrame:
    line = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, *_ in spans)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, spans in zip(frame["doc_id"], find_all(frame["text"].tolist(), network), strict=True):
                base = [s for s in spans if s[2] < 3]
                n = [sum(s[2] == k for s in spans) for k in range(4)]
                rows.append((doc_id, *n[:3], hashlib.sha256(line(base).encode()).hexdigest(), line(spans), n[3], ",".join(f"{s[4]:.3f}" for s in spans)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])
        B.give_back()

    return B.with_null_ids(B.plain(docs).mapInPandas(run, RESULT))


def redacted(text: str, spans: list[tuple]) -> str:
    out, at = [], 0
    for value, end, kind in sorted((v, b, k) for _, b, k, v, *_ in spans):
        if end > at:
            out += [text[at : max(value, at)], "" if value < at else f"<{KINDS[kind]}>"]
            at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, network: CharNetwork) -> DataFrame:
    """``docs`` with secrets replaced; all rows and columns stay."""

    def change(texts: list[str | None]) -> tuple[list[bool], list[str | None]]:
        found = find_all([t or "" for t in texts], network)
        return [True] * len(texts), [redacted(t, s) if s else t for t, s in zip(texts, found, strict=True)]

    return B.rewrite(docs, change)


def op10_secret_scans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, fit(docs))
