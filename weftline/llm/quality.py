"""Operator 2, quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Tokens are runs of letters, digits or one sort of punctuation. Each has two words: the whole lower-cased token with its
case shape, and, for tokens that training did not meet, its stem (sort, shape and first three bytes). Both are hashed to
``WORDS`` rows of a table of their own. Each whole word has a fixed sparse ternary index vector; a row's context vector is
the sum of the index vectors of its neighbours over the training texts, scaled to length one. A document's features are
the mean context vectors of its tokens' words and stems and a few pooled measures of the same streams: how often
neighbours are equal, how many words and 5-word windows are distinct, mean lengths. The network is trained on labelled
rows outside the held-out fold; its probabilities are calibrated by a temperature fitted on a part of them that it was
not trained on.

The classifier is fitted on at most ``max_train`` labelled rows, the least by a hash of doc_id; scoring covers every
whole text and needs no shuffle. Labels, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts have all-zero features and get the network's score for them; documents of any
length are pooled whole; equal texts have equal scores. Of rows with one doc_id the least text is used for training, of
labels of one doc_id the larger. With fewer than ``min_train`` labelled rows, or labels of one class, there is no network:
every score is 0.5, and ``keep_good`` keeps every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import blocks as B
from weftline.llm.hashing import LOWER, Tokens, mix, word_hashes
from weftline.llm.networks import TwoLayer
from weftline.session import checkpointed

WORDS, DIMS, NONZERO, REACH = 1 << 14, 40, 6, 2
POOLED = 2 * DIMS  # features that are vectors; six measures follow
MAX_TRAIN, MIN_TRAIN, SUM_TASKS = 8000, 10, 6
SLICE_BYTES = 1 << 19  # of texts whose features are computed at once
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

_CLASS = np.full(256, 3, np.uint8)  # punctuation
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0x80:] = 1
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, the same in every process."""
    rng = np.random.default_rng(20240101)
    out = np.zeros((WORDS, DIMS), np.float32)
    out[np.arange(WORDS)[:, None], np.argsort(rng.random((WORDS, DIMS)), axis=1)[:, :NONZERO]] = rng.choice(np.array([-1, 1], np.float32), (WORDS, NONZERO))
    return out


def tokens_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the whole word, row of the stem, and document of each token."""
    kind = _CLASS[data]
    begin = kind > 0
    if len(data):
        begin[1:] &= (kind[1:] != kind[:-1]) | ((kind[1:] == 3) & (data[1:] != data[:-1]))
        cuts = starts[(starts > 0) & (starts < len(data))]
        begin[cuts] = kind[cuts] > 0
    at = np.flatnonzero(begin)
    ends = np.minimum(np.append(at[1:], len(data)), _next_gap(kind, at))
    lower = LOWER[data]
    low = np.concatenate([lower, np.zeros(4, np.uint8)]).astype(np.uint64)
    sizes = ends - at
    key = kind[at].astype(np.uint64)
    for k in range(3):
        key = key * np.uint64(257) + np.where(sizes > k, low[at + k] + np.uint64(1), 0).astype(np.uint64)
    upper = np.concatenate([_UPPER[data], np.zeros(2, bool)])
    shape = (upper[at] * 1 + (upper[at] & upper[at + 1]) * 1).astype(np.uint64)
    rows = lambda x: (mix(x * np.uint64(4) + shape) >> np.uint64(50)).astype(np.int64)
    return rows(word_hashes(lower, at, ends)), rows(key), np.searchsorted(starts, at, side="right") - 1


def _next_gap(kind: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The next white space from each place on."""
    gaps = np.append(np.flatnonzero(kind == 0), len(kind))
    return gaps[np.searchsorted(gaps, at)]


def context_sums(data: np.ndarray, starts: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For the rows of whole words and of stems, the sums of the index vectors of the words near by."""
    words, stems, doc = tokens_of(data, starts)
    out = np.zeros((2, WORDS, DIMS), np.float32)
    for step in range(1, REACH + 1):
        near = np.flatnonzero(doc[step:] == doc[:-step]) if len(words) > step else ()
        if len(near):
            for rows, total in zip((words, stems), out, strict=True):
                for a, b in ((rows[near], words[near + step]), (rows[near + step], words[near])):
                    pairs, counts = np.unique(a * WORDS + b, return_counts=True)
                    at = pairs // WORDS
                    cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    total[at[cuts]] += np.add.reduceat(index[pairs % WORDS] * counts[:, None].astype(np.float32), cuts, axis=0)
    return out


def _slices(texts: pd.Series) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, starts) of texts of ``SLICE_BYTES`` together, one at least."""
    raw = [t.encode("utf-8") for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    at = 0
    while at < len(raw):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
        yield at, to, np.frombuffer(b"".join(raw[at:to]), np.uint8), ends[at : to + 1] - ends[at]
        at = to


def _share(doc: np.ndarray, hits: np.ndarray, n_docs: int) -> np.ndarray:
    total = np.bincount(doc, minlength=n_docs)
    return np.bincount(doc, hits, minlength=n_docs) / np.maximum(total, 1)


def _distinct(doc: np.ndarray, values: np.ndarray, n_docs: int) -> np.ndarray:
    """Share of distinct values in each document, 0 for none. 40 bits of a hash are enough within one document."""
    keys = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (values >> np.uint64(24)))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=n_docs) / np.maximum(np.bincount(doc, minlength=n_docs), 1)


def features(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    n_docs = len(starts) - 1
    *both, doc = tokens_of(data, starts)
    pooled = np.zeros((n_docs, POOLED + 6))
    cuts = np.searchsorted(doc, np.arange(n_docs))
    some = np.flatnonzero(np.bincount(doc, minlength=n_docs))
    for lo in range(0, len(some), 256):  # a few documents at a time bound the gathered vectors
        part = some[lo : lo + 256]
        a, b = cuts[part[0]], cuts[part[-1] + 1] if part[-1] + 1 < n_docs else len(doc)
        for k, rows in enumerate(both):
            pooled[part, k * DIMS : (k + 1) * DIMS] = np.add.reduceat(table[k][rows[a:b]], cuts[part] - a, axis=0) / np.diff(np.append(cuts[part], b))[:, None]
    words = Tokens(data, starts)
    same = np.zeros(len(words.hashes))
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    five, whole = words.windows(5)
    pooled[:, POOLED] = _share(words.doc, same, n_docs)
    pooled[:, POOLED + 1] = _distinct(words.doc, words.hashes, n_docs)
    pooled[:, POOLED + 2] = _distinct(words.doc[whole], five[whole], n_docs)
    pooled[:, POOLED + 3] = _share(words.doc, (words.end - words.begin).astype(float), n_docs) / 10
    pooled[:, POOLED + 4] = np.log1p(words.counts) / 10
    pooled[:, POOLED + 5] = np.bincount(doc, minlength=n_docs) / np.maximum(words.counts, 1)
    return pooled


class Classifier:
    """The fitted tables and network; travels to tasks in their closure (about 5 MB)."""

    def __init__(self, table: np.ndarray, network: TwoLayer | None):
        self.table, self.network = table, network

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out, at = [], 0
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
            x = features(np.frombuffer(b"".join(texts[at:to]), np.uint8), ends[at : to + 1] - ends[at], self.table)
            out.append(self.network.scores(x) if self.network else np.full(to - at, 0.5))
            at = to
        return np.concatenate(out) if out else np.zeros(0)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, min_train: int = MIN_TRAIN) -> Classifier:
    """Fit on at most ``max_train`` labelled rows outside the held-out fold."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows_of = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = checkpointed(rows_of.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).repartition(4 * SUM_TASKS, "doc_id"))
    index = index_vectors()

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, WORDS, DIMS), np.float32)
        for frame in frames:
            for _, _, data, starts in _slices(frame["text"]):
                total += context_sums(data, starts, index)
        B.give_back()
        yield pd.DataFrame({"sums": [total.tobytes()]})

    table = np.zeros((2, WORDS, DIMS), np.float32)
    for row in sample.coalesce(SUM_TASKS).mapInPandas(sums, "sums binary").collect():
        table += np.frombuffer(row[0], np.float32).reshape(2, WORDS, DIMS)
    table /= np.linalg.norm(table, axis=2, keepdims=True) + 1e-6

    def pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, to, data, starts in _slices(frame["text"]):
                x = features(data, starts, table).astype(np.float32)
                own = frame.iloc[at:to]
                yield pd.DataFrame({"doc_id": own["doc_id"], "quality": own["quality"].astype(int), "x": [r.tobytes() for r in x]})
        B.give_back()

    rows = sample.mapInPandas(pooled, "doc_id long, quality int, x binary").collect()
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    y = np.array([float(r[1] > 0) for r in rows])
    if len(rows) < max(2, min_train) or y.min() == y.max():
        return Classifier(table, None)
    return Classifier(table, TwoLayer(np.stack([np.frombuffer(r[2], np.float32) for r in rows]).astype(float), y))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": model.scores([t.encode("utf-8") for t in frame["text"]])})
        B.give_back()

    rows = B.with_null_ids(B.plain(docs).mapInPandas(run, "doc_id long, score double"))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns; all rows, where there is no network."""
    if model.network is None:
        return docs

    def change(texts: list[str | None]) -> tuple[list[bool], list[str | None]]:
        return (model.scores([(t or "").encode("utf-8") for t in texts]) >= threshold).tolist(), texts

    return B.rewrite(docs, change)


def op2_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
