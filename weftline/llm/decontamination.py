"""Operator 3, benchmark decontamination: a generalised suffix automaton of normalised test items.

Words are runs of digits, lower-cased letters A-Z and bytes above 0x7F. The automaton is built over the items' words.
A document's words are streamed through it; at each word the state gives the length of the longest suffix that occurs
in some item. A word is hit when it lies in an occurrence of a window: ``window`` consecutive words of an item, or a
whole item that has fewer. Document words whose neighbours cannot match are skipped beforehand, exactly: an occurrence
of two or more words holds only word pairs of the items, so only runs of such pairs (or of known words, if an item is
one word) that are long enough are streamed.

The automaton is broadcast in the task closure; its size is that of the items, which ``MAX_ITEM_WORDS`` bounds. Larger
benchmarks are cut into slices by item, one pass over the documents for each slice, and results are merged.

``decontaminate`` removes documents or spans beyond limits of length and coverage.

Defined results: null and empty texts have no words and are never contaminated; items without words are never found;
an item with a null id is named by the empty string; repeated items count once by id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import blocks as B
from weftline.llm.hashing import LOWER, Tokens, member, token_table

MAX_ITEM_WORDS = 2_000_000
FOUND = "doc_id long, n_words long, hit_spans array<struct<first: long, last: long>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of one text."""
    raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    keep = token_table("alnum")[raw]
    return np.where(keep, LOWER[raw], 32).astype(np.uint8).tobytes().split()


class Automaton:
    """Suffix automaton of several word sequences; states know the items whose windows end in them."""

    def __init__(self, items: list[tuple[str, list]], window: int):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.items: list[set] = [set() for _ in self.next]  # of items that hold the state's words, by state of full windows
        self.short: list[tuple] = [()] * len(self.next)  # (length, item) of whole short items that end in the state
        shorts: dict[int, dict] = {}
        for name, words in items:
            state, n = 0, 0
            for word in words:
                state, n = self._step(state, n, word)
                if n >= window:
                    self.items[self._shrunk(state)].add(name)
            if words and len(words) < window:
                shorts.setdefault(state, {})[(len(words), name)] = None
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            up = self.short[self.link[state]] if state else ()
            self.short[state] = (*shorts.get(state, ()), *up)

    def _extend(self, last: int, word) -> int:
        if (to := self.next[last].get(word)) is not None:
            if self.length[to] == self.length[last] + 1:
                return to
            return self._split(last, to, word)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, to, word)
        return new

    def _split(self, at: int, to: int, word) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[to]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[to])
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _step(self, state: int, n: int, word) -> tuple[int, int]:
        """The longest suffix of what was read that occurs in an item: its state and its length."""
        while state and word not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        if (to := self.next[state].get(word)) is None:
            return 0, 0
        return to, n + 1

    def _shrunk(self, state: int) -> int:
        """The state of the last ``window`` words."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, words) -> Iterator[tuple[int, int, tuple | set]]:
        """(place, length of the hit that ends there, items) for each word that ends an occurrence of a window."""
        state = n = 0
        for at, word in enumerate(words):
            state, n = self._step(state, n, word)
            if n >= self.window:
                short = self.short[state]
                found = self.items[self._shrunk(state)]
                yield at, self.window, found | {x for k, x in short if k <= n} if short else found
            elif n and (short := [(k, x) for k, x in self.short[state] if k <= n]):
                yield at, max(k for k, _ in short), {x for _, x in short}


class Matcher:
    """What a task needs: the automaton over 64-bit word hashes and the items' words and word pairs."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        sequences = [(name, w) for name, text in items if (w := _hashes(words_of(text)))]
        self.automaton = Automaton(sequences, window)
        lengths = [min(window, len(w)) for _, w in sequences]
        self.least = min(lengths, default=0)
        self.words = np.unique(np.array([x for _, w in sequences for x in w], np.uint64))
        self.pairs = np.unique(np.array([_pair(a, b) for _, w in sequences for a, b in zip(w, w[1:], strict=False)], np.uint64))

    def find(self, starts: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, list[list], list[set]]:
        """Words of each document, hit spans (first, last) and items."""
        tokens = Tokens(data, starts, "alnum", lower=True)
        n_docs = len(starts) - 1
        spans, items = [[] for _ in range(n_docs)], [set() for _ in range(n_docs)]
        h = tokens.hashes
        if self.least and len(h):
            if self.least == 1:
                ok = member(h, self.words)
                inside = np.concatenate([ok, [False]])
                run = 1
            else:
                pair = (h[:-1] * np.uint64(3) + h[1:]) * np.uint64(0x9E3779B97F4A7C15)
                inside = np.zeros(len(h) + 1, bool)
                inside[: len(h) - 1] = (tokens.doc[1:] == tokens.doc[:-1]) & member(pair, self.pairs)
                run = self.least - 1
            edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8)])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a < run:
                    continue
                stop = b if self.least == 1 else b + 1
                at = a
                while at < stop:  # runs of single words may pass from one document to the next
                    doc = int(tokens.doc[at])
                    end = min(stop, int(tokens.first[doc + 1]))
                    base = int(tokens.first[doc])
                    for k, n, found in self.automaton.stream(h[at:end].tolist()):
                        last, first = at - base + k, at - base + k - n + 1
                        while spans[doc] and spans[doc][-1][1] >= first - 1:
                            first = min(first, spans[doc].pop()[0])
                        spans[doc].append((first, last))
                        items[doc] |= found
                    at = end
        return tokens.counts, spans, items


def _hashes(words: list[bytes]) -> list[int]:
    raw = np.frombuffer(b" ".join(words), np.uint8)
    return Tokens(raw, np.array([0, len(raw)])).hashes.tolist() if words else []


def _pair(a: int, b: int) -> int:
    return ((a * 3 + b) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


def _matchers(benchmark: DataFrame, window: int) -> list[Matcher]:
    rows = [("" if r[0] is None else str(r[0]), r[1]) for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()]
    slices, size = [[]], 0
    for name, text in rows:
        size += len(words_of(text))
        if size > MAX_ITEM_WORDS and slices[-1]:
            slices.append([])
            size = 0
        slices[-1].append((name, text))
    return [Matcher(x, window) for x in slices]


def _find(matchers: list[Matcher], texts: list[bytes]) -> Iterator[tuple[int, list, set]]:
    """(words, hit spans, items) of each text; some megabytes of text at a time."""
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + B.BLOCK_BYTES, side="right")) - 1)
        starts, data = ends[at : to + 1] - ends[at], np.frombuffer(b"".join(texts[at:to]), np.uint8)
        counts, spans, items = matchers[0].find(starts, data)
        for more in matchers[1:]:
            _, also, others = more.find(starts, data)
            for k in range(to - at):
                spans[k], items[k] = _merged(spans[k] + also[k]), items[k] | others[k]
        yield from zip(counts.tolist(), spans, items, strict=True)
        at = to


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, merged hit spans by word place, and the items found, of every document."""
    matchers = _matchers(benchmark, window)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(n, [{"first": a, "last": b} for a, b in spans], sorted(items)) for n, spans, items in _find(matchers, [t.encode("utf-8") for t in frame["text"]])]
            out = pd.DataFrame(rows, columns=["n_words", "hit_spans", "items"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    return B.plain(docs).mapInPandas(run, FOUND)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def report(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return B.with_null_ids(found).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what lies between them."""
    raw = text.encode("utf-8")
    tokens = Tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), "alnum", lower=True)
    out, at = [], 0
    for first, last in spans:
        out.append(raw[at : tokens.begin[first]])
        at = int(tokens.end[last])
    return b"".join([*out, raw[at:]]).decode("utf-8", "ignore")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """Documents without the benchmark's passages; those with a larger share of hit words than ``max_coverage`` go.

    All columns are kept; ``n_chars`` follows the text. The text of a clean document is untouched.
    """
    matchers = _matchers(benchmark, window)

    def change(texts: list[str | None]) -> tuple[list[bool], list[str | None]]:
        keep, out = [], []
        for text, (n, spans, _) in zip(texts, _find(matchers, [(t or "").encode("utf-8") for t in texts]), strict=True):
            hit = sum(b - a + 1 for a, b in spans)
            keep.append(hit <= max_coverage * n)
            out.append(cut_spans(text, spans) if hit and keep[-1] else text)
        return keep, out

    return B.rewrite(docs, change)


def op3_benchmark_decontamination(spark, sf_dir):
    return report(find_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
