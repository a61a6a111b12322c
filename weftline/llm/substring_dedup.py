"""Operator 1, substring dedup: difference-cover anchors.

Words are maximal runs of non-white-space bytes; a window is ``window`` consecutive words of one document. A word is
removed when a window over it also starts in a document with a smaller id. Only anchors are compared at first: the
hashes of short windows at the places of each document whose index modulo a period lies in a difference cover. For
period 7 the cover {0, 1, 3} holds every difference, so any two equal windows of 13 words have an anchor of
13 - 7 + 1 = 7 words at the same offset in both. Anchors that occur only once are dropped; from the others the match
is extended to the whole windows around them, and the smallest document of every such window is found. Anchors filter
by hashes of 40 bits or more; windows are equal by 96 bits of two hashes, so that one false match is expected once in
about 2**97 / n**2 corpora of n windows (n = 5e12, some 100 TB: 1 in 6,000).

Defined results: a null or empty text has no words and keeps sha256 of nothing; a text of fewer words than a window
keeps them all; rows with equal ids never remove each other's words; a null id is larger than any other.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame

from weftline.llm import blocks as B
from weftline.llm.hashing import Tokens, member

PERIOD, COVER = 7, (0, 1, 3)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _anchors(tokens: Tokens, window: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, whole = tokens.windows(window - PERIOD + 1)
    at = whole & np.isin(tokens.local() % PERIOD, COVER) & (tokens.counts >= window)[tokens.doc]
    return hashes, at


def _first_seen(hashes: np.ndarray, more: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the smallest id of each, and the place of each key given among them."""
    order = np.lexsort((ids, more, hashes))
    hashes, more, ids = hashes[order], more[order], ids[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1])
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return hashes[new], more[new], ids[new], at


def _among(hashes: np.ndarray, more: np.ndarray, given: list[bytes]) -> np.ndarray:
    """Whether each key is among those that parts gave: hashes, then the other halves."""
    sizes = [len(x) // 12 for x in given]
    theirs = np.concatenate([np.zeros(0, np.uint64), *(B.from_planes(x[: 8 * n]) for x, n in zip(given, sizes, strict=True))])
    halves = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(given, sizes, strict=True))])
    order = np.lexsort((halves, theirs))
    theirs, halves = theirs[order], halves[order]
    lo, hi = np.searchsorted(theirs, hashes), np.searchsorted(theirs, hashes, side="right")
    out = np.zeros(len(hashes), bool)
    some = np.flatnonzero(hi > lo)
    out[some] = halves[lo[some]] == more[some]
    for k in some[hi[some] - lo[some] > 1].tolist():
        out[k] = (halves[lo[k] : hi[k]] == more[k]).any()
    return out


def remove_repeats(docs: DataFrame, window: int = 13, keep_text: bool = True, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text."""
    if window <= PERIOD:
        raise ValueError(f"window must be over {PERIOD} words")
    blocks = B.pack(docs, block_bytes)
    size = B.total_bytes(blocks)
    parts, width = B.part_count(size), B.key_bytes(size)
    flag = np.uint64(1 << (64 - 8 * width))  # the lowest bit that is sent

    def send_anchors(block, payload):
        ids, starts, data = B.unpack(payload)
        hashes, at = _anchors(Tokens(data, starts), window)
        found, counts = np.unique(hashes[at] // flag | np.uint64(1), return_counts=True)
        found = (found ^ (counts > 1).astype(np.uint64)) * flag  # an even value: more than once in this block
        order, cuts = B.split_by_part(found, parts)
        for p in np.flatnonzero(np.diff(cuts)):
            yield int(p), block, B.planes(found[order[cuts[p] : cuts[p + 1]]], width)

    def shared_anchors(part, froms, payloads):
        sizes = [len(x) // width for x in payloads]
        values = np.concatenate([B.from_planes(x, width) for x in payloads])
        keys = values | flag
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        same = np.zeros(len(ordered), bool)
        same[1:] = ordered[1:] == ordered[:-1]
        same[:-1] |= same[1:]
        shared = np.zeros(len(values), bool)
        shared[order] = same
        shared |= (values & flag) == 0
        for block, end, n in zip(froms, np.cumsum(sizes), sizes, strict=True):
            own = keys[end - n : end][shared[end - n : end]]
            if len(own):
                yield block, B.planes(own, width)

    def send_windows(block, payload, answers):
        if not answers:
            return
        ids, starts, data = B.unpack(payload)
        tokens = Tokens(data, starts)
        hashes, at = _anchors(tokens, window)
        shared = np.sort(np.concatenate([B.from_planes(x, width) for x in answers]))
        hit = np.flatnonzero(at)
        hit = hit[member((hashes[hit] // flag | np.uint64(1)) * flag, shared)]
        full, whole = tokens.windows(window)
        near = np.zeros(len(full) + PERIOD, np.int32)  # windows that hold a shared anchor; shifted by PERIOD - 1
        near[hit] += 1
        near[hit + PERIOD] -= 1
        some = np.flatnonzero((np.cumsum(near)[PERIOD - 1 : PERIOD - 1 + len(full)] > 0) & whole)
        found, more, least, _ = _first_seen(full[some], tokens.more_bits(window)[some], ids[tokens.doc[some]])
        order, cuts = B.split_by_part(found, parts)
        for p in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[p] : cuts[p + 1]]
            yield int(p), block, B.planes(found[own]) + more[own].tobytes() + B.planes(least[own].view(np.uint64))

    def first_documents(part, froms, payloads):
        sizes = np.array([len(x) // 20 for x in payloads])
        hashes = np.concatenate([B.from_planes(x[: 8 * n]) for x, n in zip(payloads, sizes, strict=True)])
        more = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(payloads, sizes, strict=True)])
        ids = np.concatenate([B.from_planes(x[12 * n :]) for x, n in zip(payloads, sizes, strict=True)]).view(np.int64)
        _, _, least, at = _first_seen(hashes, more, ids)
        earlier = least[at] < ids
        ends = np.cumsum(sizes)
        for block, end, n in zip(froms, ends, sizes, strict=True):
            mask = earlier[end - n : end]
            if mask.any():
                yield block, B.planes(hashes[end - n : end][mask]) + more[end - n : end][mask].tobytes()

    def cover(block, payload, answers):
        ids, starts, data = B.unpack(payload)
        tokens = Tokens(data, starts)
        full, whole = tokens.windows(window)
        at = np.flatnonzero(whole)
        found, more, least, place = _first_seen(full[at], tokens.more_bits(window)[at], ids[tokens.doc[at]])
        elsewhere = _among(found, more, answers)[place]
        gone = at[elsewhere | (least[place] < ids[tokens.doc[at]])]
        depth = np.zeros(len(full) + window + 1, np.int32)
        depth[gone] += 1
        depth[gone + window] -= 1
        keep = np.cumsum(depth[: len(full)]) == 0
        raw = data.tobytes()
        for k, doc_id in enumerate(ids.tolist()):
            a, b = tokens.first[k], tokens.first[k + 1]
            words = raw[starts[k] : starts[k + 1]].split()
            mask = keep[a:b]
            removed = int(b - a - mask.sum())
            text = b" ".join(compress(words, mask.tolist()) if removed else words)
            yield None if doc_id == B.NO_ID else doc_id, int(b - a), removed, hashlib.sha256(text).hexdigest(), text.decode() if keep_text else None

    shared = B.each_part(B.each_block(blocks, send_anchors, B.SENT_SCHEMA), shared_anchors)
    sent = B.each_answered(blocks, shared, send_windows, B.SENT_SCHEMA)
    out = B.each_answered(blocks, B.each_part(sent, first_documents), cover, RESULT)
    return out if keep_text else out.drop("kept")


def op1_substring_dedup(spark, sf_dir):
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
