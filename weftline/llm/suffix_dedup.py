"""Operator 5, suffix-array dedup over bytes.

Removed is every byte of a string of ``width`` bytes (a window) that also starts anywhere else, in any document.

1. Each window has an anchor: of the ``gram``-byte strings in it the one with the least hash, the leftmost of equals.
   Equal windows have equal anchors at the same offset. Neighbouring windows mostly share theirs, so there is one
   anchor in about thirty bytes. Anchors whose gram occurs once are dropped by a packed exchange between blocks.
2. For every other anchor, the windows that it serves make one stretch of text, its *context*. Contexts go to the part
   of their gram; equal ones are sent once by a block, with a mark for more than one.
3. A gram with contexts of ``HOT`` different digests or more does not gather them in one place. The offsets that the anchor can
   have in a window are cut in four ranges, those again, down to single offsets. All windows of a range have the bytes
   around the anchor in common that lie in every one of them; a second exchange counts these common strings and the
   different contexts around them. A range whose string occurs once holds no repeated window; one with fewer than
   ``HOT`` contexts is sent as a context of its own, to the part of its string; others are looked at by their own
   ranges. A single offset's string is the window itself, sent once by a block.
4. In a part, contexts are aligned at their grams. The text right of the gram's start, and the reversed text left of
   it, are cut in pieces of ``PIECE`` bytes from the alignment on; over the pieces' ranks one suffix array is built by
   linear grouping (``suffix_groups``). It puts both sides of all contexts in order; neighbours' common lengths in
   bytes follow. Two windows at offset o are equal exactly if their right sides agree in width - o bytes and their left
   sides in o bytes, that is, if they lie in one run of either order. Bytes are compared, never hashes alone.
5. Each block gets, for each context it sent, which of its windows occur elsewhere, and removes what they cover.

Defined results: null and empty texts keep sha256 of nothing; texts of fewer than ``width`` bytes keep all; matches
never cross documents; what is left need not be valid UTF-8; repeated rows remove each other's windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import blocks as B
from weftline.llm.hashing import member, mix, powers, prefix, window_hashes
from weftline.llm.suffix_groups import suffix_array
from weftline.session import checkpointed

WIDTH = 200
PIECE = 24
SLICE = 4000  # contexts in one suffix array, whole grams together
HOT = 128  # different digests of a byte, as some 180 different contexts have them
AT_ONCE = 1 << 17  # windows whose anchors are sought at once
PLACE = np.uint64((1 << 24) - 1)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def runs_of(data: np.ndarray, starts: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one anchor: first window, last window, anchor, and hash of the anchor's gram.

    The least is by the 40 high bits of the hash, so that it does not depend on where a window lies."""
    span = width - gram + 1  # grams in a window
    n = len(data) - width + 1
    found = []
    for lo in range(0, n, AT_ONCE):
        size = min(AT_ONCE, n - lo)
        hashes = window_hashes(data[lo : lo + size + width - 1].astype(np.uint64) + np.uint64(1), gram)
        least, reach = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64), 1
        while reach < span:
            step = min(reach, span - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        at = (least & PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        found.append((new + lo, at[new] + lo, mix(hashes[at[new]])))  # least hashes are small; mixed, they are even
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    first, anchor, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    cuts = np.unique(np.concatenate([first, starts[:-1][starts[:-1] < n]]))  # where the anchor or the document changes
    run = np.searchsorted(first, cuts, side="right") - 1
    doc = np.searchsorted(starts, cuts, side="right") - 1
    last = np.minimum(np.append(cuts[1:], n), starts[doc + 1] - width + 1) - 1
    new = (last >= cuts) & np.concatenate([[True], (anchor[run][1:] != anchor[run][:-1]) | (doc[1:] != doc[:-1])])
    # a slice of the text begins with a cut of its own: such a run goes on from the one before
    head = np.flatnonzero((last >= cuts) & ~new)
    last[head - 1] = last[head]
    run = run[new]
    return cuts[new], last[new], anchor[run], hashes[run]


def offset_ranges(span: int) -> list[tuple[int, int, int]]:
    """Ranges (first, last, parent) of the offsets below ``span``: four in each, down to single ones; parents first."""
    out, at = [(0, span - 1, -1)], 0
    while at < len(out):
        first, last, _ = out[at]
        cuts = [first + (last + 1 - first) * k // 4 for k in range(5)]
        out += [(a, b - 1, at) for a, b in zip(cuts, cuts[1:], strict=False) if a < b and last > first]
        at += 1
    return out


class Strings:
    """Hashes of the strings that all windows of a range of offsets have in common, and digests of contexts."""

    def __init__(self, data: np.ndarray, width: int):
        self.sums, self.down, self.width = prefix(data.astype(np.uint64) + np.uint64(1)), powers(len(data) + 1)[1], width

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def common(self, anchor: np.ndarray, first: int, last: int, number: int) -> np.ndarray:
        return mix(self._between(anchor - first, anchor - last + self.width) + np.uint64(number * 0xD1B54A32D192ED03 & (1 << 64) - 1))

    def digest(self, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A byte of a context of windows ``first`` to ``last``."""
        return mix(self._between(first, last + self.width) + (anchor - first).astype(np.uint64)) >> np.uint64(56)


def _units(data, runs, grams: np.ndarray, ranges: np.ndarray, width: int, gram: int, key):
    """Stretches of text to send: (key, first window, last window, anchor) as arrays. ``grams`` and ``ranges`` are what
    the exchanges gave: keys that occur more than once, even ones for those that many blocks hold."""
    first, last, anchor, hashes = runs
    flag = key(np.zeros(1, np.uint64))[0]
    keys = key(hashes)
    cold = np.flatnonzero(member(keys, grams))
    hot = np.flatnonzero(member(keys ^ flag, grams))
    found = [(hashes[cold], first[cold], last[cold], anchor[cold])]
    if len(hot):
        first, last, anchor = first[hot], last[hot], anchor[hot]
        strings, spread = Strings(data, width), offset_ranges(width - gram + 1)
        open_ = {0: np.arange(len(hot))}
        for number, (a, b, up) in enumerate(spread):
            if up < 0 or not len(open_.get(up, ())):
                continue
            own = open_[up]
            own = own[(anchor[own] - last[own] <= b) & (anchor[own] - first[own] >= a)]
            values = strings.common(anchor[own], a, b, number)
            seen = key(values)
            send = member(seen, ranges)
            open_[number] = own[member(seen ^ flag, ranges)]
            own, values = own[send], values[send]
            found.append((values, np.maximum(first[own], anchor[own] - b), np.minimum(last[own], anchor[own] - a), anchor[own]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _contexts(data, runs, grams, ranges, width, gram, key, parts):
    """Distinct contexts by part, in an order that depends on the block and the answers alone, and the runs that have
    each. A context is (key of its group, bytes left of the anchor, windows, text)."""
    raw = data.tobytes()
    found: dict[tuple, list[int]] = {}
    for h, a, b, p in zip(*(x.tolist() for x in _units(data, runs, grams, ranges, width, gram, key)), strict=True):
        found.setdefault((h, p - a, b - a + 1, raw[a : b + width]), []).append(a)
    step = -(-(1 << 64) // parts)
    by_part: dict[int, list] = {}
    for context, starts in sorted(found.items()):
        by_part.setdefault(context[0] // step, []).append((context, starts))
    return by_part


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common start of each row with the one before; 0 for the first. Zeros pad the rows."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[1:] = np.minimum(out[1:], np.minimum(sizes[1:], sizes[:-1]))
    return out


def _pieces(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of each row as sortable keys (three words and the piece's length), and how many each row has."""
    n, width = rows.shape
    count = -(-width // PIECE)
    padded = np.zeros((n, count * PIECE), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64).reshape(n, count, PIECE // 8)
    lengths = np.clip(sizes[:, None] - np.arange(count) * PIECE, 0, PIECE).astype(np.uint64)
    return np.concatenate([words, lengths[:, :, None]], 2), -(-sizes // PIECE)


def order_both(right: np.ndarray, right_sizes: np.ndarray, left: np.ndarray, left_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the right sides and of the left sides, from one suffix array over the ranks of their pieces."""
    pieces, used = zip(_pieces(right, right_sizes), _pieces(left, left_sizes), strict=True)
    flat = np.concatenate([p[np.arange(p.shape[1])[None, :] < u[:, None]] for p, u in zip(pieces, used, strict=True)])
    order = np.lexsort(flat.T[::-1])
    rank = np.empty(len(flat), np.int64)
    rank[order] = np.cumsum(np.concatenate([[1], (flat[order][1:] != flat[order][:-1]).any(1)])) if len(flat) else []
    used = np.concatenate(used)
    ends = np.cumsum(used + 1)  # every side is followed by a 0
    text = np.zeros(int(ends[-1]), np.int64)
    mask = np.ones(len(text), bool)
    mask[ends - 1] = False
    text[mask] = rank
    begins = ends - used - 1
    owner = np.full(len(text), -1, np.int64)
    owner[begins] = np.arange(len(used))
    found = owner[suffix_array(text)]
    found = found[found >= 0]
    return found[found < len(right)], found[found >= len(right)] - len(right)


def repeated_windows(contexts: list[tuple], many: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For each of the distinct contexts and each offset of the anchor in a window, whether that window occurs
    elsewhere; ``many`` marks contexts that occur more than once."""
    span = width - gram + 1
    n = len(contexts)
    lefts = np.array([c[1] for c in contexts])
    counts = np.array([c[2] for c in contexts])
    offsets = np.arange(span)
    valid = (offsets[None, :] <= lefts[:, None]) & (offsets[None, :] > (lefts - counts)[:, None])
    out = valid & many[:, None]
    grams = np.array([c[0] for c in contexts], np.uint64)
    order = np.argsort(grams, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], grams[order][1:] != grams[order][:-1], [True]]))
    at = 0
    while at + 1 < len(cuts):  # whole grams, some thousand contexts at a time, one gram at least
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + SLICE, side="right")) - 1)
        sizes = np.diff(cuts[at : to + 1])
        # a gram with one context has nothing to compare
        some = order[cuts[at] : cuts[to]][np.repeat(sizes > 1, sizes)]
        if len(some):
            _compare(contexts, some, valid, out, width, span)
        at = to
    return out


def _compare(contexts: list[tuple], some: np.ndarray, valid: np.ndarray, out: np.ndarray, width: int, span: int) -> None:
    """Mark in ``out`` the windows of some contexts that other ones of them have, too."""
    right, left = np.zeros((len(some), width), np.uint8), np.zeros((len(some), span), np.uint8)
    right_sizes, left_sizes = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
    for k, i in enumerate(some.tolist()):
        _, p, _, text = contexts[i]
        raw = np.frombuffer(text, np.uint8)
        right_sizes[k], left_sizes[k] = len(raw) - p, p
        right[k, : len(raw) - p] = raw[p:]
        left[k, :p] = raw[:p][::-1]
    by_right, by_left = order_both(right, right_sizes, left, left_sizes)
    common_right = _common(right[by_right], right_sizes[by_right])
    common_left = _common(left[by_left], left_sizes[by_left])
    right_run, left_run = np.empty(len(some), np.int64), np.empty(len(some), np.int64)
    for o in range(span):
        right_run[by_right] = np.cumsum(common_right < width - o)
        left_run[by_left] = np.cumsum(common_left < o)
        own = np.flatnonzero(valid[some, o])
        if len(own) > 1:
            _, at, times = np.unique(right_run[own] * (len(some) + 1) + left_run[own], return_inverse=True, return_counts=True)
            out[some[own], o] |= times[at] > 1


def remove_repeated(docs: DataFrame, width: int = WIDTH, gram: int = 100, keep_bytes: bool = True, block_bytes: int = B.BLOCK_BYTES // 2, hot: int = HOT) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes that stay."""
    if not 8 <= gram < width or hot < 2:
        raise ValueError("gram must be from 8 bytes to under width, hot 2 or more")
    blocks = B.pack(docs, block_bytes)
    size = B.total_bytes(blocks)
    parts, wide = B.part_count(size), min(7, B.key_bytes(size))
    flag = np.uint64(1 << (64 - 8 * wide))
    key = lambda h: (h // flag | np.uint64(1)) * flag
    span = width - gram + 1
    mask_bytes = -(-span // 8)

    def pack_keys(block, keys, digests):
        found, counts = np.unique(keys | digests << np.uint64(56 - 8 * wide), return_counts=True)
        found = found ^ ((counts > 1).astype(np.uint64) * flag)  # an even key: more than once in this block
        order, cuts = B.split_by_part(found, parts)
        for p in np.flatnonzero(np.diff(cuts)):
            yield int(p), block, B.planes(found[order[cuts[p] : cuts[p + 1]]], wide + 1)

    def send_grams(block, payload):
        _, starts, data = B.unpack(payload)
        first, last, anchor, hashes = runs_of(data, starts, width, gram)
        yield from pack_keys(block, key(hashes), Strings(data, width).digest(anchor, first, last))

    def send_ranges(block, payload, answers):
        if not answers:
            return
        grams = sorted_keys(answers)
        _, starts, data = B.unpack(payload)
        first, last, anchor, hashes = runs_of(data, starts, width, gram)
        own = np.flatnonzero(member(key(hashes) ^ flag, grams))
        first, last, anchor = first[own], last[own], anchor[own]
        strings, keys, digests = Strings(data, width), [], []
        for number, (a, b, up) in enumerate(offset_ranges(span)):
            if up >= 0:
                own = np.flatnonzero((anchor - last <= b) & (anchor - first >= a))
                keys.append(key(strings.common(anchor[own], a, b, number)))
                digests.append(strings.digest(anchor[own], np.maximum(first[own], anchor[own] - b), np.minimum(last[own], anchor[own] - a)))
        yield from pack_keys(block, np.concatenate(keys), np.concatenate(digests))

    def shared_keys(part, froms, payloads):
        values = np.concatenate([B.from_planes(x, wide + 1) for x in payloads])
        keys = values & ~(flag - np.uint64(1)) | flag
        found, at, held = np.unique(keys, return_inverse=True, return_counts=True)
        shared = held > 1
        shared[at[(values & flag) == 0]] = True
        different = np.unique(values | flag) & ~(flag - np.uint64(1))
        many = np.diff(np.append(np.searchsorted(different, found), len(different))) >= hot
        first = 0
        for block, raw in zip(froms, payloads, strict=True):
            own = at[first : first + len(raw) // (wide + 1)]
            first += len(raw) // (wide + 1)
            own = np.unique(own[shared[own]])
            for is_hot in (False, True):
                some = found[own[many[own] == is_hot]]
                if len(some):
                    yield block, is_hot, B.planes(some ^ flag if is_hot else some, wide)

    def sorted_keys(answers):
        return np.sort(np.concatenate([np.zeros(0, np.uint64), *(B.from_planes(x, wide) for x in answers)]))

    def of_kind(answers, kind):
        return [x[1:] for x in answers if x[:1] == kind]

    def send_contexts(block, payload, answers):
        if not answers:
            return
        _, starts, data = B.unpack(payload)
        runs = runs_of(data, starts, width, gram)
        for part, found in _contexts(data, runs, sorted_keys(of_kind(answers, b"g")), sorted_keys(of_kind(answers, b"r")), width, gram, key, parts).items():
            head = np.array([(c[0], c[1], c[2], len(c[3]), len(starts) > 1) for c, starts in found], np.uint64)
            raw = b"".join(c[3] for c, _ in found)
            yield part, block, np.int64(len(found)).tobytes() + head.T.tobytes() + B.press(raw)

    def compare(part, froms, payloads):
        known: dict[tuple, int] = {}
        many, sent = [], []
        for raw in payloads:
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            head = np.frombuffer(raw, np.uint64, 5 * n, 8).reshape(5, n).tolist()
            text = B.unpress(raw[8 + 40 * n :])
            own, at = [], 0
            for h, p, count, length, more in zip(*head, strict=True):
                context = (h, p, count, text[at : at + length])
                at += length
                k = known.setdefault(context, len(many))
                if k == len(many):
                    many.append(bool(more))
                else:
                    many[k] = True
                own.append(k)
            sent.append(own)
        masks = np.packbits(repeated_windows(list(known), np.array(many), width, gram), axis=1)
        for block, own in zip(froms, sent, strict=True):
            yield block, np.int64(part).tobytes() + masks[own].tobytes()

    def cover(block, payload, answers):
        ids, starts, data = B.unpack(payload)
        depth = np.zeros(len(data) + 1, np.int32)
        masks = {int(np.frombuffer(x, np.int64, 1)[0]): np.frombuffer(x, np.uint8, offset=8).reshape(-1, mask_bytes) for x in of_kind(answers, b"m")}
        if masks:
            runs = runs_of(data, starts, width, gram)
            for part, found in _contexts(data, runs, sorted_keys(of_kind(answers, b"g")), sorted_keys(of_kind(answers, b"r")), width, gram, key, parts).items():
                repeated = np.unpackbits(masks[part], axis=1)[:, :span].astype(bool)
                for ((_, p, _, _), firsts), row in zip(found, repeated, strict=True):
                    at = p - np.flatnonzero(row)
                    for a in firsts:
                        depth[a + at] += 1
                        depth[a + at + width] -= 1
        keep = np.cumsum(depth[:-1]) == 0
        edges = keep.copy()  # a removed byte whose predecessor stays, or that starts a document
        edges[1:] = ~keep[1:] & keep[:-1]
        edges[:1] = ~keep[:1]
        inside = starts[:-1][starts[:-1] < len(data)]
        edges[inside] = ~keep[inside]
        kept_before = np.concatenate([[0], np.cumsum(keep)])
        spans_before = np.concatenate([[0], np.cumsum(edges)])
        raw = data[keep].tobytes()
        for k, doc_id in enumerate(ids.tolist()):
            a, b = starts[k], starts[k + 1]
            text = raw[kept_before[a] : kept_before[b]]
            yield doc_id, int(b - a), int(b - a - len(text)), int(spans_before[b] - spans_before[a]), hashlib.sha256(text).hexdigest(), text if keep_bytes else None

    kind = lambda answers, name: answers.select("block", F.concat(F.lit(name), "payload").alias("payload"))
    given = "block long, hot boolean, payload binary"
    grams = checkpointed(B.each_part(B.each_block(blocks, send_grams, B.SENT_SCHEMA), shared_keys, given))
    hot_grams = grams.where("hot")
    ranges = B.each_part(B.each_answered(blocks, hot_grams, send_ranges, B.SENT_SCHEMA), shared_keys, given)
    both = checkpointed(kind(grams, b"g").unionByName(kind(ranges, b"r")))
    masks = B.each_part(B.each_answered(blocks, both, send_contexts, B.SENT_SCHEMA), compare)
    both = both.unionByName(kind(masks, b"m"))
    out = B.with_null_ids(B.each_answered(blocks, both, cover, RESULT))
    return out if keep_bytes else out.drop("kept")


def op5_suffix_array_dedup(spark, sf_dir):
    return remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_bytes=False)
