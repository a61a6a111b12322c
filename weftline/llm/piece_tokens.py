"""Operator 4, SentencePiece encoding and decoding with the tokenizers library.

The model file's protobuf is parsed here: pieces with scores and types, the normaliser's options and character map, byte
fallback. From these a ``tokenizers`` model is rebuilt: for a BPE model, merges are all splits of a piece in two pieces,
ordered by the piece's score; for a unigram model, the scores themselves. Text goes through the character map, white
space becomes the metaspace marker, with a dummy prefix where the model asks for it; the user's own pieces are cut out
first and never merged; characters without a piece fall back to bytes. Decoding puts the pieces' bytes in a row.

No piece holds a marker after another character (checked when the model is read), so merges never cross the start of
a marker run, and a text's tokens are those of its units: a run of markers and what follows up to the next one. A BPE
model with all bytes is cut finer, wherever none of its pieces holds the two characters at the cut: before signs and
digits that follow a letter, and around line ends. Each batch's new units are encoded at once, many of them in one text
with line ends between, on the task's own thread, and kept in a cache that is bounded in units and characters and lives as
long as its worker; when it is full, the units that were met again stay. A text is put together from its units. Models
for which the check fails encode whole texts. In runs of several markers merges tie in score; these are merged here, the leftmost first as
SentencePiece does. Models with unused pieces, and kinds other than BPE and unigram, are refused.

Defined results: null and empty texts have no tokens; rows with equal ids or texts are kept, each with the same result;
texts of any length are encoded whole, a longer one than ``BATCH_CHARS`` in a batch of its own; decoding gives the
normalised text back, except that a marker character in the text itself comes back as a space.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer, models, normalizers

from weftline.llm import blocks as B

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CACHE_UNITS, CACHE_CHARS = 250_000, 8_000_000
LEARN_UNITS = 4_000  # encoded at once: the library keeps about a kilobyte for each
LINE_UNITS = 64  # of these in one text, where line ends stand alone
BATCH_CHARS = 2_000_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        field, kind = key >> 3, key & 7
        if kind == 0:
            yield field, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield field, raw[at : at + size]
        at += size


class PieceModel:
    """Pieces and options of a SentencePiece model file."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer: dict = {}
        normaliser: dict = {}
        for field, value in _fields(raw):
            if field == 1:
                part = dict(_fields(value))
                self.pieces.append(part[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", part.get(2, b"\0\0\0\0"))[0])
                self.types.append(part.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or UNUSED in self.types:
            raise ValueError("only BPE and unigram models without unused pieces are supported")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.collapse = bool(normaliser.get(4, 1))
        charsmap = normaliser.get(2, b"")
        self.charsmap = normalizers.Precompiled(charsmap) if charsmap else None
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        self.unknown = self.types.index(UNKNOWN)
        self.user = {p: i for p, i in self.ids.items() if self.types[i] == USER}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.user, key=len, reverse=True))) + ")").split if self.user else None
        self.usable = {p: i for p, i in self.ids.items() if self.types[i] == NORMAL}
        self.by_unit = not any(MARK in p.lstrip(MARK) for p in self.usable)
        self.line_end = self._line_end()
        self.unit = re.compile(self._units()).findall

    def _line_end(self) -> int | None:
        """The piece of a line end, if it stands alone in every text: no other piece holds one, and it is one byte."""
        whole = self.kind == BPE and self.by_unit and self.byte_fallback and all(f"<0x{b:02X}>" in self.ids for b in range(256))
        return self.ids["<0x0A>"] if whole and not any("\n" in p for p in self.usable) else None

    def _units(self) -> str:
        """Pattern of units. Where line ends stand alone, so do runs of signs after a letter, as far as no piece holds both;
        unknown characters become their bytes one by one, so a cut beside them changes nothing."""
        if self.line_end is None:
            return f"{MARK}*[^{MARK}]+|{MARK}+"
        inner = {p[i : i + 2] for p in self.usable for i in range(len(p) - 1)}
        signs = {c for c in {*map(chr, range(128)), *chain.from_iterable(inner)} if not c.isalpha() and c not in (MARK, "\n")}
        while held := {b for a, b in inner if b in signs and a not in signs and a != MARK}:
            signs -= held
        some = "".join(map(re.escape, sorted(signs)))
        return f"\n|{MARK}*[{some}]*[^{MARK}{some}\n]+|{MARK}*[{some}]+|{MARK}+" if some else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+"

    def tokenizer(self) -> Tokenizer:
        if self.kind == BPE:
            merges = []
            for piece, i in self.usable.items():
                for cut in range(1, len(piece)):
                    if piece[:cut] in self.usable and piece[cut:] in self.usable:
                        merges.append((-self.scores[i], i, cut, piece[:cut], piece[cut:]))
            merges.sort(key=lambda m: (m[0], m[1], self.usable[m[3]], self.usable[m[4]]))
            return Tokenizer(models.BPE(vocab=self.ids, merges=[(a, b) for *_, a, b in merges], unk_token=self.pieces[self.unknown], byte_fallback=self.byte_fallback, fuse_unk=True))
        # pieces that no text may match get names that no text holds, and a score that leaves the least one as it is
        top = max(self.scores[i] for i in self.usable.values())
        rows = [(p, s) if self.types[i] == NORMAL else (f"\U0010ffff{i}", top) for i, (p, s) in enumerate(zip(self.pieces, self.scores, strict=True))]
        return Tokenizer(models.Unigram(rows, self.unknown, False))

    def _mapped(self, text: str) -> str:
        if not self.charsmap:
            return text
        if not self.cut:
            return self.charsmap.normalize_str(text)
        return "".join(t if k % 2 else self.charsmap.normalize_str(t) for k, t in enumerate(self.cut(text)))

    def normalise(self, text: str) -> str:
        text = self._mapped(text)
        if self.collapse:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = text.replace(" ", MARK)
        return MARK + text if self.dummy_prefix else text


class Codec:
    """Encoder and decoder of batches. Units that were seen have a slot; a slot's ids are a stretch of one array."""

    def __init__(self, raw: bytes):
        self.model = m = PieceModel(raw)
        self.backend = m.tokenizer()
        self.unit = m.unit
        plain = [(b"" if t == CONTROL else " \u2047 ".encode() if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode("utf-8")) for p, t in zip(m.pieces, m.types, strict=True)]
        self.piece_ends = np.concatenate([[0], np.cumsum([len(x) for x in plain])]).astype(np.int64)
        self.piece_bytes = np.frombuffer(b"".join(plain), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.ends, self.chars = array("i"), array("q", [0]), 0
        for u, k in self.model.user.items():
            self.slots[u] = len(self.flat)
            self.flat.append(k)
            self.ends.append(len(self.flat))
        if self.model.line_end is not None and "\n" not in self.slots:
            self.slots["\n"] = len(self.flat)
            self.flat.append(self.model.line_end)
            self.ends.append(len(self.flat))
        self.fixed, self.met = len(self.slots), np.zeros(0, np.int64)

    def _tidy(self) -> None:
        """Keep the units that were met again since the last time, or none if these are too many."""
        units, met = list(self.slots), self.met
        flat, ends = np.array(self.flat, np.int32), np.array(self.ends, np.int64)
        self._forget()
        again = np.flatnonzero(met > 1)
        again = again[again >= self.fixed]
        kept = [units[k] for k in again.tolist()]
        if 2 * len(kept) <= CACHE_UNITS and 2 * sum(map(len, kept)) <= CACHE_CHARS:
            self._add(kept, _stretches(flat, ends[again], ends[again + 1]), np.cumsum(ends[again + 1] - ends[again]))

    def _add(self, units: list[str], flat: np.ndarray, ends: np.ndarray) -> None:
        first, base = len(self.slots), len(self.flat)
        self.slots.update(zip(units, range(first, first + len(units)), strict=True))
        self.flat.frombytes(flat.astype(np.int32).tobytes())
        self.ends.frombytes((ends + base).astype(np.int64).tobytes())
        self.chars += sum(map(len, units))

    def _fallback(self, text: str) -> list[int]:
        m = self.model
        return [m.ids[f"<0x{b:02X}>"] for b in text.encode("utf-8")] if m.byte_fallback else [m.unknown]

    def _merged(self, unit: str) -> list[int]:
        """SentencePiece's own rule for BPE: the best score first, among equals the leftmost."""
        usable, scores = self.model.usable, self.model.scores
        parts, left, right = list(unit), list(range(-1, len(unit) - 1)), list(range(1, len(unit) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            both = parts[i] + parts[j]
            if (k := usable.get(both)) is not None:
                heappush(heap, (-scores[k], i, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, both = heappop(heap)
            j = right[i]
            if j >= len(parts) or not parts[i] or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], right[i] = both, "", right[j]
            if right[i] < len(parts):
                left[right[i]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        out: list[int] = []
        for p in filter(None, parts):
            k = usable.get(p)
            found = [k] if k is not None else self._fallback(p)
            if not (found == out[-1:] == [self.model.unknown]):
                out += found
        return out

    def _encoded(self, units: list[str]) -> list[list[int]]:
        """Ids of units, all threads of the library at work. Runs of several markers are merged here: in them equal
        scores meet, which the library settles in another order."""
        if self.model.kind == BPE:
            ids = [e.ids for e in self.backend.encode_batch_fast(units, add_special_tokens=False)]
            for k, u in enumerate(units):
                if MARK * 2 in u:
                    ids[k] = self._merged(u)
            return ids
        out = []
        for u, e in zip(units, self.backend.encode_batch(units, add_special_tokens=False), strict=True):
            ids = e.ids
            if self.model.unknown in ids:
                ids = list(chain.from_iterable(self._fallback(u[a:b]) if k == self.model.unknown else [k] for k, (a, b) in zip(ids, e.offsets, strict=True)))
            out.append(ids)
        return out

    def _learn(self, units: list[str]) -> None:
        if (line_end := self.model.line_end) is not None:
            plain = [u for u in units if MARK * 2 not in u]
            units = [u for u in units if MARK * 2 in u]
            for k in range(0, len(plain), LEARN_UNITS):
                some = plain[k : k + LEARN_UNITS]
                lines = ["\n".join(some[i : i + LINE_UNITS]) + "\n" for i in range(0, len(some), LINE_UNITS)]
                flat = np.concatenate([np.array(e.ids, np.int32) for e in self.backend.encode_batch_fast(lines, add_special_tokens=False)])
                stops = np.flatnonzero(flat == line_end)
                self._add(some, flat[flat != line_end], stops - np.arange(len(some)))
        for k in range(0, len(units), LEARN_UNITS):
            some = units[k : k + LEARN_UNITS]
            found = self._encoded(some)
            self._add(some, np.fromiter(chain.from_iterable(found), np.int32), np.cumsum([len(ids) for ids in found]))

    def _split(self, text: str) -> list[str]:
        text = self.model.normalise(text)
        if not self.model.cut:
            return self.unit(text) if self.model.by_unit else [text] if text else []
        out: list[str] = []
        for k, part in enumerate(self.model.cut(text)):
            out += [part] if k % 2 else self.unit(part) if self.model.by_unit else [part] if part else []
        return out

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
        """Ids of each text, and each text as decoded from them, in UTF-8."""
        ids, decoded, at = [], [], 0
        while at < len(texts):  # some megabytes of text at a time, one text at least
            parts, to, size = [], at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < BATCH_CHARS):
                size += len(texts[to])
                parts.append(self._split(texts[to]))
                to += 1
            if len(self.slots) > CACHE_UNITS or self.chars > CACHE_CHARS:
                self._tidy()
            new = set().union(*parts).difference(self.slots)
            if new:
                self._learn(list(new))
            slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
            met = np.bincount(slots, minlength=len(self.slots))
            met[: len(self.met)] += self.met
            self.met = met
            ends = np.frombuffer(self.ends, np.int64)
            flat = _stretches(np.frombuffer(self.flat, np.int32) if len(self.flat) else np.zeros(0, np.int32), ends[slots], ends[slots + 1])
            cuts = np.cumsum((ends[slots + 1] - ends[slots]))
            del ends
            bounds = np.concatenate([[0], cuts])[np.concatenate([[0], np.cumsum([len(p) for p in parts])])]
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                ids.append(flat[a:b])
                decoded.append(self._plain(flat[a:b]))
            at = to
        return ids, decoded

    def _plain(self, ids: np.ndarray) -> bytes:
        text = _stretches(self.piece_bytes, self.piece_ends[ids], self.piece_ends[ids + 1]).tobytes()
        return text[1:] if self.model.dummy_prefix and text.startswith(b" ") else text

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of any ids, not only of those that ``encode`` gave; bytes that are no UTF-8 come back as U+FFFD."""
        return ["".join(chr(c) if c < 0xDC80 or c > 0xDCFF else "\ufffd" for c in map(ord, self._plain(np.asarray(x, np.int64)).decode("utf-8", "surrogateescape"))) for x in ids]


def _stretches(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The values of some stretches, one after another."""
    sizes = end - begin
    total = int(sizes.sum())
    if not total:
        return values[:0]
    return values[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)]


_codecs: dict[str, Codec] = {}


def _codec(name: str) -> Codec:
    if name not in _codecs:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of the library cost more than they bring
        with open(SparkFiles.get(name), "rb") as f:
            _codecs[name] = Codec(f.read())
    return _codecs[name]


def encode(docs: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256 and whether decoding gave the text."""
    spark: SparkSession = docs.sparkSession
    spark.sparkContext.addFile(model_file)  # every executor gets its own copy
    name = os.path.basename(model_file)
    schema = "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for whole in batches:
            for batch in (whole.slice(k, 250) for k in range(0, len(whole), 250)):
                texts = batch.column(1).to_pylist()
                ids, decoded = codec.encode(texts)
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
                digests = [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]
                back = [hashlib.sha256(t).hexdigest() for t in decoded]
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes), pa.array(digests, pa.string()), pa.array(back, pa.string()), pa.array([a.encode("utf-8") == b for a, b in zip(texts, decoded, strict=True)], pa.bool_())], schema=arrow)
        B.give_back()

    return B.with_null_ids(B.plain(docs).mapInArrow(run, schema))


def op4_sentencepiece(spark, sf_dir):
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
