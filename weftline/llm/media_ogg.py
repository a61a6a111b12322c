"""Operator 9, media columns: Ogg.

Texts are stored as 8-bit samples in an Ogg file of two logical streams and read back. Writing: the payload is cut in
packets of 192 samples; packets alternate between two streams, each with a head packet, so that reading has to
demultiplex. Packets are laced into pages of at most 255 segments; a page carries the granule position (samples of its
stream finished so far), serial, sequence number and checksum. Reading: find each page by its capture pattern, verify
the checksum and the sequence, reassemble packets from the lacing values (a value of 255 continues, also over pages),
put the packets of each stream together, derive timestamps from granule positions, and interleave the streams again.

The page checksum is CRC-32 with polynomial 0x04C11DB7, not reflected, start and final value 0. It is computed by
``zlib.crc32`` (the same polynomial, reflected) over bytes with reversed bits.

Defined results: a null or empty text is a payload of 192 spaces; a damaged file raises ``ValueError`` in ``demux`` and
gives the feature ``damaged`` in ``inspect``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from weftline.llm import blocks as B

UNIT = 192
RATE = 8000
HEAD = b"\x80samples8"
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def page_checksum(page: bytes) -> int:
    value = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{value:032b}"[::-1], 2)


def _page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    page = head + body
    return page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


def _stream_pages(serial: int, packets: list[bytes]) -> list[bytes]:
    """The head packet has a page of its own. Packets of UNIT bytes have one lacing value each, 255 to a page."""
    head = HEAD + struct.pack("<IB", RATE, serial)
    pages, done = [_page(serial, 0, 2, 0, bytes([len(head)]), head)], 0
    for at in range(0, len(packets), 255):
        part = packets[at : at + 255]
        done += sum(map(len, part))
        last = at + 255 >= len(packets)
        pages.append(_page(serial, len(pages), 4 if last else 0, done, bytes(map(len, part)), b"".join(part)))
    return pages


def store(payload: bytes) -> bytes:
    """An Ogg file of the payload, whose length is a multiple of UNIT."""
    packets = [payload[i : i + UNIT] for i in range(0, len(payload), UNIT)]
    one, two = _stream_pages(1, packets[::2]), _stream_pages(2, packets[1::2])
    out = [one[0], two[0]]
    for i in range(1, max(len(one), len(two))):
        out += one[i : i + 1] + two[i : i + 1]
    return b"".join(out)


def pages(media: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """serial, sequence, flags, granule, lacing values and body of each page, all checked."""
    at, view = 0, memoryview(media)
    while at < len(media):
        if media[at : at + 4] != b"OggS" or len(media) < at + 27:
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, checksum, n = struct.unpack_from("<4sBBqIIIB", media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(media):
            raise ValueError(f"broken page at byte {at}")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != checksum:
            raise ValueError(f"wrong checksum at byte {at}")
        yield serial, sequence, flags, granule, lacing, view[at + 27 + n : end]
        at = end


def demux(media: bytes) -> dict[int, list[tuple[bytes, float]]]:
    """Of each logical stream, its packets and the time in seconds at which the packet's page ends."""
    streams: dict[int, list] = {}
    open_: dict[int, bytes] = {}
    expected: dict[int, int] = {}
    for serial, sequence, flags, granule, lacing, body in pages(media):
        if sequence != expected.get(serial, 0) or (serial not in expected) != bool(flags & 2) or bool(flags & 1) != bool(open_.get(serial)):
            raise ValueError(f"page {sequence} of stream {serial} is out of order")
        expected[serial] = sequence + 1
        packets, at, rest = streams.setdefault(serial, []), 0, open_.get(serial, b"")
        for value in lacing:
            rest += body[at : at + value]
            at += value
            if value < 255:
                packets.append((bytes(rest), max(granule, 0) / RATE))
                rest = b""
        open_[serial] = rest
    if any(open_.values()):
        raise ValueError("a packet is not finished")
    return streams


def load(media: bytes) -> tuple[bytes, float]:
    """The payload and its duration in seconds."""
    streams = demux(media)
    one, two = ([p for p, _ in streams[s][1:]] for s in (1, 2))
    out = [b""] * (len(one) + len(two))
    out[::2], out[1::2] = one, two
    return b"".join(out), sum(x[-1][1] for x in streams.values())


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8")
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return len(raw), raw.ljust(size, b" ")


def features(payload: bytes, seconds: float) -> str:
    """Duration, peak, mean, root mean square and zero crossings of the samples around 128."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    level = np.arange(256) - 128
    n = len(payload)
    mean, power = int((counts * level).sum()) / n, int((counts * level * level).sum()) / n
    high = np.frombuffer(payload, np.uint8) > 127
    return f"ogg8:{seconds:.4f}s:peak={int(np.abs(level[counts > 0]).max())}:mean={mean:.4f}:rms={power ** 0.5:.4f}:crossings={int(np.count_nonzero(high[1:] != high[:-1]))}"


def inspect(media: bytes) -> tuple[bytes, str]:
    try:
        payload, seconds = load(media)
    except (ValueError, KeyError):
        return b"", "damaged"
    return payload, features(payload, seconds)


def media_columns(docs: DataFrame) -> DataFrame:
    """A row per document with digests of the payload that is read back and of the stored file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                n, payload = payload_of(text)
                media = store(payload)
                back, feature = inspect(media)
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return B.with_null_ids(B.plain(docs).mapInPandas(run, RESULT))


def op9_media_ogg(spark, sf_dir):
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
