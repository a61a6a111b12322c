import hashlib
import zlib

import pytest

from weftline.llm import media_ogg as M


def plain_checksum(data):
    value = 0
    for byte in data:
        value ^= byte << 24
        for _ in range(8):
            value = ((value << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if value & 0x80000000 else value << 1
    return value


def test_checksum_equals_bitwise_definition():
    for data in (b"", b"\0", b"OggS" + bytes(range(256))):
        assert M.page_checksum(data) == plain_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 192 * 255, 192 * 511 + 7, 300_000])
def test_round_trip(n):
    size, payload = M.payload_of("a" * n)
    back, seconds = M.load(M.store(payload))
    assert back == payload and size == n and seconds == pytest.approx(len(payload) / M.RATE)


def test_damage_is_found():
    media = bytearray(M.store(b"x" * 1920))
    media[200] ^= 1
    assert M.inspect(bytes(media)) == (b"", "damaged")
    whole = M.store(b"x" * 192 * 700)
    assert M.inspect(whole[:-10])[1] == "damaged"


def test_packets_over_several_pages():
    long = bytes(range(256)) * 300  # 76,800 bytes: 302 lacing values
    values = bytes([255] * (len(long) // 255) + [len(long) % 255])
    media = M._page(7, 0, 2, 0, b"\x01", b"h") + M._page(7, 1, 0, -1, values[:255], long[: 255 * 255]) + M._page(7, 2, 5, 76800, values[255:], long[255 * 255 :])
    assert M.demux(media)[7] == [(b"h", 0.0), (long, 9.6)]


def test_rows(docs, corpus, nothing):
    got = {(r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in M.media_columns(docs).collect()}
    want = set()
    for i, t in corpus:
        n, p = M.payload_of(t)
        want.add((i, n, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert got == want
    assert M.media_columns(nothing).count() == 0
