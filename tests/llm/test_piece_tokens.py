import hashlib
import random
import struct
from pathlib import Path

import numpy as np
import pytest
import sentencepiece

from weftline.llm.piece_tokens import DEFAULT_MODEL, Codec, PieceModel, _fields, encode

pytestmark = pytest.mark.skipif(not Path(DEFAULT_MODEL).exists(), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)


@pytest.fixture(scope="module")
def codec():
    return Codec(Path(DEFAULT_MODEL).read_bytes())


def test_pieces_and_options(library):
    model = PieceModel(Path(DEFAULT_MODEL).read_bytes())
    assert len(model.pieces) == library.get_piece_size() and model.by_unit
    assert all(model.pieces[i] == library.id_to_piece(i) and model.scores[i] == pytest.approx(library.get_score(i)) for i in range(0, 32000, 7))


def texts():
    rng = random.Random(4)
    base = ["", " ", "   ", "Hello world", "  two  and   three    spaces ", "tabs\tand\nlines\r\n", "Größe naïve 北京 🙂👍🏽", "<s> </s> <unk> <0x41>", "a▁b", "\u0000​﻿", "x" * 300, "=" * 80 + " " * 40 + "中", " " * 600 + "end", " " * 300, "no break", "1234567890" * 5]
    return base + ["".join(rng.choice("abcdeéü中 🙂  \n.,") for _ in range(rng.randrange(1, 200))) for _ in range(300)]


def test_parity_with_the_library(codec, library):
    ids, decoded = codec.encode(texts())
    for t, a, b in zip(texts(), ids, decoded, strict=True):
        want = library.encode(t)
        assert a.tolist() == want, repr(t)
        assert b.decode() == library.decode(want), repr(t)
    assert codec.decode([x.tolist() for x in ids]) == [b.decode() for b in decoded]


def test_every_length_of_marker_runs(codec, library):
    words = ["", "a", "the", "x" * 70, "中" * 40, "ab" * 150]
    every = [" " * n + w for n in [*range(1, 70), *range(250, 260), *range(505, 520)] for w in words] + ["a" + " " * n + "b" for n in range(1, 600, 7)]
    for t, a in zip(every, codec.encode(every)[0], strict=True):
        assert a.tolist() == library.encode(t), (len(t), t[-5:])


def test_any_ids_decode_as_the_library_does(codec, library):
    rng = random.Random(8)
    for _ in range(300):
        ids = [rng.randrange(3, 32000) for _ in range(rng.randrange(1, 30))]
        assert codec.decode([ids]) == [library.decode(ids)]


def varint(n):
    return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])


def field(k, value):
    if isinstance(value, bytes):
        return varint(k << 3 | 2) + varint(len(value)) + value
    return varint(k << 3 | 5) + struct.pack("<f", value) if isinstance(value, float) else varint(k << 3) + varint(value)


def small_model(kind, charsmap=b"", user=(), byte_fallback=True):
    """A model file written by hand, with scores from a rule."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(u, 0.0, 4) for u in user]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []
    words = ["▁", *"abcdefi ABC.<>x0".replace(" ", ""), "▁a", "ab", "▁ab", "bc", "abc", "▁▁", "de", "def", "▁de", "fi", "ef", "ab<", "aa", "aaa"]
    rows += [(w, -1.5 - 0.37 * (i * 7 % 23) - i / 100, 1) for i, w in enumerate(words)]
    pieces = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in rows)
    trainer = field(3, kind) + field(35, int(byte_fallback)) + field(40, 0) + field(41, 1) + field(42, 2) + field(43, (1 << 64) - 1)
    spec = field(2, charsmap) + field(3, 1) + field(4, 1) + field(5, 1) if charsmap else field(3, 1) + field(4, 0) + field(5, 1)
    return pieces + field(2, trainer) + field(3, spec)


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("with_map", [False, True])
@pytest.mark.parametrize("user", [(), ("<sep>", "ab.", "<sep>x")])
@pytest.mark.parametrize("byte_fallback", [True, False])
def test_hand_written_models_equal_the_library(kind, with_map, user, byte_fallback):
    charsmap = dict(_fields(dict(_fields(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto()))[3]))[2] if with_map else b""
    raw = small_model(kind, charsmap, user, byte_fallback)
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=raw), Codec(raw)
    rng = random.Random(kind)
    texts = ["".join(rng.choice(["a", "b", "c", "abc", " ", "  ", "def", "é", "中", "ﬁ", "Ａ", "<sep>", "ab.", "<s>", "<0x41>", "x", "."]) for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    for t, a, b in zip(texts, *codec.encode(texts), strict=True):
        assert a.tolist() == library.encode(t), repr(t)
        if byte_fallback:
            assert b.decode() == library.decode(library.encode(t)), repr(t)


def test_small_cache_gives_the_same(codec, monkeypatch):
    import weftline.llm.piece_tokens as module

    monkeypatch.setattr(module, "CACHE_UNITS", 50)
    small = Codec(Path(DEFAULT_MODEL).read_bytes())
    assert [x.tolist() for x in small.encode(texts())[0]] == [x.tolist() for x in codec.encode(texts())[0]]


def test_units_end_before_signs_and_at_line_ends(library):
    codec = Codec(Path(DEFAULT_MODEL).read_bytes())
    codec.encode(["the, the. the;\nthe (the)\n\nthe m² 3.5 x.com don't"])
    assert {"▁the", "the", ",", ".", "\n", "▁m", "²"} <= set(codec.slots) and not {"▁the,", "▁the.", "▁the;\nthe"} & set(codec.slots)
    rng = random.Random(12)
    parts = ["the", "Ab", "é", "²", "µ", "中", "🙂", "1", "23", ".", ",", "'s", "//", "::", "\n", "\n\n", "\t", "\r\n", " ", "   ", "▁", "_", "<0x0A>", "=" * 9, "“", "€", "\x00", "ß"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    for t, a, b in zip(texts, *codec.encode(texts), strict=True):
        assert a.tolist() == library.encode(t), repr(t)
        assert b.decode() == library.decode(a.tolist()), repr(t)


def test_units_that_are_met_again_stay_in_a_full_cache(library, monkeypatch):
    import weftline.llm.piece_tokens as module

    monkeypatch.setattr(module, "CACHE_UNITS", 50)
    codec = Codec(Path(DEFAULT_MODEL).read_bytes())
    learnt = []
    learn = codec._learn
    monkeypatch.setattr(codec, "_learn", lambda units: (learnt.extend(units), learn(units)))
    for k in range(40):
        t = "often often and and " + " ".join(f"w{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]}{c}" for c in "abcdefghijklmnopqrst")
        assert codec.encode([t])[0][0].tolist() == library.encode(t)
    assert learnt.count("▁often") == learnt.count("▁and") == 1 and len(codec.slots) < 100


def test_rows(docs, corpus, nothing, library):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.round_trip) for r in encode(docs).collect()}
    want = set()
    for i, t in corpus:
        ids = library.encode(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), True))
    assert got == want
    assert encode(nothing).count() == 0
