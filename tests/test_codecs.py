"""Codecs: round trips, several members, damage."""

import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.functions import codecs
from lodestone.sources.base import Corrupted, Unsupported

NOTES = b"".join(b"%05d The quick brown fox jumps over the lazy dog, line %d of the notes.\n" % (i, i) for i in range(400))


@pytest.mark.parametrize("codec", sorted(codecs.ENCODERS))
def test_round_trip(codec):
    for data in (b"", b"x", NOTES, bytes(range(256)) * 300):
        assert codecs.decompress(codec, codecs.compress(codec, data)) == data


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from(["GZIP", "ZSTD", "SNAPPY", "LZIP", "LZ4"]))
def test_round_trip_of_anything(data, codec):
    assert codecs.decompress(codec, codecs.compress(codec, data)) == data


@pytest.mark.parametrize("codec", ["GZIP", "BZIP2", "XZ", "ZSTD", "LZIP"])
def test_members_are_joined(codec):
    one, two = codecs.compress(codec, NOTES), codecs.compress(codec, b"second")
    assert codecs.decompress(codec, one + two) == NOTES + b"second"


def test_zstd_skips_frames_to_skip():
    skip = b"\x50\x2a\x4d\x18" + struct.pack("<I", 3) + b"abc"
    assert codecs.decompress("ZSTD", skip + codecs.compress("ZSTD", NOTES)) == NOTES


@pytest.mark.parametrize("level", [1, 2, 3, 5, 6, 8, 12])
def test_zstd_levels(level):
    assert codecs.decompress("ZSTD", codecs.compress("ZSTD", NOTES * 3, level)) == NOTES * 3


@pytest.mark.parametrize("codec", ["GZIP", "BZIP2", "XZ", "ZSTD", "LZIP", "SNAPPY"])
def test_damage_is_reported(codec):
    packed = bytearray(codecs.compress(codec, NOTES))
    packed[len(packed) // 2] ^= 0x55
    with pytest.raises(Corrupted):
        codecs.decompress(codec, bytes(packed))
    with pytest.raises(Corrupted):
        codecs.decompress(codec, bytes(codecs.compress(codec, NOTES)[:-5]))


def lzw(data: bytes) -> bytes:
    """Unix compress with 9 to 16 bit codes, without a reset."""
    table, out, bits, have, width = {bytes([i]): i for i in range(256)}, bytearray(b"\x1f\x9d\x90"), 0, 0, 9
    n, word, codes = 257, b"", []
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        codes.append(table[word])
        table[word + c] = n
        n += 1
        word = c
    if word:
        codes.append(table[word])
    known, group, wrote = 257, 0, 0
    total = 0
    for i, code in enumerate(codes):
        bits |= code << total
        total += width
        wrote += 1
        if i:
            known += 1
            if known == 1 << width and width < 16:
                total += -(wrote * width) % (width * 8)
                width, wrote = width + 1, 0
    return bytes(out) + bits.to_bytes((total + 7) // 8, "little")


def test_unix_compress():
    assert codecs.decompress("Z", lzw(b"abababab" * 20)) == b"abababab" * 20
    assert codecs.decompress("Z", lzw(NOTES)) == NOTES


def test_szdd():
    text = b"plain text without copies"
    body = b"".join(b"\xff" + text[i : i + 8] for i in range(0, len(text), 8))
    assert codecs.decompress("MSLZ", b"SZDD\x88\xf0\x27\x33A\0" + struct.pack("<I", len(text)) + body) == text


def test_lzop_of_stored_blocks():
    head = b"\x89LZO\0\r\n\x1a\n" + struct.pack(">HHHBBIIIIB", 0x1030, 0x2080, 0x0940, 1, 5, 1, 0o644, 0, 0, 0)
    data = head + struct.pack(">I", zlib.adler32(head[9:])) + struct.pack(">III", len(NOTES), len(NOTES), zlib.adler32(NOTES)) + NOTES + b"\0\0\0\0"
    assert codecs.decompress("LZOP", data) == NOTES


def test_lzo_block():
    # 4 literals, then a copy of 6 bytes at distance 4, then the end mark
    block = bytes([21]) + b"abcd" + bytes([0x20 | 4, 3 << 2, 0]) + b"\x11\0\0"
    assert codecs.lzo1x(block, 10) == b"abcdabcdab"


def test_partial_keeps_what_came_before():
    packed = codecs.compress("GZIP", NOTES)
    body, whole = codecs.partial("GZIP", packed[: len(packed) // 2])
    assert not whole and body and NOTES.startswith(body)


def test_unknown_codec():
    with pytest.raises(Unsupported):
        codecs.decompress("RAR", b"")
    with pytest.raises(Unsupported):
        codecs.compress("Z", b"")


def test_crc32c():
    assert codecs.crc32c(b"123456789") == 0xE3069283
