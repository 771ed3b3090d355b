"""Parsers: the common payload in every container that can be built here, damage, errors as values."""

import gzip
import hashlib
import io
import random
import struct
import tarfile
import zipfile
import zlib

import pytest

from lodestone.operators import write
from lodestone.sources import discs, registry, sevenzip, simple, windows
from lodestone.sources import zip as zip_
from lodestone.sources.aes import AES
from lodestone.sources.base import ArchiveError, Corrupted, Encrypted, Unsupported

_rng = random.Random(20240102)
PAYLOAD = {
    "docs/notes.txt": b"".join(b"%05d The quick brown fox jumps over the lazy dog, line %d of the notes.\n" % (i, i) for i in range(400)),
    "docs/empty.txt": b"",
    "bin/random.bin": bytes(_rng.getrandbits(8) for _ in range(4096)),
    "deep/a/b/c/leaf.txt": b"leaf\n",
}
SUMS = {"docs/notes.txt": "d7e02c884850cdfa9d78d1e322269a120fdce78e1178469a980945b2d27d0c66", "bin/random.bin": "8fe774a9e65a6c63fc7df534a66e2bafb44a73813a37b2abcc178749b237552e", "deep/a/b/c/leaf.txt": "26d0bac9f0c7a35b2f3322a0f4ad4517265f56b2c0f4b2ed7cb5cbd30c5868e2"}
FILES = [(n, c, 1_700_000_000) for n, c in PAYLOAD.items()]


def contents(kind, data, **kw):
    return {e.name: e.content for e in registry.parse(data, kind, "x.bin", **kw) if not e.is_directory}


def test_payload_is_the_published_one():
    for name, digest in SUMS.items():
        assert hashlib.sha256(PAYLOAD[name]).hexdigest() == digest


@pytest.mark.parametrize("kind", sorted(set(write.WRITERS) - {"PAK", "ZIP_STORED", "TAR_BROTLI"}))
def test_written_archives_read_back(kind):
    assert contents(kind, write.WRITERS[kind](FILES)) == PAYLOAD


def test_listing_needs_no_content():
    for kind in ("ZIP", "TAR", "SEVEN_Z", "CAB"):
        listed = {e.name: (e.uncompressed_size, e.content) for e in registry.parse(write.WRITERS[kind](FILES), kind, want=False)}
        assert listed == {n: (len(c), None) for n, c in PAYLOAD.items()}


def test_folders_times_and_modes():
    rows = [("empty-dir", None, 1_700_000_000), *FILES]
    for kind in ("ZIP", "TAR", "SEVEN_Z"):
        got = list(registry.parse(write.WRITERS[kind](rows), kind))
        assert got[0].name == "empty-dir/" and got[0].is_directory
        assert all(e.modified == 1_700_000_000 for e in got)


def test_pak_plugin():
    data = write.pak_bytes(FILES)
    assert contents(None, data, plugins=registry.BUILT_IN.ordered()) == PAYLOAD


def sarc_bytes():
    names = b"".join(n.encode() + b"\0" * (4 - len(n) % 4) for n in PAYLOAD)
    nodes, at, off = b"", 0, 0
    for n, c in PAYLOAD.items():
        nodes += struct.pack("<IIII", 0, 1 << 24 | at // 4, off, off + len(c))
        at += len(n) + 4 - len(n) % 4
        off += len(c)
    sfat = b"SFAT" + struct.pack("<HHI", 12, len(PAYLOAD), 0x65) + nodes
    head = sfat + b"SFNT" + struct.pack("<HH", 8, 0) + names
    return b"SARC" + struct.pack("<HHIIHH", 20, 0xFEFF, 0, 20 + len(head), 0x100, 0) + head + b"".join(PAYLOAD.values())


def test_sarc_plugin_plain_and_packed():
    data = sarc_bytes()
    packed = b"Yaz0" + struct.pack(">I", len(data)) + b"\0" * 8 + b"".join(b"\xff" + data[i : i + 8] for i in range(0, len(data), 8))
    for d in (data, packed):
        assert contents(None, d, plugins=registry.BUILT_IN.ordered()) == PAYLOAD


def test_yaz0_copies():
    assert simple.yaz0(b"Yaz0" + struct.pack(">I", 10) + b"\0" * 8 + b"\xc0ab" + b"\x60\x01") == b"ab" * 5


def newc(files, magic=b"070701"):
    out = b""
    for name, body, mode in [*files, ("TRAILER!!!", b"", 0)]:
        raw = name.encode() + b"\0"
        head = magic + b"".join(b"%08x" % x for x in (1, mode, 0, 0, 1, 1000, len(body), 0, 0, 0, 0, len(raw), 0)) + raw
        out += head + b"\0" * (-len(head) % 4)
        out += body + b"\0" * (-len(body) % 4)
    return out


def test_cpio_and_rpm_and_nested_cpio():
    files = [("./" + n, c, 0o100644) for n, c in PAYLOAD.items()] + [("link", b"docs/notes.txt", 0o120777), ("dir", b"", 0o040755)]
    data = newc(files)
    got = {e.name: e for e in simple.cpio(data)}
    assert got["link"].link_target == "docs/notes.txt" and got["link"].content is None and got["dir/"].is_directory
    assert {n: got[n].content for n in PAYLOAD} == PAYLOAD
    rpm = b"\xed\xab\xee\xdb" + b"\0" * 92 + 2 * (b"\x8e\xad\xe8\x01" + b"\0" * 4 + struct.pack(">II", 0, 0)) + gzip.compress(data)
    assert {e.name: e.content for e in simple.rpm(rpm) if e.name in PAYLOAD} == PAYLOAD
    assert {e.name: e.content for e in registry.parse(gzip.compress(data), "GZIP", "p.cpio.gz") if e.name in PAYLOAD} == PAYLOAD
    odc = b""
    for name, body in [("a.txt", b"hello"), ("TRAILER!!!", b"")]:
        odc += b"070707" + b"%06o%06o%06o%06o%06o%06o%06o%011o%06o%011o" % (0, 0, 0o100644, 0, 0, 1, 0, 0, len(name) + 1, len(body)) + name.encode() + b"\0" + body
    assert [(e.name, e.content) for e in simple.cpio(odc)] == [("a.txt", b"hello")]


def ar_bytes(members):
    out = b"!<arch>\n"
    for name, body in members:
        out += b"%-16s%-12d%-6d%-6d%-8s%-10d`\n" % (name, 0, 0, 0, b"100644", len(body)) + body + b"\n" * (len(body) & 1)
    return out


def test_ar_and_deb():
    got = {e.name: e.content for e in simple.ar(ar_bytes([(b"//", b"a_very_long_member_name.txt/\n"), (b"/0", b"long"), (b"short.o/", b"odd"), (b"#1/8", b"bsd.name" + b"body")]))}
    assert got == {"a_very_long_member_name.txt": b"long", "short.o": b"odd", "bsd.name": b"body"}
    deb = ar_bytes([(b"debian-binary", b"2.0\n"), (b"control.tar.gz", gzip.compress(write.tar_bytes([("./control", b"Package: x\n", 0)]))), (b"data.tar.gz", gzip.compress(write.tar_bytes([("./usr/bin/x", b"x", 0)])))])
    assert {e.name: e.content for e in simple.ar(deb)} == {"DEBIAN/control": b"Package: x\n", "usr/bin/x": b"x"}


def test_xar():
    body = zlib.compress(PAYLOAD["docs/notes.txt"])
    digest = hashlib.sha1(PAYLOAD["docs/notes.txt"]).hexdigest()
    xml = lambda d: f'<xar><toc><file id="1"><name>docs</name><type>directory</type><file id="2"><name>notes.txt</name><type>file</type><mtime>2023-11-14T22:13:20Z</mtime><mode>0644</mode><data><offset>0</offset><length>{len(body)}</length><size>29490</size><encoding style="application/x-gzip"/><extracted-checksum style="sha1">{d}</extracted-checksum></data></file></file></toc></xar>'.encode()

    def build(d):
        toc = zlib.compress(xml(d))
        return b"xar!" + struct.pack(">HHQQI", 28, 1, len(toc), len(xml(d)), 0) + toc + body

    got = list(simple.xar(build(digest)))
    assert [(e.name, e.modified, e.mode) for e in got[1:]] == [("docs/notes.txt", 1_700_000_000, 0o644)] and got[1].content == PAYLOAD["docs/notes.txt"]
    assert list(simple.xar(build("0" * 40)))[1].error.kind == "Corrupted"


def test_zip_methods_and_encryption():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, method in enumerate((0, 8, 12, 14)):
            z.writestr(f"m{method}", PAYLOAD["docs/notes.txt"], compress_type=method)
    got = {e.name: e for e in zip_.entries(out.getvalue())}
    assert all(e.content == PAYLOAD["docs/notes.txt"] for e in got.values())
    assert got["m12"].method == "BZIP2" and got["m8"].crc32 == zlib.crc32(PAYLOAD["docs/notes.txt"])


def aes_zip(password=b"secret", tamper=False):
    import hmac

    body, salt = PAYLOAD["deep/a/b/c/leaf.txt"], bytes(range(16))
    key = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 66)
    raw = AES(key[:32]).ctr_le(body)
    mac = hmac.new(key[32:64], raw, hashlib.sha1).digest()[:10]
    raw = bytes([raw[0] ^ 1]) + raw[1:] if tamper else raw
    data = salt + key[64:] + raw + mac
    extra = struct.pack("<HHH2sBH", 0x9901, 7, 2, b"AE", 3, 0)
    common = struct.pack("<HHHHHIIIHH", 51, 1, 99, 0, 0x5821, 0, len(data), len(body), 8, len(extra))
    local = b"PK\x03\x04" + common + b"leaf.txt" + extra + data
    central = b"PK\x01\x02" + struct.pack("<H", 51) + common + struct.pack("<HHHII", 0, 0, 0, 0, 0) + b"leaf.txt" + extra
    return local + central + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), len(local), 0)


def test_zip_aes():
    (e,) = zip_.entries(aes_zip(), password="secret")
    assert e.content == b"leaf\n" and e.is_encrypted
    assert next(zip_.entries(aes_zip(), password="other")).error.kind == "Encrypted"
    assert next(zip_.entries(aes_zip())).error.kind == "Encrypted"
    assert next(zip_.entries(aes_zip(tamper=True), password="secret")).error.kind == "Corrupted"


def test_aes_of_the_standard():
    import numpy as np

    plain = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8)[None]
    for n, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        a = AES(bytes(range(n)))
        assert a.encrypt(plain).tobytes().hex() == want
        assert (a.decrypt(a.encrypt(plain)) == plain).all()


def test_tar_links_and_damage():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as t:
        i = tarfile.TarInfo("x" * 150)
        i.size = 5
        t.addfile(i, io.BytesIO(b"leaf\n"))
        i = tarfile.TarInfo("link")
        i.type, i.linkname = tarfile.SYMTYPE, "x" * 150
        t.addfile(i)
    got = list(simple.tar(out.getvalue()))
    assert got[0].content == b"leaf\n" and got[1].link_target == "x" * 150 and got[1].content is None
    with pytest.raises(Corrupted):
        list(simple.tar(write.tar_bytes(FILES)[:2560]))


def test_sevenzip_damage_and_limits():
    good = sevenzip.write(FILES)
    bad = bytearray(good)
    bad[64] ^= 0xFF
    assert any(e.error for e in sevenzip.entries(bytes(bad)))
    with pytest.raises(Corrupted):
        list(sevenzip.entries(good[:-40]))


@pytest.mark.parametrize("kind", ["ZIP", "TAR", "SEVEN_Z", "CAB", "TAR_GZ", "TAR_XZ"])
def test_damage_never_escapes(kind):
    """Whatever is flipped or cut, entries or errors come out; nothing else is raised."""
    data, rng = write.WRITERS[kind](FILES), random.Random(5)
    for _ in range(40):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad))] ^= 1 << rng.randrange(8)
        bad = bytes(bad[: rng.randrange(1, len(bad) + 1)])
        rows = list(registry.entry_rows("a", kind, bad))
        assert rows is not None


@pytest.mark.parametrize("kind", sorted(registry.PARSERS))
def test_garbage_is_an_error(kind):
    garbage = bytes((i * 37 + 11) & 0xFF for i in range(3000))
    for data in (b"", garbage, garbage[:7]):
        rows = list(registry.entry_rows("g", kind, data))
        assert not rows or rows[-1][-1] is not None or kind in ("TAR", "LHA", "BROTLI", "TAR_BROTLI")


def iso_bytes():
    """A volume with one folder and two files."""

    def both(v, n):
        return v.to_bytes(n, "little") + v.to_bytes(n, "big")

    def record(name, extent, size, flags):
        r = bytes([0]) + both(extent, 4) + both(size, 4) + bytes([123, 11, 14, 22, 13, 20, 0]) + bytes([flags, 0, 0]) + both(1, 2) + bytes([len(name)]) + name + b"\0" * (1 - len(name) % 2)
        return bytes([len(r) + 1]) + r

    leaf = record(b"A.TXT;1", 20, 5, 0)
    root = record(b"\0", 18, 2048, 2) + record(b"\1", 18, 2048, 2) + record(b"DIR", 19, 2048, 2) + record(b"B.BIN;1", 21, 3, 0)
    sub = record(b"\0", 19, 2048, 2) + record(b"\1", 18, 2048, 2) + leaf
    pvd = bytearray(2048)
    pvd[:6], pvd[156:190] = b"\x01CD001", record(b"\0", 18, 2048, 2)
    end = b"\xffCD001" + b"\0" * 2042
    return b"\0" * 32768 + bytes(pvd) + end + root.ljust(2048, b"\0") + sub.ljust(2048, b"\0") + b"leaf\n".ljust(2048, b"\0") + b"bin".ljust(2048, b"\0")


def test_iso():
    got = list(discs.iso(iso_bytes()))
    assert [(e.name, e.is_directory, e.content) for e in got] == [("DIR/", True, None), ("DIR/A.TXT", False, b"leaf\n"), ("B.BIN", False, b"bin")]
    assert got[1].modified == 1_700_000_000


def test_iso_zisofs():
    body = random.Random(2).randbytes(1000) * 33 + bytes(40_000) + b"end"
    blocks = [body[i : i + 32768] for i in range(0, len(body), 32768)]
    packed = [zlib.compress(x) if x.strip(b"\0") else b"" for x in blocks] + [b""]
    at = [16 + 4 * len(packed) + sum(map(len, packed[:i])) for i in range(len(packed))]
    raw = b"\x37\xe4\x53\x96\xc9\xdb\xd6\x07" + struct.pack("<IBBH", len(body), 4, 15, 0) + struct.pack(f"<{len(at)}I", *at) + b"".join(packed)

    def image(kind, raw):
        image = bytearray(iso_bytes())
        at = 18 * 2048
        for _ in range(3):  # B.BIN is the fourth record
            at += image[at]
        rr = b"RR\5\1\x81" + b"NM\x0a\1\0b.bin" + b"ZF\x10\1" + kind + bytes([4, 15]) + struct.pack("<I", len(body)) + struct.pack(">I", len(body))
        record = bytearray(image[at : at + 33 + 7]) + rr
        record += bytes(len(record) % 2)
        record[0], record[2:10], record[10:18] = len(record), struct.pack("<I", 21) + struct.pack(">I", 21), struct.pack("<I", len(raw)) + struct.pack(">I", len(raw))
        image[at : at + len(record)] = record
        image[21 * 2048 :] = raw
        return bytes(image) + bytes(-len(raw) % 2048)

    e = list(discs.iso(image(b"pz", raw)))[-1]
    assert (e.name, e.uncompressed_size, e.compressed_size, e.method, e.error) == ("b.bin", len(body), len(raw), "zisofs", None) and e.content == body
    bad = list(discs.iso(image(b"pz", raw[:200] + bytes(50) + raw[250:])))[-1]
    assert bad.content is None and isinstance(bad.error, Corrupted)
    other = list(discs.iso(image(b"PZ", raw)))[-1]
    assert other.content is None and isinstance(other.error, Unsupported)


def test_lha_and_arj_stored():
    body, name = b"leaf\n", b"leaf.txt"
    head = b"-lh0-" + struct.pack("<III", 5, 5, 0x5821 << 16) + b"\x20\0" + bytes([len(name)]) + name + struct.pack("<H", windows._crc16(body))
    lha = bytes([len(head), sum(head) & 0xFF]) + head + body + b"\0"
    assert [(e.name, e.content) for e in windows.lha(lha)] == [("leaf.txt", body)]

    def block(raw):
        return b"\x60\xea" + struct.pack("<H", len(raw)) + raw + struct.pack("<I", zlib.crc32(raw)) + b"\0\0"

    main = bytes([30, 11, 1, 2, 0, 0, 2, 0]) + b"\0" * 22 + b"a.arj\0\0"
    file = bytes([30, 11, 1, 2, 0, 0, 0, 0]) + struct.pack("<IIIIHHH", 0x58210000, 5, 5, zlib.crc32(body), 0, 0o644, 0) + b"leaf.txt\0\0"
    arj = block(main) + block(file) + body + b"\x60\xea\0\0"
    assert [(e.name, e.content, e.mode) for e in windows.arj(arj)] == [("leaf.txt", body, 0o644)]


def rar5(body=b"leaf\n"):
    def vint(v):
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    def block(raw, data=b""):
        sized = vint(len(raw)) + raw
        return struct.pack("<I", zlib.crc32(sized)) + sized + data

    name = b"leaf.txt"
    file = vint(2) + vint(2) + vint(len(body)) + vint(4 | 2) + vint(len(body)) + vint(0o100644) + struct.pack("<II", 1_700_000_000, zlib.crc32(body)) + vint(0) + vint(1) + vint(len(name)) + name
    return b"Rar!\x1a\x07\x01\0" + block(vint(1) + vint(0) + vint(0)) + block(file, body) + block(vint(5) + vint(0) + vint(0))


def test_rar5_stored():
    (e,) = windows.rar(rar5())
    assert (e.name, e.content, e.modified, e.mode) == ("leaf.txt", b"leaf\n", 1_700_000_000, 0o644)


def test_sfx_reads_the_archive_inside():
    exe = bytearray(512)
    exe[:2] = b"MZ"
    assert contents("SFX", bytes(exe) + write.zip_bytes(FILES)) == PAYLOAD
    with pytest.raises(Unsupported):
        list(registry.parse(bytes(exe), "SFX"))


def test_limits():
    data = write.zip_bytes([("zeros", b"\0" * 5_000_000, 0)])
    with pytest.raises(ArchiveError, match="times the archive"):
        list(registry.parse(data, "ZIP", limits=registry.Limits(max_ratio=100, ratio_threshold=1000)))
    with pytest.raises(ArchiveError, match="bytes"):
        list(registry.parse(data, "ZIP", limits=registry.Limits(max_total=1000)))
    assert list(registry.parse(data, "ZIP"))


def test_registry_refuses_incomplete_and_repeated_plugins():
    r = registry.Registry()
    p = registry.BUILT_IN.plugins["pak"]
    from dataclasses import replace

    assert r.register(p) and not r.register(p) and not r.register(replace(p, id="x", license=""))
    assert [w for _, w in r.refused] == ["id is taken", "missing license"]


def test_wrong_password_of_zipcrypto_is_encrypted():
    (e,) = zip_.entries(aes_zip(), password="nope")
    assert isinstance(e.error, Encrypted)


def test_zip_written_with_a_password():
    data = write.zip_aes_bytes([("d", None, 0), *FILES], "secret")
    got = list(zip_.entries(data, password="secret"))
    assert {e.name: e.content for e in got if not e.is_directory} == PAYLOAD and got[0].name == "d/"
    assert all(e.error.kind == "Encrypted" for e in zip_.entries(data, password="x") if not e.is_directory)


def udf_bytes():
    """A volume with one folder and two files, one embedded in its entry."""
    b = {}
    tag = lambda n, rest: struct.pack("<H", n) + b"\0" * 14 + rest
    long_ad = lambda n: struct.pack("<IIH6s", 2048, n, 0, b"")
    stamp = struct.pack("<HhBBBBB", 0x1000, 2023, 11, 14, 22, 13, 20) + b"\0" * 3
    b[256] = tag(2, struct.pack("<II", 4 * 2048, 257))
    b[257] = tag(5, b"\0" * 6 + struct.pack("<H", 0) + b"\0" * 164 + struct.pack("<II", 300, 100))
    b[258] = tag(6, b"\0" * 232 + long_ad(0) + struct.pack("<II", 6, 1) + b"\0" * 168 + bytes([1, 6]) + struct.pack("<HH", 1, 0))
    b[259] = tag(8, b"")
    b[300] = tag(256, b"\0" * 384 + long_ad(1))

    def entry(kind, body, inline):
        icb = b"\0" * 11 + bytes([kind]) + b"\0" * 6 + struct.pack("<H", 3 if inline else 0)
        head = tag(261, icb + b"\0" * 20 + struct.pack("<QQ", len(body), 0) + stamp * 4 + b"\0" * 44)
        head = head[:168].ljust(168, b"\0") + struct.pack("<II", 0, len(body) if inline else 8)
        return head + (body if inline else struct.pack("<II", len(body), 9))

    def record(name, n, folder, parent=False):
        raw = b"" if parent else b"\x08" + name
        out = tag(257, struct.pack("<HBB", 1, (2 if folder else 0) | (8 if parent else 0), len(raw)) + long_ad(n) + struct.pack("<H", 0) + raw)
        return out + b"\0" * (-len(out) % 4)

    b[301] = entry(4, record(b"", 1, True, True) + record(b"DIR", 2, True) + record(b"b.bin", 4, False), True)
    b[302] = entry(4, record(b"", 1, True, True) + record(b"a.txt", 3, False), True)
    b[303] = entry(5, b"leaf\n", True)
    b[304] = entry(5, b"binary", False)
    b[309] = b"binary"
    return b"".join(b.get(i, b"").ljust(2048, b"\0") for i in range(320))


def test_udf():
    got = list(discs.udf(udf_bytes()))
    assert [(e.name, e.is_directory, e.content) for e in got] == [("DIR/", True, None), ("DIR/a.txt", False, b"leaf\n"), ("b.bin", False, b"binary")]


def test_deflate64():
    from lodestone.sources.deflate64 import inflate64

    rng = random.Random(9)
    for data in (b"", b"abc" * 40, PAYLOAD["docs/notes.txt"], bytes(rng.randrange(256) for _ in range(3000)), bytes(rng.choices(b"abcd", k=20_000))):
        for level, strategy in ((0, 0), (6, 0), (9, 0), (6, zlib.Z_FIXED), (6, zlib.Z_HUFFMAN_ONLY)):
            c = zlib.compressobj(level, zlib.DEFLATED, -15, 9, strategy)
            raw = c.compress(data) + c.flush()
            assert inflate64(raw) == data  # the formats differ in matches of 258 bytes, which these texts don't have
    # a fixed block: literal a, then length code 285 with 16 extra bits at distance 1, then the end
    bits = "1" + "10" + format(0x30 + 97, "08b") + format(0xC0 + 285 - 280, "08b") + format(60_000, "016b")[::-1] + "00000" + "0000000"
    raw = int(bits[::-1], 2).to_bytes(-(-len(bits) // 8), "little")
    assert inflate64(raw) == b"a" * 60_004
    for cut in (raw[:3], b"\x07", b""):
        with pytest.raises(Corrupted):
            inflate64(cut)


def test_zip_with_deflate64():
    body = PAYLOAD["docs/notes.txt"]
    data = bytearray(write.zip_bytes([("n", body, 0)]))
    for mark, off in ((b"PK\x03\x04", 8), (b"PK\x01\x02", 10)):
        at = data.find(mark) + off
        data[at : at + 2] = b"\x09\0"
    (e,) = zip_.entries(bytes(data))
    assert e.method == "Deflate64" and e.content == body


class LzxWriter:
    """Verbatim, aligned and uncompressed blocks over flat codes."""

    def __init__(self):
        self.bits, self.lens = "", {"main": [0] * 496, "length": [0] * 249}

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def lengths(self, name, first, end, want):
        """Every length of a span becomes ``want``."""
        zs = [(old - want) % 17 for old in self.lens[name][first:end]]
        for z in range(20):
            self.put(5 if z < 17 else 0, 4)  # 17 codes of 5 bits
        for z in zs:
            self.put(z, 5)
        self.lens[name][first:end] = [want] * (end - first)

    def block(self, kind, items, aligned=None):
        """items: a byte, or (slot, extra bits, length)."""
        from lodestone.sources import lzx

        size = sum(1 if isinstance(i, int) else i[2] for i in items)
        self.put(kind, 3)
        self.put(size, 24)
        if kind == 2:
            for _ in range(8):
                self.put(3, 3)
        self.lengths("main", 0, 256, 9)
        self.lengths("main", 256, 496, 9)
        self.lengths("length", 0, 249, 8)
        for i in items:
            if isinstance(i, int):
                self.put(i, 9)
                continue
            slot, more, n = i
            self.put(256 + slot * 8 + min(n - 2, 7), 9)
            if n >= 9:
                self.put(n - 9, 8)
            extra = lzx._EXTRA[slot]
            if kind == 2 and extra >= 3:
                self.put(more >> 3, extra - 3)
                self.put(more & 7, 3)
            else:
                self.put(more, extra)

    def done(self):
        self.bits += "0" * (-len(self.bits) % 16)
        out = b"".join(struct.pack("<H", int(self.bits[i : i + 16], 2)) for i in range(0, len(self.bits), 16))
        self.bits = ""
        return out


def test_lzx():
    from lodestone.sources import lzx

    w, text = LzxWriter(), list(b"hello world, ")
    w.put(0, 1)  # calls aren't translated
    # offset 13 is 15 - 2: slot 7 begins at 12 with 2 extra bits; then the same offset again, then offset 1
    w.block(1, [*text, (7, 3, 26), (0, 0, 3), ord("!"), (3, 0, 20)])
    # slot 10 begins at 32 with 4 extra bits, three of them aligned: offset 32 + 11 - 2 = 41; then the last but one
    w.block(2, [ord("#"), (10, 11, 5), (1, 0, 4)])
    want = b"hello world, " * 3 + b"hel" + b"!" * 21 + b"#"
    want += want[-41:-36]
    want += want[-1:] * 4
    d = lzx.Decoder(15)
    assert d.frame(w.done(), len(want)) == want
    # the next frame goes on with the codes' lengths and the window; a stored block follows
    w.block(1, [ord("x"), (0, 0, 2)])
    w.put(3, 3)
    w.put(5, 24)
    raw = w.done() + struct.pack("<III", 7, 8, 9) + b"stuff"
    assert d.frame(raw, 8) == b"xxxstuff" and d.repeated == [7, 8, 9]
    with pytest.raises(Corrupted):
        lzx.Decoder(15).frame(b"\x00\x00" * 4, 100)


def test_lzx_cabinet():
    w, body = LzxWriter(), PAYLOAD["deep/a/b/c/leaf.txt"]
    w.put(0, 1)
    w.block(1, list(body))
    raw = w.done()
    table = struct.pack("<IIHHHH", len(body), 0, 0, 0x576E, 0, 0x20) + b"leaf.txt\0"
    start = 44 + len(table)
    block = struct.pack("<IHH", 0, len(raw), len(body)) + raw
    head = struct.pack("<4sIIIIIBBHHHHH", b"MSCF", 0, start + len(block), 0, 44, 0, 3, 1, 1, 1, 0, 0, 0)
    (e,) = windows.cab(head + struct.pack("<IHH", start, 1, 3 | 15 << 8) + table + block)
    assert (e.name, e.method, e.content) == ("leaf.txt", "LZX", body)


def xpress_bytes(text):
    """Literals alone, each with a code of 9 bits."""
    lengths = bytes([9 | 9 << 4] * 128) + b"\0" * 128
    bits = "".join(format(b, "09b") for b in text)
    bits += "0" * (-len(bits) % 16 + 32)
    return lengths + b"".join(struct.pack("<H", int(bits[i : i + 16], 2)) for i in range(0, len(bits), 16))


def lzx_chunk(text):
    w = LzxWriter()
    w.put(1, 3)
    w.put(0, 1)
    w.put(len(text), 16)
    w.lengths("main", 0, 256, 9)
    w.lengths("main", 256, 496, 9)
    w.lengths("length", 0, 249, 8)
    for b in text:
        w.put(b, 9)
    return w.done()


def wim_bytes(body, packed, flags):
    """One image with one file in one folder."""
    digest = hashlib.sha1(body).digest()

    def entry(name, attr, sub, sha):
        raw = name.encode("utf-16-le")
        out = struct.pack("<IiQ", attr, -1, sub) + b"\0" * 16 + struct.pack("<QQQ", 0, 0, (1_700_000_000 + 11_644_473_600) * 10**7) + sha + b"\0" * 12 + struct.pack("<HHH", 0, 0, len(raw)) + raw + b"\0\0"
        size = -(-(8 + len(out)) // 8) * 8
        return struct.pack("<Q", size) + out + b"\0" * (size - 8 - len(out))

    end = struct.pack("<Q", 0)
    root = len(entry("", 0x10, 0, b"\0" * 20)) + 8
    files = 8 + root
    top = entry("", 0x10, files, b"\0" * 20) + end
    one = entry("dir", 0x10, 0, b"\0" * 20)
    inside = entry("dir", 0x10, files + len(one) + 8, b"\0" * 20) + end + entry("leaf.txt", 0x20, 0, digest) + end
    meta = struct.pack("<II", 8, 0) + top + inside
    at = 208
    table = struct.pack("<QQQHI", len(packed) | 4 << 56, at, len(body), 1, 1) + digest
    table += struct.pack("<QQQHI", len(meta) | 2 << 56, at + len(packed), len(meta), 1, 1) + hashlib.sha1(meta).digest()
    head = b"MSWIM\0\0\0" + struct.pack("<IIII", 208, 0xD00, flags, 32768) + b"\0" * 16 + struct.pack("<HHI", 1, 1, 1)
    head += struct.pack("<QQQ", len(table), at + len(packed) + len(meta), len(table))
    return head.ljust(208, b"\0") + packed + meta + table


def test_wim():
    body = b"e8 \xe8 is translated only with a target, " * 3
    for packed, flags, method in ((xpress_bytes(body), 0x20002, "XPRESS"), (lzx_chunk(body), 0x40002, "LZX")):
        packed = packed if len(packed) != len(body) else packed + b"\0\0"
        got = list(discs.wim(wim_bytes(body, packed, flags)))
        assert [(e.name, e.is_directory) for e in got] == [("dir/", True), ("dir/leaf.txt", False)]
        assert got[1].method == method and got[1].modified == 1_700_000_000 and got[1].error is None
        assert discs.xpress(xpress_bytes(body), len(body)) == body
        assert len(got[1].content) == len(body) and (method == "LZX" or got[1].content == body)


def chm_bytes(first, second):
    """Two files in the compressed section, of one frame, and one stored."""
    w = LzxWriter()
    w.put(0, 1)
    w.block(1, list(first + second))
    content = w.done()
    control = struct.pack("<I4sIIIII", 6, b"LZXC", 2, 2, 1, 1, 0)
    reset = struct.pack("<IIIIQQQQ", 2, 1, 8, 40, len(first + second), len(content), 32768, 0)
    base = windows._CHM
    stored = [(base + "Content", content), (base + "ControlData", control), (base + "Transform/{7FC28940-9D31-11D0-9B27-00A0C91E9C7C}/InstanceData/ResetTable", reset), ("/plain.txt", b"plain")]

    def number(v):
        return (bytes([v >> 7 | 128]) if v > 127 else b"") + bytes([v & 127])

    names, at = b"", 0
    for name, body in stored:
        names += number(len(name)) + name.encode() + number(0) + number(at) + number(len(body))
        at += len(body)
    for name, off, n in (("/a.htm", 0, len(first)), ("/d/b.htm", len(first), len(second)), ("/#SYSTEM", 0, 1), ("/d/", 0, 0)):
        names += number(len(name)) + name.encode() + number(1) + number(off) + number(n)
    chunk = (b"PMGL" + struct.pack("<IIii", 4096 - 20 - len(names), 0, -1, -1) + names).ljust(4096, b"\0")
    directory = (b"ITSP" + struct.pack("<IIIIIIiiiII", 1, 84, 10, 4096, 2, 1, -1, 0, 0, 0, 1)).ljust(84, b"\0")
    directory = directory[:32] + struct.pack("<iiiI", 0, 0, -1, 1) + directory[48:] + chunk
    head = (b"ITSF" + struct.pack("<I", 3)).ljust(72, b"\0") + struct.pack("<QQQ", 96, len(directory), 96 + len(directory))
    return head + directory + b"".join(body for _, body in stored)


def test_chm():
    first, second = b"<p>one</p>" * 20, b"<p>two</p>"
    got = {e.name: e for e in windows.chm(chm_bytes(first, second))}
    assert set(got) == {"plain.txt", "a.htm", "d/b.htm", "d/"} and got["d/"].is_directory
    assert got["a.htm"].content == first and got["d/b.htm"].content == second and got["plain.txt"].content == b"plain" and got["a.htm"].method == "LZX"


def adf_bytes(fast=True):
    """A floppy with a folder, a file in it and one beside it."""
    b = {}

    def header(kind, name, size=0, blocks=(), table=()):
        raw = bytearray(512)
        struct.pack_into(">I", raw, 0, 2)
        if kind == -3:
            struct.pack_into(">I", raw, 8, len(blocks))
            for i, n in enumerate(blocks):
                struct.pack_into(">I", raw, 308 - 4 * i, n)
            struct.pack_into(">I", raw, 324, size)
        for i, n in table:
            struct.pack_into(">I", raw, 24 + 4 * i, n)
        struct.pack_into(">III", raw, 420, 8000, 60, 50)
        raw[432 : 433 + len(name)] = bytes([len(name)]) + name
        struct.pack_into(">i", raw, 508, kind)
        return raw

    def data(body):
        step = 512 if fast else 488
        out = []
        for i in range(0, len(body), step):
            part = body[i : i + step]
            out.append(part.ljust(512, b"\0") if fast else (struct.pack(">IIIIII", 8, 0, 1, len(part), 0, 0) + part).ljust(512, b"\0"))
        return out

    body = PAYLOAD["docs/notes.txt"][:1200]
    parts = data(body)
    b[880] = header(1, b"disk", table=[(3, 900), (5, 910)])
    b[900] = header(2, b"dir", table=[(0, 901)])
    b[901] = header(-3, b"notes", len(body), range(902, 902 + len(parts)))
    b |= {902 + i: p for i, p in enumerate(parts)}
    b[910] = header(-3, b"leaf.txt", 5, [911])
    b[911] = data(b"leaf\n")[0]
    image = bytearray(901120)
    image[:4] = b"DOS" + bytes([1 if fast else 0])
    for n, raw in b.items():
        image[n * 512 : n * 512 + 512] = raw
    return bytes(image), body


@pytest.mark.parametrize("fast", [True, False])
def test_adf(fast):
    image, body = adf_bytes(fast)
    got = list(discs.adf(image))
    assert [(e.name, e.content) for e in got] == [("dir/", None), ("dir/notes", body), ("leaf.txt", b"leaf\n")]
    assert got[2].modified == 252_460_800 + 8000 * 86_400 + 60 * 60 + 1


def squashfs_bytes(pack=zlib.compress, comp=1):
    """A folder with a file of a block and a fragment, a small file in the fragment, and a link."""
    block = 4096
    big, small = bytes(range(256)) * 16 + b"tail", b"leaf\n"
    first = pack(big[:block])
    fragment = big[block:] + small
    blocks = b"\0" * 96 + first + fragment
    meta = lambda raw: struct.pack("<H", len(raw) | 0x8000) + raw
    base = lambda kind, mode, n: struct.pack("<HHHHII", kind, mode, 0, 0, 1_700_000_000, n)
    inodes = base(2, 0o644, 1) + struct.pack("<IIII", 96, 0, 0, len(big)) + struct.pack("<I", len(first))
    at_small = len(inodes)
    inodes += base(2, 0o600, 2) + struct.pack("<IIII", 0, 0, 4, len(small))
    at_link = len(inodes)
    inodes += base(3, 0o777, 3) + struct.pack("<II", 1, 3) + b"big"

    def listing(rows):
        out = struct.pack("<III", len(rows) - 1, 0, 1)
        for off, kind, name in rows:
            out += struct.pack("<HhHH", off, 0, kind, len(name) - 1) + name
        return out

    sub = listing([(0, 2, b"big"), (at_link, 3, b"link")])
    at_sub = len(inodes)
    inodes += base(1, 0o755, 4) + struct.pack("<IIHHI", 0, 2, len(sub) + 3, 0, 5)
    top = listing([(at_sub, 1, b"dir"), (at_small, 2, b"leaf.txt")])
    at_root = len(inodes)
    inodes += base(1, 0o755, 5) + struct.pack("<IIHHI", 0, 2, len(top) + 3, len(sub), 6)
    inode_at = len(blocks)
    out = blocks + meta(inodes)
    dir_at = len(out)
    out += meta(sub + top)
    frag_meta = len(out)
    out += meta(struct.pack("<QII", 96 + len(first), len(fragment) | 0x1000000, 0))
    frag_at = len(out)
    out += struct.pack("<Q", frag_meta)
    head = struct.pack("<IIIIIHHHHHHQQQQQQQQ", 0x73717368, 5, 0, block, 1, comp, 12, 0, 1, 4, 0, at_root, len(out), 0, 0, inode_at, dir_at, frag_at, 0)
    return head + out[96:], big, small


def test_squashfs():
    import zstandard

    for pack, comp in ((zlib.compress, 1), (zstandard.compress, 6)):
        data, big, small = squashfs_bytes(pack, comp)
        got = {e.name: e for e in discs.squashfs(data)}
        assert set(got) == {"dir/", "dir/big", "dir/link", "leaf.txt"} and got["dir/link"].link_target == "big"
        assert got["dir/big"].content == big and got["leaf.txt"].content == small and got["leaf.txt"].mode == 0o600


def dmg_bytes():
    import bz2
    import plistlib

    body = PAYLOAD["bin/random.bin"]
    chunks, runs = b"", b""
    for i, (kind, part) in enumerate(((0x80000005, zlib.compress(body[:1024])), (1, body[1024:2048]), (0x80000006, bz2.compress(body[2048:3072])), (2, b""), (0xFFFFFFFF, b""))):
        runs += struct.pack(">IIQQQQ", kind, 0, 2 * i, 2 if kind != 0xFFFFFFFF else 0, len(chunks), len(part))
        chunks += part
    table = struct.pack(">IIQQQ", 0x6D697368, 1, 0, 8, 0) + b"\0" * 168 + struct.pack(">I", 5) + runs
    plist = plistlib.dumps({"resource-fork": {"blkx": [{"Name": "disk image (Apple_HFS : 1)", "Data": table}]}})
    koly = bytearray(512)
    koly[:12] = b"koly\0\0\0\4\0\0\2\0"
    struct.pack_into(">QQ", koly, 216, len(chunks), len(plist))
    return chunks + plist + bytes(koly), body[:3072] + b"\0" * 1024


def test_dmg():
    data, body = dmg_bytes()
    (e,) = discs.dmg(data)
    assert (e.name, e.content, e.method) == ("0_disk image.img", body, "bzip2+raw+zlib")
    with pytest.raises(Encrypted):
        list(discs.dmg(b"encrcdsa" + b"\0" * 600))
    assert discs._adc(b"\x83abcd" + b"\x04\x03") == b"abcdabcd"


def test_lzh_block():
    """One block: single-symbol codes for lengths and distances, literals with codes of 8 bits."""
    text = b"hello lzh"
    # symbol 10 (a literal's code of 8 bits) is the only one: said by a count of 0 and the symbol itself
    bits = format(len(text), "016b") + "00000" + format(10, "05b") + format(256, "09b") + "0000" + "0000" + "".join(format(c, "08b") for c in text)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert windows.lzh(raw, len(text), 13) == text
