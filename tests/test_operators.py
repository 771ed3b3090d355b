"""Detection, paths, identification, carving, recovery, writing, the stream watcher and the command line."""

import gzip
import io
import lzma
import random
import struct
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import codecs, formats, paths
from lodestone.operators import carve, identify, recover, relational, write
from lodestone.sources import registry
from lodestone.sources.base import Unsupported
from tests.test_sources import FILES, PAYLOAD, iso_bytes, rar5

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 7, 9, 8, 2, 0, 0, 0) + b"\0\0\0\0" + struct.pack(">I4s", 0, b"IEND") + b"\xae\x42\x60\x82"


def files_df(spark, files):
    return spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, c in files], "path string, content binary")


def test_detection_by_content_and_name(spark):
    cases = {
        "a.zip": write.zip_bytes(FILES), "b.tar": write.tar_bytes(FILES), "c.7z": write.WRITERS["SEVEN_Z"](FILES), "d.iso": iso_bytes(), "e.rar": rar5(),
        "f.tgz": gzip.compress(write.tar_bytes(FILES)), "g.gz": gzip.compress(b"x"), "h.exe": b"MZ" + b"\0" * 100, "i.dmg": b"\0" * 600 + b"koly\0\0\0\4\0\0\2\0" + b"\0" * 500,
        "j.lzma": codecs.compress("LZMA", b"x"), "k.unknown": b"plain text", "l.adf": (b"DOS\1" + b"\0" * 901116),
    }
    df = files_df(spark, cases.items())
    got = {r["path"]: r["f"] for r in df.select("path", formats.detect(F.col("content"), F.col("path")).alias("f")).collect()}
    assert got == {
        "a.zip": "ZIP", "b.tar": "TAR", "c.7z": "SEVEN_Z", "d.iso": "ISO", "e.rar": "RAR", "f.tgz": "TAR_GZ", "g.gz": "GZIP", "h.exe": "SFX", "i.dmg": "DMG", "j.lzma": "LZMA", "k.unknown": "UNKNOWN", "l.adf": "ADF",
    }


@pytest.mark.parametrize(
    "name,safe",
    [("a/b.txt", "a/b.txt"), ("..\\x", "._/x"), ("./a/./b", "a/b"), ("AUX.txt", "_AUX.txt_"), ("con", "_con_"), ("a...", "a.._"), (" x ", "x"), ("a/ /b", "a/_empty_/b"), ('a<b>:"|?*', "a_b______"), ("com1.tar.gz", "com1.tar.gz"), ("nul.a", "_nul.a_")],
)
def test_safe_path(spark, name, safe):
    assert spark.range(1).select(paths.safe_path(F.lit(name))).first()[0] == safe


def test_numbered_and_normal_names(spark):
    row = spark.range(1).select(paths.numbered(F.lit("d.x/a.txt"), F.lit(2)), paths.numbered(F.lit("d.x/a"), F.lit(3)), paths.normal_name(F.lit(".\\./a\\b"))).first()
    assert tuple(row) == ("d.x/a_2.txt", "d.x/a_3", "a/b")


def test_identification(spark):
    elf = b"\x7fELF\x02\x01\x01" + b"\0" * 9 + struct.pack("<HH", 2, 62) + b"\0" * 40
    pe = bytearray(400)
    pe[:2], pe[60:64], pe[128:132] = b"MZ", struct.pack("<I", 128), b"PE\0\0"
    pe[132:152] = struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, 240, 0x22)
    pe[152:154], pe[152 + 68 : 152 + 70] = struct.pack("<H", 0x20B), struct.pack("<H", 3)
    sqlite = b"SQLite format 3\0" + struct.pack(">H", 4096) + b"\0" * 42 + struct.pack(">I", 7) + b"\0" * 36
    cases = {"a.png": PNG, "b": elf, "c.exe": bytes(pe), "d.db": sqlite, "e.pdf": b"%PDF-1.7\n", "f.zip": write.zip_bytes([("word/document.xml", b"x", 0)]), "g.txt": "﻿text".encode(), "h": b"nothing known", "i.com": b"MZ" + b"\0" * 80, "j.pak": write.pak_bytes(FILES)}
    got = {r["path"]: r for r in identify.identify(files_df(spark, cases.items())).collect()}
    kinds = {k: (r["category"], r["type"]) for k, r in got.items()}
    assert kinds == {
        "a.png": ("image", "PNG"), "b": ("executable", "ELF"), "c.exe": ("executable", "PE"), "d.db": ("database", "SQLite"), "e.pdf": ("document", "PDF"), "f.zip": ("document", "DOCX"),
        "g.txt": ("document", "Text"), "h": ("data", "unknown"), "i.com": ("executable", "MZ"), "j.pak": ("archive", "Quake PAK"),
    }
    assert {d["key"]: d["value"] for d in got["a.png"]["details"]} == {"width": "7", "height": "9", "depth": "8"}
    assert got["h"]["confidence"] == 0 and got["i.com"]["confidence"] == 60 and got["e.pdf"]["version"] == "1.7"
    assert {d["key"]: d["value"] for d in got["c.exe"]["details"]}["subsystem"] == "console"


def test_carving_tiles(spark):
    parts = [PNG, b"?" * 33, write.zip_bytes(FILES), b"\0" * 64, gzip.compress(b"x" * 5000), codecs.compress("XZ", b"y" * 900), write.WRITERS["SEVEN_Z"](FILES), rar5(), write.WRITERS["CAB"](FILES), b"GIF89a\1\0\1\0\0\0\0\x3b", b"RIFF\4\0\0\0WAVE", b"%PDF-1.4 x %%EOF\n"]
    got = carve.pieces(b"".join(parts))
    assert [p["type"] for p in got] == ["png", "unknown", "zip", "padding", "gzip", "xz", "7z", "rar", "cab", "gif", "riff", "pdf"]
    assert [p["length"] for p in got] == [len(p) for p in parts] and not any(p["truncated"] for p in got)
    cut = carve.pieces(b"".join(parts[:3])[:-200])
    assert cut[-1]["truncated"] and sum(p["length"] for p in cut) == len(b"".join(parts[:3])) - 200
    df = carve.carve(files_df(spark, [("f", b"".join(parts)), ("empty", b""), ("null", None)]))
    assert relational.gaps(df).count() == 0
    assert carve.piece_names(df).where("piece_index = 2").first()["file_name"].startswith("003_0x")


def test_carving_any_bytes_tiles():
    import random

    rng = random.Random(3)
    for _ in range(150):
        data = b"".join(rng.choice([k[0] for k in carve.KINDS] + [bytes([rng.randrange(256)] * rng.randrange(9)), rng.randbytes(40)]) for _ in range(rng.randrange(1, 20)))
        at = 0
        for p in carve.pieces(data):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == len(data)


def recovered(kind, data):
    return {n: (s, c) for n, s, c, _, _ in recover.recover_one("a.bin", kind, data)}


def test_zip_recovery():
    data = write.zip_bytes(FILES)
    assert {n: s for n, (s, _) in recovered("ZIP", data).items()} == dict.fromkeys(PAYLOAD, "OK")
    half = recovered("ZIP", data[: data.find(b"docs/notes.txt") + 600])
    assert half["docs/notes.txt"][0] == "PARTIAL" and PAYLOAD["docs/notes.txt"].startswith(half["docs/notes.txt"][1])
    bad = write.zip_bytes(FILES, store=True).replace(b"leaf\n", b"leaF\n")
    assert recovered("ZIP", bad)["deep/a/b/c/leaf.txt"][0] == "BAD_CHECKSUM"


def test_tar_recovery_resyncs():
    data = bytearray(write.tar_bytes(FILES))
    first = data.find(b"docs/empty.txt")
    data[first : first + 300] = b"\xff" * 300
    got = recovered("TAR", bytes(data))
    assert "docs/empty.txt" not in got and got["bin/random.bin"][1] == PAYLOAD["bin/random.bin"] and got["deep/a/b/c/leaf.txt"][1] == b"leaf\n"
    assert recovered("TAR", bytes(write.tar_bytes(FILES)[:2560]))["docs/notes.txt"][0] == "PARTIAL"


@pytest.mark.parametrize("kind", [tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_tar_recovery_keeps_long_names(kind):
    names = ["d/" * 60 + x for x in ("one.txt", "two.txt")] + ["ü" * 70, "short.txt"]
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=kind) as t:
        for i, n in enumerate(names):
            info = tarfile.TarInfo(n)
            info.size = 700 + i
            t.addfile(info, io.BytesIO(bytes([65 + i]) * info.size))
    got = [(n, c) for n, s, c, _, _ in recover.recover_one("a.tar", "TAR", out.getvalue())]
    assert got == [(n, bytes([65 + i]) * (700 + i)) for i, n in enumerate(names)]


def v7_tar(files):
    out = b""
    for name, body in files:
        h = bytearray(name.encode().ljust(100, b"\0") + b"0000644\0" + b"0000000\0" * 2 + b"%011o\0" % len(body) + b"00000000000\0" + b" " * 8 + b"0").ljust(512, b"\0")
        h[148:156] = b"%06o\0 " % sum(h)
        out += bytes(h) + body + bytes(-len(body) % 512)
    return out


def test_v7_tar_recovery_resyncs():
    files = [(f"f{i}", b"body %d" % i * 200) for i in range(5)]
    data = bytearray(v7_tar(files))
    size = len(data) // 5
    data[size + 20 : size + 60] = b"\xff" * 40
    # a ustar archive after it doesn't hide the headers between
    for tail in (b"", write.tar_bytes([("last", b"x", 0)])):
        got = {n: c for n, _, c, _, _ in recover.recover_one("a.tar", "TAR", bytes(data) + tail)}
        assert got == {n: c for n, c in files if n != "f1"} | ({"last": b"x"} if tail else {})


def test_stream_recovery():
    import bz2
    import random

    body = bytes(random.Random(1).choices(b"abcdefgh \n", k=300_000))
    packed = bytearray(bz2.compress(body, 1))
    packed[len(packed) // 2] ^= 0xFF
    ((status, got),) = recovered("BZIP2", bytes(packed)).values()
    assert status == "PARTIAL" and 100_000 < len(got) < 300_000
    ((status, got),) = recovered("GZIP", gzip.compress(body)[:-5000]).values()
    assert status == "PARTIAL" and body.startswith(got) and len(got) > 200_000
    assert recovered("TAR_GZ", gzip.compress(write.tar_bytes(FILES)))["deep/a/b/c/leaf.txt"][1] == b"leaf\n"


@pytest.mark.parametrize("codec", ["GZIP", "ZSTD", "XZ", "LZMA", "LZ4", "BROTLI", "SNAPPY", "LZIP", "LZOP"])
def test_streams_are_kept_up_to_the_damage(codec):
    g = random.Random(3)
    body = b"".join(b"line %d of the text, %r\n" % (i, g.random()) for i in range(20_000))
    if codec == "LZOP":
        cut = [body[i : i + 50_000] for i in range(0, len(body), 50_000)]
        packed = b"\x89LZO\0\r\n\x1a\n" + struct.pack(">HHHBBIIIIB", 0x1030, 0x2080, 0x940, 1, 5, 0, 0, 0, 0, 0) + bytes(4) + b"".join(struct.pack(">II", len(x), len(x)) + x for x in cut) + bytes(4)
    else:
        packed = codecs.compress(codec, body)
    assert codecs.partial(codec, packed) == (body, True)
    got, whole = codecs.partial(codec, packed[: len(packed) * 3 // 4])
    assert not whole and len(got) > len(body) // 2 and body.startswith(got)
    if codec not in ("LZMA", "LZOP", "SNAPPY"):  # the second member or frame is damaged
        got, whole = codecs.partial(codec, packed + packed[: len(packed) * 3 // 4])
        assert not whole and len(got) > len(body) * 3 // 2 and (body + body).startswith(got)
    if codec in ("LZ4", "BROTLI"):
        tar = write.tar_bytes([(f"f{i}", body[i * 1000 : i * 1000 + 1000], 0) for i in range(500)])
        files = [f for f in recover.recover_one("a", codec, codecs.compress(codec, tar)[:-50_000]) if f[1] == "UNVERIFIED"]
        assert len(files) > 50 and files[9][2] == body[9000:10000]


def test_xz_blocks_after_the_damage():
    parts = [random.Random(i).randbytes(40_000) for i in range(3)]
    packed = [lzma.compress(x) for x in parts]
    # one stream of three blocks: the blocks' bytes, and an index of all
    blocks, records = b"", b""
    for x, raw in zip(packed, parts):
        size = 4 * (int.from_bytes(x[-8:-4], "little") + 1)
        index = x[-12 - size : -12]
        n, at = codecs._varint(index, 2)
        blocks += x[12 : 12 - (-n // 4) * 4]
        records += index[2 : codecs._varint(index, at)[1]]
    index = b"\0\3" + records
    index += bytes(-len(index) % 4)
    index += struct.pack("<I", zlib.crc32(index))
    tail = struct.pack("<I", len(index) // 4 - 1) + packed[0][6:8]
    stream = packed[0][:12] + blocks + index + struct.pack("<I", zlib.crc32(tail)) + tail + b"YZ"
    assert codecs.partial("XZ", stream) == (b"".join(parts), True)
    bad = bytearray(stream)
    bad[60_000:60_100] = bytes(100)
    got, whole = codecs.partial("XZ", bytes(bad))
    assert not whole and got.startswith(parts[0]) and got.endswith(parts[2])


def test_recovery_of_anything_else_never_fails(spark):
    df = recover.recover(files_df(spark, [("a.7z", write.WRITERS["SEVEN_Z"](FILES)), ("b.rar", b"Rar!\x1a\x07\0xx"), ("c", b""), ("d", None), ("e.7z", write.WRITERS["SEVEN_Z"](FILES)[:-40])]))
    s = {r["archive_path"]: r for r in recover.summary(df).collect()}
    assert s["a.7z"]["ok"] == 3 and s["a.7z"]["unverified"] == 1 and s["e.7z"]["lost"] == 1 and s["c"]["lost"] == 1


def test_entries_of_bad_and_good_archives(spark):
    df = files_df(spark, [("a.zip", write.zip_bytes(FILES)), ("b.zip", write.zip_bytes(FILES)[:100]), ("c.bin", None), ("d.pak", write.pak_bytes(FILES))])
    rows = registry.read_entries(df).collect()
    by = {p: [r for r in rows if r["archive_path"] == p] for p in ("a.zip", "b.zip", "c.bin", "d.pak")}
    assert [r["entry_index"] for r in by["a.zip"]] == [0, 1, 2, 3] and all(r["error"] is None for r in by["a.zip"])
    assert by["b.zip"][0]["error"]["class"] == "Corrupted" and by["c.bin"][0]["error"]["class"] == "Corrupted"
    assert {r["name"]: bytes(r["content"]) for r in by["d.pak"]} == PAYLOAD
    with pytest.raises(Exception, match="Corrupted"):
        registry.read_entries(df, failfast=True).collect()


def test_files_volumes_and_extraction(spark, tmp_path):
    data = write.WRITERS["SEVEN_Z"](FILES)
    (tmp_path / "in").mkdir()
    for i in range(0, len(data), 2000):
        (tmp_path / "in" / f"v.7z.{i // 2000 + 1:03d}").write_bytes(data[i : i + 2000])
    (tmp_path / "in" / "z.zip").write_bytes(write.zip_bytes([("../evil.txt", b"x", 0), ("ok.txt", b"one", 0), ("./ok.txt", b"two", 0)]))
    entries = registry.read_files(spark, str(tmp_path / "in" / "*"))
    out = write.extract_to(entries, str(tmp_path / "out")).collect()
    assert not any(r["error"] for r in out)
    assert (tmp_path / "out/ok.txt").read_bytes() == b"two" and (tmp_path / "out/._/evil.txt").exists() and not (tmp_path / "evil.txt").exists()
    assert (tmp_path / "out/docs/notes.txt").read_bytes() == PAYLOAD["docs/notes.txt"]
    v = registry.volume_totals(spark.read.format("binaryFile").load(str(tmp_path / "in" / "*"))).first()
    assert v["total_bytes"] == len(data) and v["volumes"] == -(-len(data) // 2000)


def test_watcher(spark, tmp_path):
    from lodestone.streaming.watch import watch

    (tmp_path / "a.zip").write_bytes(write.zip_bytes(FILES))
    q = watch(spark, str(tmp_path)).select("name").writeStream.format("memory").queryName("seen").start()
    try:
        q.processAllAvailable()
        (tmp_path / "b.tar").write_bytes(write.tar_bytes(FILES))
        q.processAllAvailable()
        assert spark.sql("select count(*) from seen").first()[0] == 8
    finally:
        q.stop()


def test_writer_selection():
    assert write.writer_for("x.tar.gz") == "TAR_GZ" and write.writer_for("x.gz") == "GZIP" and write.writer_for("a.pak") == "PAK"
    with pytest.raises(Unsupported):
        write.writer_for("x.rar")


def test_command_line(spark, tmp_path, capsys):
    from lodestone.__main__ import main

    (tmp_path / "a.zip").write_bytes(write.zip_bytes(FILES))
    assert main(["l", str(tmp_path / "a.zip")]) == 0 and main(["version"]) == 0 and main(["l"]) == 1 and main(["nonsense"]) == 1
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04")
    assert main(["l", str(tmp_path / "bad.zip")]) == 2
    assert main(["x", str(tmp_path / "a.zip"), "-o", str(tmp_path / "out")]) == 0 and (tmp_path / "out/deep/a/b/c/leaf.txt").exists()
    capsys.readouterr()


def test_media_without_a_cabinet(spark):
    files = spark.createDataFrame([("p", "a", 5), ("p", "b", None), ("p", "c", 99), ("q", "d", 1)], "package string, file string, sequence long")
    media = spark.createDataFrame([("p", 10, "one"), ("p", None, "none")], "package string, last_sequence long, cabinet string")
    assert {r["file"]: r["cabinet"] for r in relational.media_of(files, media).collect()} == {"a": "one", "b": None, "c": None, "d": None}


def test_directory_loops_end(spark):
    d = spark.createDataFrame([("p", "a", None, "A"), ("p", "b", "a", "B"), ("p", "x", "y", "X"), ("p", "y", "x", "Y"), ("p", "r", "r", "R")], "package string, directory string, parent string, name string")
    assert {r["directory"]: r["path"] for r in relational.directory_paths(d).collect()} == {"a": "A", "b": "A/B", "r": "R"}


def test_golden_texts(spark):
    from lodestone.operators import golden

    df = files_df(spark, [("a.zip", write.zip_bytes([("empty-dir", None, 0), *FILES])), ("b.zip", b"PK")])
    e = registry.read_entries(df)
    listed = {r["archive_path"]: r["list"] for r in golden.listing(e).collect()}
    assert listed["a.zip"].split("\n") == ["list: 5 entries", "  bin/random.bin 4096", "  deep/a/b/c/leaf.txt 5", "  docs/empty.txt 0", "  docs/notes.txt 29490", "  empty-dir/ (folder)"]
    assert listed["b.zip"].startswith("list: ERROR Corrupted: ")
    texts = {r["archive_path"]: r["extracted"] for r in golden.contents(e).collect()}
    assert texts["a.zip"].split("\n")[0] == "extracted: 4 items" and "  deep/a/b/c/leaf.txt 5 26d0bac9f0c7a35b2f3322a0f4ad4517265f56b2c0f4b2ed7cb5cbd30c5868e2" in texts["a.zip"]
    rep = golden.report(recover.recover(df)).where("archive_path = 'a.zip'").first()["report"]
    assert rep.split("\n")[0] == "OK           docs/notes.txt (29490 of 29490 bytes)"


def test_pieces_are_written(spark, tmp_path):
    data = PNG + b"\0" * 16 + gzip.compress(b"x")
    got = carve.split_to(files_df(spark, [("dir/f.bin", data)]), str(tmp_path)).collect()
    assert [r["file_name"] for r in got] == ["001_0x00000000.png", f"002_0x{len(PNG) + 16:08X}.gz"]
    assert (tmp_path / "f.bin.pieces" / "001_0x00000000.png").read_bytes() == PNG


def test_suffixes_are_free_and_diffs_are_sets(spark):
    rows = [("a.txt", 0), ("a_2.txt", 1), ("a.txt", 2), (".hidden", 3), (".hidden", 4), ("d/a.txt", 5), ("A.TXT", 6), ("a.txt", 7), (None, 8)]
    df = spark.createDataFrame([("z", *r) for r in rows] + [("y", "a.txt", 0)], "archive_path string, safe_path string, entry_index long")
    got = {(r["archive_path"], r["entry_index"]): r["unique_path"] for r in relational.suffixed(df).collect()}
    assert [got["z", i] for i in range(9)] == ["a.txt", "a_2.txt", "a_3.txt", ".hidden", ".hidden_2", "d/a.txt", "A.TXT", "a_4.txt", None] and got["y", 0] == "a.txt"
    folded = {r["entry_index"]: r["unique_path"] for r in relational.suffixed(df.where("archive_path = 'z'"), pattern=" (%d)", ignore_case=True).collect()}
    assert folded[2] == "a (2).txt" and folded[6] == "A (3).TXT" and folded[7] == "a (4).txt"
    x = spark.createDataFrame([("x",), ("x",), ("y",), ("w",), ("w",)], "k string")
    y = spark.createDataFrame([("x",), ("y",), ("v",)], "k string")
    assert sorted(tuple(r) for r in relational.golden_diff(x, y).collect()) == [("v", "actual"), ("w", "expected")]


def test_carving_ole_by_its_chain_and_large_rar():
    import struct

    from lodestone.operators import carve

    size, per = 512, 128
    n_fat, own = 120, 127  # 109 places in the header, 11 in one further sector
    sectors = [struct.pack("<128I", *[0xFFFFFFFD] * per) for _ in range(n_fat)]
    used = n_fat + 1 + 50
    table = [1] * used + [0xFFFFFFFF] * (n_fat * per - used)
    sectors = [struct.pack("<128I", *table[i * per : (i + 1) * per]) for i in range(n_fat)]
    chain = struct.pack("<128I", *range(109, n_fat), *[0xFFFFFFFF] * (own - 11), 0xFFFFFFFE)
    head = bytearray(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 504)
    struct.pack_into("<H", head, 30, 9)
    struct.pack_into("<I", head, 44, n_fat)
    struct.pack_into("<II", head, 68, n_fat, 1)
    struct.pack_into("<109I", head, 76, *range(109))
    data = bytes(head) + b"".join(sectors) + chain + b"\1" * 50 * size + b"tail"
    assert carve._ole(b"xx" + data, 2) == (used + 1) * size
    entry = struct.pack("<HBHH", 0, 0x74, 0x8100, 40) + struct.pack("<II", 5, 5) + b"\0" * 17 + struct.pack("<I", 1) + b"\0" * 4
    rar = b"Rar!\x1a\x07\0" + struct.pack("<HBHH", 0, 0x73, 0, 13) + b"\0" * 6 + entry
    assert carve._rar4(rar, 0) == carve.MORE and len(entry) == 40  # the entry goes on for 4 GB


def test_recovery_takes_time_in_proportion():
    import bz2
    import io
    import random
    import time
    import zipfile

    from lodestone.operators import recover

    def zipped(n):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i in range(n):
                z.writestr(f"n{i}.txt", f"text {i}" * 5)
        return out.getvalue()

    began = time.time()
    assert [x[1] for x in recover.zip_files(zipped(20_000))] == ["OK"] * 20_000 and time.time() - began < 10
    text = bytes(random.Random(1).choices(b"abcdefgh \n", k=600_000))
    packed = bytearray(bz2.compress(text, 1))
    assert b"".join(recover.bzip2_blocks(bytes(packed))) == text
    packed[len(packed) // 2] ^= 255
    blocks = list(recover.bzip2_blocks(bytes(packed)))
    assert blocks.count(None) == 1 and text.startswith(blocks[0]) and text.endswith(blocks[-1])
