"""Installer databases, built here as compound files."""

import struct

from lodestone.sources import installer, registry, windows

ALPHABET = windows._MSI


def stream_name(name):
    """Two characters to a code point, after the mark of a table."""
    out, i = "䡀", 0
    while i < len(name):
        a = ALPHABET.index(name[i])
        if i + 1 < len(name):
            out += chr(0x3800 + a + (ALPHABET.index(name[i + 1]) << 6))
            i += 2
        else:
            out += chr(0x4800 + a)
            i += 1
    return out


def compound(streams):
    """A compound file without small streams."""
    fat, body, entries = [0xFFFFFFFD], b"", []

    def put(data):
        nonlocal body
        if not data:
            return 0xFFFFFFFE
        first, n = len(fat), -(-len(data) // 512)
        fat.extend([*range(first + 1, first + n), 0xFFFFFFFE])
        body += data.ljust(n * 512, b"\0")
        return first

    for i, (name, data) in enumerate(streams.items()):
        raw = (name + "\0").encode("utf-16-le")
        right = i + 2 if i + 1 < len(streams) else 0xFFFFFFFF
        entries.append(raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), 2, 1, 0xFFFFFFFF, right, 0xFFFFFFFF) + b"\0" * 36 + struct.pack("<IQ", put(data), len(data)))
    root = "Root Entry\0".encode("utf-16-le")
    root = root.ljust(64, b"\0") + struct.pack("<HBBIII", len(root), 5, 1, 0xFFFFFFFF, 0xFFFFFFFF, 1) + b"\0" * 36 + struct.pack("<IQ", 0xFFFFFFFE, 0)
    directory = put(root + b"".join(entries))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, 1, directory, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + struct.pack("<128I", *fat, *[0xFFFFFFFF] * (128 - len(fat))) + body


TABLES = {
    "Component": ([("Component", "s"), ("Directory_", "s")], [("C1", "BIN"), ("C2", "ROOT")]),
    "Directory": ([("Directory", "s"), ("Directory_Parent", "s"), ("DefaultDir", "s")], [("ROOT", None, "SourceDir"), ("APP", "ROOT", "App:src"), ("BIN", "APP", "B~1|binaries")]),
    "File": ([("File", "s"), ("Component_", "s"), ("FileName", "s"), ("FileSize", "i"), ("Sequence", "h")], [("f1", "C1", "A~1.EXE|a long name.exe", 70000, 1), ("f2", "C2", "b.txt", 5, 3), ("f3", "C1", "c.txt", 0, 9)]),
    "Media": ([("LastSequence", "h"), ("Cabinet", "s")], [(2, "one.cab"), (5, "two.cab")]),
}


def msi():
    strings = [""]

    def ref(s):
        if s is None:
            return 0
        if s not in strings:
            strings.append(s)
        return strings.index(s)

    pack = lambda kind, v: struct.pack("<H", ref(v)) if kind == "s" else struct.pack("<H", v ^ 0x8000) if kind == "h" else struct.pack("<I", v ^ 0x80000000)
    streams, schema = {}, []
    for table, (columns, rows) in TABLES.items():
        schema += [(table, i + 1, c, {"s": 0xD48, "h": 0x502, "i": 0x104}[k]) for i, (c, k) in enumerate(columns)]
        streams[stream_name(table)] = b"".join(pack(k, r[i]) for i, (_, k) in enumerate(columns) for r in rows)
    streams[stream_name("_Columns")] = b"".join(pack(k, r[i]) for i, k in enumerate("shsh") for r in schema)
    streams[stream_name("_StringPool")] = struct.pack("<HH", 65001, 0) + b"".join(struct.pack("<HH", len(s.encode()), 1) for s in strings[1:])
    streams[stream_name("_StringData")] = "".join(strings).encode()
    return compound(streams)


def test_tables_come_from_their_own_schema():
    got = windows.msi_tables(msi())
    assert {t: [tuple(r.values()) for r in rows] for t, rows in got.items()} == {t: rows for t, (_, rows) in TABLES.items()}


def test_streams_of_the_compound_file():
    names = {e.name for e in registry.parse(msi(), "OLE", "x.msi")}
    assert {"File", "_Columns", "_StringPool"} <= names


def test_installed_files(spark):
    files = spark.createDataFrame([("a.msi", bytearray(msi())), ("bad.msi", bytearray(b"no")), ("null.msi", None)], "path string, content binary")
    tables = installer.read_tables(files)
    got = {r["file"]: (r["install_path"], r["size"], r["cabinet"]) for r in installer.installed(tables).collect()}
    assert got == {"f1": ("SourceDir/App/binaries/a long name.exe", 70000, "one.cab"), "f2": ("SourceDir/b.txt", 5, "two.cab"), "f3": ("SourceDir/App/binaries/c.txt", 0, None)}
    assert tables.where("error is not null").count() == 2
