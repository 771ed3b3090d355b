"""Schemas of the relations that the engine returns."""

from __future__ import annotations


class Schema(str):
    """A DDL string that knows its column names."""

    names: list[str]

    def __new__(cls, *fields: tuple[str, str]):
        out = super().__new__(cls, ", ".join(f"{n} {t}" for n, t in fields))
        out.names = [n for n, _ in fields]
        return out


#: One row per entry of an archive. Unknown values are null. ``error`` is set for an archive, or an entry, that can't
#: be read; the rows before it stay.
ENTRY = Schema(
    ("archive_path", "string"), ("entry_index", "int"), ("name", "string"), ("compressed_size", "bigint"), ("uncompressed_size", "bigint"), ("modified", "timestamp"),
    ("is_directory", "boolean"), ("is_encrypted", "boolean"), ("crc32", "bigint"), ("format", "string"), ("method", "string"), ("mode", "int"), ("link_target", "string"),
    ("comment", "string"), ("sha256", "string"), ("content", "binary"), ("error", "struct<class: string, message: string>"),
)

IDENTIFICATION = Schema(
    ("category", "string"), ("type", "string"), ("version", "string"), ("description", "string"), ("confidence", "int"), ("details", "array<struct<key: string, value: string>>"),
)

#: Pieces of a file tile it: they neither overlap nor leave gaps.
PIECE = Schema(
    ("archive_path", "string"), ("piece_index", "int"), ("offset", "bigint"), ("length", "bigint"), ("type", "string"), ("extension", "string"), ("description", "string"), ("truncated", "boolean"),
)

#: What recovery could do for one file of a damaged archive.
RECOVERED = Schema(
    ("archive_path", "string"), ("entry_index", "int"), ("name", "string"), ("status", "string"), ("bytes_written", "bigint"), ("expected_size", "bigint"), ("message", "string"), ("content", "binary"),
)
STATUSES = ["OK", "UNVERIFIED", "BAD_CHECKSUM", "PARTIAL", "LOST"]
