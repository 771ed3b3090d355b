"""Entry names as paths that are safe to write, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names that can't be file names.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]


def normal_name(name: Column) -> Column:
    """Forward slashes, no leading ``./``."""
    return F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def safe_component(part: Column) -> Column:
    """One path component: illegal characters become ``_``, outer spaces go, so does a final dot (to ``_``); an empty
    one is ``_empty_``; a reserved device name, whatever its extension, is put between ``_``."""
    clean = F.trim(F.regexp_replace(part, r'[<>:"|?*\x00-\x1F]', "_"))
    clean = F.regexp_replace(clean, r"\.$", "_")
    clean = F.when(clean == "", F.lit("_empty_")).otherwise(clean)
    stem = F.regexp_replace(clean, r"\.[^.]*$", "")
    return F.when(F.upper(stem).isin(RESERVED), F.concat(F.lit("_"), clean, F.lit("_"))).otherwise(clean)


def safe_path(name: Column) -> Column:
    """A relative path below any folder that it is joined to."""
    parts = F.filter(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(F.transform(parts, safe_component), "/")


def numbered(path: Column, n: Column, pattern: str = "_%d") -> Column:
    """The path with a suffix before its extension for the second and later copies. A dot that begins a file's name
    begins no extension."""
    ext = F.regexp_extract(path, r"(?s)^.*[^/](\.[^./]*)$", 1)
    stem = F.substr(path, F.lit(1), F.length(path) - F.length(ext))
    return F.when(n <= 1, path).otherwise(F.concat(stem, F.format_string(pattern, n), ext))


def with_number(path: str, suffix: str) -> str:
    """A path with a suffix before its extension, as ``numbered`` puts it."""
    dot, slash = path.rfind("."), path.rfind("/")
    return path[:dot] + suffix + path[dot:] if dot > slash + 1 else path + suffix
