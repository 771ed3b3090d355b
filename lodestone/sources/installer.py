"""Windows Installer packages as relations: their tables, and the files that they install."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relational
from ..shipping import ship
from . import windows
from .base import ArchiveError

TABLE = "package string, table string, row_index int, values map<string, string>, error string"


def read_tables(files: DataFrame) -> DataFrame:
    """Rows of all tables of packages given as (path, content) rows; values as text by column name."""
    ship(files.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    for name, table in windows.msi_tables(bytes(content or b"")).items():
                        rows += [(path, name, i, {k: None if v is None else str(v) for k, v in r.items()}, None) for i, r in enumerate(table)]
                except (ArchiveError, ValueError, IndexError, LookupError) as e:
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(("package", "table", "row_index", "values", "error"))})

    return files.select("path", "content").mapInPandas(run, TABLE)


def installed(tables: DataFrame) -> DataFrame:
    """The file tree of each package: package, file, install_path, size, sequence, cabinet."""

    def of(table: str, **columns) -> DataFrame:
        return tables.where(F.col("table") == table).select("package", *[F.col("values")[c].cast(t).alias(n) for n, (c, t) in columns.items()])

    file = of("File", file=("File", "string"), component=("Component_", "string"), name=("FileName", "string"), size=("FileSize", "long"), sequence=("Sequence", "long"))
    component = of("Component", component=("Component", "string"), directory=("Directory_", "string"))
    directory = of("Directory", directory=("Directory", "string"), parent=("Directory_Parent", "string"), name=("DefaultDir", "string"))
    # "target:source", each "short|long"; "." is the parent itself
    name = F.substring_index(F.substring_index("name", ":", 1), "|", -1)
    media = of("Media", last_sequence=("LastSequence", "long"), cabinet=("Cabinet", "string"))
    out = relational.installed_files(file, component, directory.withColumn("name", name), media)
    return out.withColumn("install_path", F.regexp_replace("install_path", r"/(\./)+", "/"))
