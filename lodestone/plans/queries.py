"""The archive engine's queries over the driver's tables, each with the SQL that gives the same rows.

The tables hold no binary columns, so archives are built from their rows, whole, and read back; the SQL computes the
expected listing directly. An archive holds the rows of one key and one block of ids, which bounds its size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats, paths
from ..operators import carve, identify, recover, relational, write
from ..sources import registry
from . import samples
from .registry import ORACLES, QUERIES, query

BLOCK = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to pack: archive, name, content."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat_ws("_", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / BLOCK).cast("string")).alias("archive"), F.format_string("doc_%d.txt", "doc_id").alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), "doc_id"
    )


DOCUMENTS_SQL = f"""SELECT coalesce(source, 'none') || '_' || CAST(CAST(floor(doc_id / {BLOCK}) AS BIGINT) AS VARCHAR) AS archive, 'doc_' || doc_id || '.txt' AS name, coalesce(text, '') AS text, doc_id FROM documents"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    return p.select(F.concat(F.lit("pages_"), F.floor(F.col("page_id") / BLOCK).cast("string")).alias("archive"), F.concat(F.lit("p"), F.col("page_id"), F.lit("/"), path, F.lit(".html")).alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("content"), "page_id")


PAGES_SQL = f"""SELECT 'pages_' || CAST(CAST(floor(page_id / {BLOCK}) AS BIGINT) AS VARCHAR) AS archive, 'p' || page_id || '/' || regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) || '.html' AS name, coalesce(html, '') AS text, page_id FROM pages"""

_LISTED = "SELECT archive, name, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256 FROM"


def _listing(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("archive_path").alias("archive"), "name", F.col("uncompressed_size").alias("size"), "sha256")


def _packed_and_read(kind: str, source):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = write.pack(source(spark, sf_dir), "archive", "name", "content", kind=kind)
        if kind == "TAR_BROTLI":  # has no mark of its own
            made = made.withColumn("format", F.lit(kind))
        return _listing(registry.read_entries(made))

    return run


query("entries_tar_documents", f"{_LISTED} ({DOCUMENTS_SQL})")(_packed_and_read("TAR", documents))
query("entries_zip_pages", f"{_LISTED} ({PAGES_SQL})")(_packed_and_read("ZIP", pages))
query("entries_7z_documents", f"{_LISTED} ({DOCUMENTS_SQL})")(_packed_and_read("SEVEN_Z", documents))
query("entries_cab_documents", f"{_LISTED} ({DOCUMENTS_SQL})")(_packed_and_read("CAB", documents))
query("entries_pak_documents", f"{_LISTED} ({DOCUMENTS_SQL})")(_packed_and_read("PAK", documents))
for _kind in ("TAR_GZ", "TAR_BZ2", "TAR_XZ", "TAR_ZSTD", "TAR_LZ4", "TAR_BROTLI", "TAR_LZIP"):
    query(f"nested_{_kind.lower()}", f"{_LISTED} ({DOCUMENTS_SQL})")(_packed_and_read(_kind, documents))


def _roundtrip(codec: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = write.decompressed(write.compressed(pages(spark, sf_dir), codec), codec, out="back")
        return out.select("page_id", F.octet_length("back").cast("long").alias("size"), F.sha2("back", 256).alias("sha256"))

    return run


for _codec in ("GZIP", "BZIP2", "XZ", "LZMA", "ZSTD", "LZ4", "BROTLI", "SNAPPY", "LZIP"):
    query(f"roundtrip_{_codec.lower()}", f"SELECT page_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256 FROM ({PAGES_SQL})")(_roundtrip(_codec))


def _read_back(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _listing(registry.read_entries(samples.packed(documents(spark, sf_dir), kind)))

    return run


for _kind in samples.ARCHIVES:
    query(f"entries_{_kind.lower()}_documents", f"{_LISTED} ({DOCUMENTS_SQL})")(_read_back(_kind))


def _unpacked(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = write.decompressed(samples.streamed(pages(spark, sf_dir), kind), kind, out="back")
        return out.select("page_id", formats.by_magic(F.col("packed")).alias("format"), F.octet_length("back").cast("long").alias("size"), F.sha2("back", 256).alias("sha256"))

    return run


for _kind in samples.STREAMS:
    query(f"unpack_{_kind.lower()}", f"SELECT page_id, '{_kind}' AS format, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256 FROM ({PAGES_SQL})")(_unpacked(_kind))


@query("list_without_content", f"SELECT archive, CAST(count(*) AS BIGINT) AS entries, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(count(*) FILTER (WHERE octet_length(encode(text)) > 2000) AS BIGINT) AS large FROM ({DOCUMENTS_SQL}) GROUP BY archive")
def list_without_content(spark, sf_dir):
    """Listing decodes nothing: counts and sums by archive, a filter on sizes."""
    e = registry.read_entries(write.pack(documents(spark, sf_dir), "archive", "name", "content", kind="ZIP"), want_content=False)
    return e.groupBy(F.col("archive_path").alias("archive")).agg(F.count("*").alias("entries"), F.sum("uncompressed_size").alias("bytes"), F.count_if(F.col("uncompressed_size") > 2000).alias("large"))


_EXTS = ["zip", "tar.gz", "TGZ", "tar", "7z", "rar", "gz", "bz2", "xz", "zst", "tar.zst", "lz4", "br", "deb", "rpm", "iso", "dmg", "cab", "docx", "epub", "msi", "txt", "lzma", "Z"]
_KINDS = ["ZIP", "TAR_GZ", "TAR_GZ", "TAR", "SEVEN_Z", "RAR", "GZIP", "BZIP2", "XZ", "ZSTD", "TAR_ZSTD", "LZ4", "BROTLI", "AR", "RPM", "ISO", "DMG", "CAB", "ZIP", "ZIP", "OLE", None, "LZMA", "Z"]


@query(
    "detect_by_extension",
    "SELECT doc_id, CASE doc_id % " + str(len(_EXTS)) + " " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS) if k) + " END AS format FROM documents",
)
def detect_by_extension(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXTS]), (F.col("doc_id") % len(_EXTS)).cast("int") + 1)
    return table(spark, sf_dir, "documents").select("doc_id", formats.by_extension(F.concat(F.lit("a.b/doc_"), F.col("doc_id"), F.lit("."), ext)).alias("format"))


_MADE = ["GZIP", "BZIP2", "XZ", "ZSTD", "LZ4", "SNAPPY", "LZIP"]


def _made(spark, sf_dir):
    p = pages(spark, sf_dir)
    return reduce(lambda a, b: a.unionByName(b), [write.compressed(p.where(F.col("page_id") % len(_MADE) == i), c) for i, c in enumerate(_MADE)])


@query("detect_by_magic", "SELECT page_id, CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_MADE)) + " END AS format FROM pages")
def detect_by_magic(spark, sf_dir):
    return _made(spark, sf_dir).select("page_id", formats.detect(F.col("packed"), F.lit("data.bin")).alias("format"))


@query("detect_tar_inside", f"SELECT archive, 'TAR_GZ' AS format FROM ({DOCUMENTS_SQL}) GROUP BY archive")
def detect_tar_inside(spark, sf_dir):
    made = write.pack(documents(spark, sf_dir), "archive", "name", "content", kind="TAR_GZ")
    return made.select(F.col("path").alias("archive"), formats.detect(F.col("content"), F.concat("path", F.lit(".tgz"))).alias("format"))


@query("streams_to_entries", f"SELECT page_id, CAST(octet_length(encode(text)) AS BIGINT) AS size, sha256(text) AS sha256 FROM ({PAGES_SQL})")
def streams_to_entries(spark, sf_dir):
    """Single streams, whatever their codec, as archives of one entry."""
    made = _made(spark, sf_dir).select(F.concat(F.lit("page_"), F.col("page_id"), F.lit(".bin")).alias("path"), F.col("packed").alias("content"))
    return registry.read_entries(made).select(F.regexp_extract("archive_path", r"page_(\d+)", 1).cast("long").alias("page_id"), F.col("uncompressed_size").alias("size"), "sha256")


_RESERVED = ", ".join(f"'{r}'" for r in paths.RESERVED)


@query(
    "safe_path",
    rf"""
WITH n AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN '..\' || url || '.' WHEN 2 THEN './AUX.txt/' || url WHEN 3 THEN 'con/ x' || page_id || ' /lpt1.a.b' WHEN 4 THEN 'a//b/./' || url || '...' ELSE 'd:' || url || '/ /nul' END AS name FROM pages),
p AS (SELECT page_id, name, unnest(string_split(replace(name, '\', '/'), '/')) AS part, generate_subscripts(string_split(replace(name, '\', '/'), '/'), 1) AS i FROM n),
c AS (SELECT page_id, i, regexp_replace(trim(regexp_replace(part, '[<>:"|?*\x00-\x1F]', '_', 'g'), ' '), '\.$', '_') AS clean FROM p WHERE part <> '' AND part <> '.'),
e AS (SELECT page_id, i, CASE WHEN clean = '' THEN '_empty_' ELSE clean END AS clean FROM c),
s AS (SELECT page_id, i, CASE WHEN upper(regexp_replace(clean, '\.[^.]*$', '')) IN ({_RESERVED}) THEN '_' || clean || '_' ELSE clean END AS part FROM e)
SELECT page_id, string_agg(part, '/' ORDER BY i) AS safe_path FROM s GROUP BY page_id
""",
)
def safe_path(spark, sf_dir):
    url, pid = F.col("url"), F.col("page_id")
    name = (
        F.when(pid % 6 == 0, url).when(pid % 6 == 1, F.concat(F.lit("..\\"), url, F.lit("."))).when(pid % 6 == 2, F.concat(F.lit("./AUX.txt/"), url))
        .when(pid % 6 == 3, F.concat(F.lit("con/ x"), pid, F.lit(" /lpt1.a.b"))).when(pid % 6 == 4, F.concat(F.lit("a//b/./"), url, F.lit("..."))).otherwise(F.concat(F.lit("d:"), url, F.lit("/ /nul")))
    )
    return table(spark, sf_dir, "pages").select("page_id", paths.safe_path(name).alias("safe_path"))


def _copies(spark, sf_dir):
    """Documents as entries whose paths repeat."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.coalesce("lang", F.lit("none")).alias("archive_path"), F.concat(F.coalesce("source", F.lit("none")), F.lit("/part"), F.col("doc_id") % 50, F.lit(".txt")).alias("safe_path"), F.col("doc_id").alias("entry_index"), "n_chars")


_COPIES_SQL = "SELECT coalesce(lang, 'none') AS archive_path, coalesce(source, 'none') || '/part' || doc_id % 50 || '.txt' AS safe_path, doc_id AS entry_index, n_chars FROM documents"


@query("last_copy_wins", f"SELECT archive_path, safe_path, entry_index, n_chars FROM ({_COPIES_SQL}) QUALIFY row_number() OVER (PARTITION BY archive_path, safe_path ORDER BY entry_index DESC) = 1")
def last_copy_wins(spark, sf_dir):
    return relational.last_wins(_copies(spark, sf_dir))


def _colliding(spark, sf_dir):
    """Entries whose paths repeat, begin with a dot, or are what a copy of another would be called."""
    c = _copies(spark, sf_dir).withColumn("safe_path", F.replace("safe_path", F.lit("/part3.txt"), F.lit("/.hidden"))).select("archive_path", "safe_path", "entry_index")
    taken = c.where(F.col("safe_path").endswith("/part7.txt")).select("archive_path", F.replace("safe_path", F.lit("part7.txt"), F.lit("part7_2.txt")).alias("safe_path")).distinct()
    rank = F.row_number().over(Window.partitionBy("archive_path").orderBy("safe_path"))
    return c.unionByName(taken.withColumn("entry_index", -rank.cast("long")))


_COLLIDING_SQL = f"""
SELECT archive_path, replace(safe_path, '/part3.txt', '/.hidden') AS safe_path, entry_index FROM ({_COPIES_SQL})
UNION ALL SELECT archive_path, replace(safe_path, 'part7.txt', 'part7_2.txt'), -row_number() OVER (PARTITION BY archive_path ORDER BY replace(safe_path, 'part7.txt', 'part7_2.txt'))
FROM (SELECT DISTINCT archive_path, safe_path FROM ({_COPIES_SQL}) WHERE safe_path LIKE '%/part7.txt')"""


@query(
    "suffix_duplicates",
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY archive_path, safe_path ORDER BY entry_index) AS n FROM ({_COLLIDING_SQL}))
SELECT archive_path, entry_index, CASE WHEN n = 1 THEN safe_path WHEN safe_path LIKE '%/.hidden' THEN safe_path || '_' || n
  WHEN safe_path LIKE '%/part7.txt' THEN regexp_replace(safe_path, '\\.txt$', '') || '_' || (n + 1) || '.txt' ELSE regexp_replace(safe_path, '\\.txt$', '') || '_' || n || '.txt' END AS unique_path FROM n""",
)
def suffix_duplicates(spark, sf_dir):
    return relational.suffixed(_colliding(spark, sf_dir)).select("archive_path", "entry_index", "unique_path")


@query(
    "suffix_ignoring_case",
    f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY archive_path, lower(safe_path) ORDER BY entry_index) AS n FROM (SELECT archive_path, CASE WHEN entry_index % 2 = 0 THEN upper(safe_path) ELSE safe_path END AS safe_path, entry_index FROM ({_COPIES_SQL}))) SELECT archive_path, entry_index, CASE WHEN n = 1 THEN safe_path ELSE regexp_replace(safe_path, '\\.[^./]*$', '') || ' (' || n || ')' || regexp_extract(safe_path, '\\.[^./]*$') END AS unique_path FROM n",
)
def suffix_ignoring_case(spark, sf_dir):
    c = _copies(spark, sf_dir).withColumn("safe_path", F.when(F.col("entry_index") % 2 == 0, F.upper("safe_path")).otherwise(F.col("safe_path")))
    return relational.suffixed(c, pattern=" (%d)", ignore_case=True).select("archive_path", "entry_index", "unique_path")


@query(
    "running_limit",
    """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(floor(l_quantity) AS BIGINT) AS size, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_total FROM lineitem)
SELECT l_suppkey, running_total, running_total > 5000 OR (running_total > 1000 AND running_total // 100 > 30) AS exceeded FROM r""",
)
def running_limit(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumn("size", F.floor("l_quantity").cast("long"))
    out = relational.running_limit(t, F.col("size"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], max_total=5000, archive_size=F.lit(100), max_ratio=30, ratio_threshold=1000)
    return out.select("l_suppkey", "running_total", "exceeded")


def _installer(spark, sf_dir):
    """Installer tables out of customers (files), suppliers (components), nations and regions (directories)."""
    pkg = F.lit("setup.msi").alias("package")
    c, s, n, r = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))
    file = c.select(pkg, F.col("c_custkey").alias("file"), (F.col("c_custkey") % 100 + 1).alias("component"), F.concat(F.lit("F~1.DAT|"), F.col("c_name"), F.lit(".dat")).alias("name"), F.floor("c_acctbal").cast("long").alias("size"), F.col("c_custkey").alias("sequence"))
    component = s.select(pkg, F.col("s_suppkey").alias("component"), F.concat(F.lit("N"), F.col("s_nationkey")).alias("directory"))
    directories = r.select(pkg, F.concat(F.lit("R"), F.col("r_regionkey")).alias("directory"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name")).unionByName(
        n.select(pkg, F.concat(F.lit("N"), F.col("n_nationkey")).alias("directory"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name"))
    )
    media = r.select(pkg, ((F.col("r_regionkey") + 1) * 250).cast("long").alias("last_sequence"), F.concat(F.lit("disk"), F.col("r_regionkey"), F.lit(".cab")).alias("cabinet"))
    return file, component, directories, media


_MEDIA_SQL = "SELECT CAST((r_regionkey + 1) * 250 AS BIGINT) AS last_sequence, 'disk' || r_regionkey || '.cab' AS cabinet FROM region"


@query("range_join_media", f"SELECT o_orderkey, (SELECT arg_min(cabinet, last_sequence) FROM ({_MEDIA_SQL}) m WHERE m.last_sequence >= o.o_orderkey % 1500) AS cabinet FROM orders o")
def range_join_media(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.lit("setup.msi").alias("package"), "o_orderkey", (F.col("o_orderkey") % 1500).alias("sequence"))
    return relational.media_of(files, _installer(spark, sf_dir)[3]).select("o_orderkey", "cabinet")


_DIRS_SQL = "SELECT 'R' || r_regionkey AS directory, CAST(NULL AS VARCHAR) AS parent, r_name AS name FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM nation"
_PATHS_SQL = f"dirs AS ({_DIRS_SQL}), paths AS (SELECT directory, name AS path FROM dirs WHERE parent IS NULL UNION ALL SELECT d.directory, p.path || '/' || d.name FROM dirs d JOIN paths p ON d.parent = p.directory)"


@query("directory_paths", f"WITH RECURSIVE {_PATHS_SQL} SELECT directory, path FROM paths")
def directory_paths(spark, sf_dir):
    return relational.directory_paths(_installer(spark, sf_dir)[2]).select("directory", "path")


@query(
    "msi_file_tree",
    f"""WITH RECURSIVE {_PATHS_SQL}, media AS ({_MEDIA_SQL})
SELECT c_custkey AS file, p.path || '/' || c_name || '.dat' AS install_path, CAST(floor(c_acctbal) AS BIGINT) AS size, (SELECT arg_min(cabinet, last_sequence) FROM media m WHERE m.last_sequence >= c_custkey) AS cabinet
FROM customer JOIN supplier ON s_suppkey = c_custkey % 100 + 1 LEFT JOIN paths p ON p.directory = 'N' || s_nationkey""",
)
def msi_file_tree(spark, sf_dir):
    return relational.installed_files(*_installer(spark, sf_dir)).select("file", "install_path", "size", "cabinet")


@query(
    "listing_left_anti",
    """SELECT 'o' || o_orderkey AS name, CAST(o_custkey AS VARCHAR) AS listed, CAST(c_custkey AS VARCHAR) AS extracted, false AS extra FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) c ON 'o' || o_orderkey = 'o' || c_custkey
UNION ALL SELECT 'o' || c_custkey, NULL, CAST(c_custkey AS VARCHAR), true FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT o_orderkey FROM orders)""",
)
def listing_left_anti(spark, sf_dir):
    listing = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("name"), F.col("o_custkey").cast("string").alias("listed"))
    files = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("o"), F.col("c_custkey")).alias("name"), F.col("c_custkey").cast("string").alias("extracted"))
    return relational.listing_with_files(listing, files, "name").select("name", "listed", "extracted", "extra")


_GOLDEN_SQL = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha256(coalesce(text, '')) END AS h FROM documents WHERE doc_id % 11 <> 0"


@query("golden_diff", f"WITH a AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), b AS ({_GOLDEN_SQL}) SELECT *, 'expected' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'actual' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def golden_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    changed = d.where("doc_id % 11 <> 0").withColumn("h", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("h")))
    twice = d.unionByName(d.where("doc_id % 3 = 0"))  # sides are sets: a row that one side repeats is no difference
    return relational.golden_diff(twice, changed)


@query("identify_built", "SELECT page_id, 'archive' AS category, CASE page_id % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(["GZIP", "BZIP2", "XZ", "Zstandard", "LZ4", "Snappy", "lzip"])) + " END AS type FROM pages")
def identify_built(spark, sf_dir):
    made = _made(spark, sf_dir).select(F.concat(F.lit("p"), F.col("page_id"), F.lit(".bin")).alias("path"), F.col("packed").alias("content"))
    return identify.identify(made).select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("page_id"), "category", "type")


def _concatenated(spark, sf_dir):
    """Per block of pages: a ZIP of them, 64 zero bytes, and a gzip stream of the block's name."""
    z = write.pack(pages(spark, sf_dir), "archive", "name", "content", kind="ZIP").withColumn("tail", F.concat("path", F.lit(" end")).cast("binary"))
    z = write.compressed(z, "GZIP", "tail", "gz")
    return z.select("path", F.octet_length("content").alias("zip_bytes"), F.concat("content", F.lit(b"\0" * 64).cast("binary"), "gz").alias("content"))


@query("carve_concat", f"SELECT archive, i AS piece, CASE i WHEN 0 THEN 'zip' WHEN 1 THEN 'padding' ELSE 'gzip' END AS type, i <> 1 OR true AS at_expected_place FROM (SELECT DISTINCT archive FROM ({PAGES_SQL})), (SELECT unnest([0, 1, 2]) AS i)")
def carve_concat(spark, sf_dir):
    made = _concatenated(spark, sf_dir)
    got = carve.carve(made).join(made.select(F.col("path").alias("archive_path"), "zip_bytes"), "archive_path")
    place = F.when(F.col("piece_index") == 0, F.lit(0)).when(F.col("piece_index") == 1, F.col("zip_bytes")).otherwise(F.col("zip_bytes") + 64)
    return got.select(F.col("archive_path").alias("archive"), F.col("piece_index").alias("piece"), "type", (F.col("offset") == place).alias("at_expected_place"))


@query("pieces_tile", f"SELECT archive, true AS tiles FROM ({PAGES_SQL}) GROUP BY archive")
def pieces_tile(spark, sf_dir):
    made = _concatenated(spark, sf_dir)
    got = carve.carve(made)
    bad = relational.gaps(got).select("archive_path").distinct().withColumn("bad", F.lit(True))
    total = got.groupBy("archive_path").agg(F.sum("length").alias("n"))
    sizes = made.select(F.col("path").alias("archive_path"), F.octet_length("content").alias("size"))
    return sizes.join(total, "archive_path").join(bad, "archive_path", "left").select(F.col("archive_path").alias("archive"), (F.col("bad").isNull() & (F.col("n") == F.col("size"))).alias("tiles"))


def _damaged(spark, sf_dir):
    """Stored ZIPs in which the first byte of every tenth document's content is changed after packing."""
    marker = F.lit("@@damage@@")
    d = documents(spark, sf_dir).withColumn("content", F.when(F.col("doc_id") % 10 == 0, F.concat(marker.cast("binary"), "content")).otherwise(F.col("content")))
    z = write.pack(d, "archive", "name", "content", kind="ZIP_STORED")
    return z.select("path", F.unhex(F.replace(F.hex("content"), F.hex(marker), F.hex(F.lit("@@dAmage@@")))).alias("content"))


@query(
    "recover_status_summary",
    f"SELECT archive, CAST(count(*) FILTER (WHERE doc_id % 10 <> 0) AS BIGINT) AS ok, CAST(0 AS BIGINT) AS unverified, CAST(count(*) FILTER (WHERE doc_id % 10 = 0) AS BIGINT) AS bad_checksum, CAST(0 AS BIGINT) AS partial, CAST(0 AS BIGINT) AS lost FROM ({DOCUMENTS_SQL}) GROUP BY archive",
)
def recover_status_summary(spark, sf_dir):
    s = recover.summary(recover.recover(_damaged(spark, sf_dir)))
    return s.select(F.col("archive_path").alias("archive"), "ok", "unverified", "bad_checksum", "partial", "lost")


@query("errors_as_rows", f"SELECT archive, CAST(count(*) FILTER (WHERE doc_id % 10 = 0) AS BIGINT) AS corrupted FROM ({DOCUMENTS_SQL}) GROUP BY archive")
def errors_as_rows(spark, sf_dir):
    e = registry.read_entries(_damaged(spark, sf_dir))
    return e.groupBy(F.col("archive_path").alias("archive")).agg(F.count_if(F.col("error.class") == "Corrupted").alias("corrupted"))


@query("limit_exceeded", f"SELECT archive, sum(octet_length(encode(text))) > 100000 AS exceeded FROM ({DOCUMENTS_SQL}) GROUP BY archive")
def limit_exceeded(spark, sf_dir):
    e = registry.read_entries(write.pack(documents(spark, sf_dir), "archive", "name", "content", kind="ZIP"), limits=registry.Limits(max_total=100_000))
    return e.groupBy(F.col("archive_path").alias("archive")).agg((F.count_if(F.col("error.class") == "LimitExceeded") > 0).alias("exceeded"))


@query("top_payload", f"SELECT archive, arg_max(name, (octet_length(encode(text)), name)) AS name, CAST(max(octet_length(encode(text))) AS BIGINT) AS size FROM ({DOCUMENTS_SQL}) GROUP BY archive")
def top_payload(spark, sf_dir):
    e = registry.read_entries(write.pack(documents(spark, sf_dir), "archive", "name", "content", kind="TAR"), want_content=False)
    return e.groupBy(F.col("archive_path").alias("archive")).agg(F.max_by("name", F.struct("uncompressed_size", "name")).alias("name"), F.max("uncompressed_size").alias("size"))


def _volumes(spark, sf_dir):
    z = write.pack(documents(spark, sf_dir), "archive", "name", "content", kind="SEVEN_Z").withColumn("n", F.octet_length("content"))
    cut = z.select("path", "n", "content", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 10000).cast("int"))).alias("i"))
    part = F.substr(F.col("content"), F.col("i") * 10000 + 1, F.lit(10000))
    return z, cut.select(F.concat("path", F.lit(".7z."), F.lpad((F.col("i") + 1).cast("string"), 3, "0")).alias("path"), F.octet_length(part).alias("length"), part.alias("content"))


@query("volume_totals", f"SELECT archive, true AS complete FROM ({DOCUMENTS_SQL}) GROUP BY archive")
def volume_totals(spark, sf_dir):
    whole, cut = _volumes(spark, sf_dir)
    got = relational_volumes(cut).join(whole.select(F.concat("path", F.lit(".7z")).alias("path"), "n"), "path")
    return got.select(F.regexp_replace("path", r"\.7z$", "").alias("archive"), ((F.col("total_bytes") == F.col("n")) & (F.col("volumes") == F.ceil(F.col("n") / 10000))).alias("complete"))


relational_volumes = registry.volume_totals


@query("split_volumes", f"{_LISTED} ({DOCUMENTS_SQL})")
def split_volumes(spark, sf_dir):
    _, cut = _volumes(spark, sf_dir)
    return _listing(registry.read_entries(registry.join_volumes(cut))).withColumn("archive", F.regexp_replace("archive", r"\.7z$", ""))


@query("columns_of_tables", "SELECT p_brand AS tbl, string_agg(p_name, ',' ORDER BY p_partkey) AS columns FROM part GROUP BY p_brand")
def columns_of_tables(spark, sf_dir):
    return relational.columns_of(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "tbl"), "tbl", "p_partkey", "p_name").select("tbl", F.array_join("columns", ",").alias("columns"))


@query("best_overlap", "SELECT arg_max(n_regionkey, (n, n_regionkey)) AS n_regionkey, CAST(max(n) AS BIGINT) AS n FROM (SELECT n_regionkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (SELECT c_custkey FROM customer) GROUP BY n_regionkey)")
def best_overlap(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumnRenamed("s_suppkey", "key")
    return relational.best_overlap(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), s, "key", "n_regionkey")


@query("new_files", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def new_files(spark, sf_dir):
    return relational.not_before(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("after_damage", "SELECT user_id, event_id, coalesce(bool_or(event_id % 97 = 0) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS lost FROM events")
def after_damage(spark, sf_dir):
    return relational.after_damage(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_id") % 97 == 0).select("user_id", "event_id", "lost")


_FORMAT_ROWS = ", ".join(f"('{f}', '{label}', {len(formats.EXTENSIONS.get(f, '').split())})" for f, label in formats.LABELS.items() if f != "UNKNOWN")


@query("formats", f"SELECT format, label, CAST(n AS BIGINT) AS extensions FROM (VALUES {_FORMAT_ROWS}) t(format, label, n)")
def all_formats(spark, sf_dir):
    return formats.formats(spark).select("format", "label", F.size("extensions").cast("long").alias("extensions"))


@query("plugins", "SELECT * FROM (VALUES ('pak', true), ('sarc', true)) t(id, loaded)")
def all_plugins(spark, sf_dir):
    return registry.BUILT_IN.table(spark).select("id", "loaded")


__all__ = ["ORACLES", "QUERIES"]
