"""Scans of text, Markdown and word-processor files, validation, caches and examples."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.config import DEFAULTS
from corvine.functions import identity as I
from corvine.functions.text import said
from corvine.operators.splitter import chunks


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of a few paths that are there, in any store that Spark reads."""
    conf, path_of = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if path_of(p).getFileSystem(conf).exists(path_of(p))]


def size_ok(length: Column, most: int = DEFAULTS.MAX_FILE_SIZE) -> Column:
    return F.coalesce(length <= most, F.lit(False))


def type_ok(path: Column, allowed: tuple = DEFAULTS.ALLOWED_TYPES) -> Column:
    return F.coalesce(I.extension(path).isin(*allowed), F.lit(False))


def totals(rows: DataFrame, *keys: str, most: int = DEFAULTS.MAX_TOTAL_SIZE) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("length").alias("total"), F.count("*").alias("n_files")).withColumn("total_ok", F.col("total") <= most)


def expired(cached_at: Column, now: Column, days: int = DEFAULTS.CACHE_EXPIRE_DAYS) -> Column:
    """Strictly older than so many days."""
    return now - cached_at > F.make_dt_interval(F.lit(days))


def docx_text(content: bytes) -> str:
    """The paragraphs of a word-processor file, one a line; empty if it is none."""
    import io
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def documents(rows: DataFrame) -> DataFrame:
    """Files -> one whole document each, by extension; files of other types give none. PDF needs a parser that is not here."""

    def read_docx(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([docx_text(c) for c in b.column(2).to_pylist()], pa.string())], names=["path", "file_hash", "content"])

    rows = rows.select("path", F.sha2("content", 256).alias("file_hash"), "content", I.extension(F.col("path")).alias("ext"))
    plain = rows.filter(F.col("ext").isin(".txt", ".md")).select("path", "file_hash", F.decode("content", "utf-8").alias("content"))
    docx = rows.filter("ext = '.docx'").select("path", "file_hash", "content").mapInArrow(read_docx, "path string, file_hash string, content string")
    return plain.unionByName(docx).filter("content <> ''").select(I.stable_source(F.col("path"), F.col("file_hash")).alias("source"), F.lit(1).alias("page"), F.lit("text").alias("type"), "file_hash", "content")


def chunked(docs: DataFrame, size: int = DEFAULTS.CHUNK_SIZE, overlap: int = DEFAULTS.CHUNK_OVERLAP) -> DataFrame:
    """(source, page, type, file_hash, content) -> chunks (doc_id, source, page, type, chunk_id, content), the unit that is indexed."""
    rows = docs.filter(said(F.col("content"))).select(F.struct("source", "page", "type", "file_hash").alias("doc"), "content")
    found = chunks(rows, "doc", "content", size, overlap)
    found = found.select("doc.*", I.chunk_id(F.col("doc.file_hash"), F.col("doc.page"), F.col("seq")).alias("chunk_id"), "content")
    return found.select(I.doc_key(F.col("source"), F.col("page"), F.col("chunk_id"), F.col("content")).alias("doc_id"), "source", "page", "type", "chunk_id", "content")


def write_cache(chunks: DataFrame, path: str) -> None:
    """Chunks by file hash; a file that comes again replaces its own part only."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_hash").parquet(path)


def read_cache(spark: SparkSession, path: str, now: Column, days: int = DEFAULTS.CACHE_EXPIRE_DAYS) -> DataFrame:
    """What is not expired; corrupt files are left out, as a miss, and a cache that isn't there yet is an empty one."""
    try:
        cached = spark.read.option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException:  # no path, or no file with a schema
        return spark.createDataFrame([], "content string, cached_at timestamp, file_hash string")
    return cached.filter(~expired(F.col("cached_at"), now, days))


def remove_corrupt(spark: SparkSession, path: str) -> int:
    """Removes the cache's files that are no Parquet files, so that their chunks are made anew; how many these were.

    Tasks look at the ends of the files, and only the names of broken ones come to the driver.
    """
    if not existing(spark, [path]):
        return 0
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    whole = (F.substring("content", 1, 4) == F.lit(b"PAR1")) & (F.substring("content", -4, 4) == F.lit(b"PAR1"))
    broken = [r["path"] for r in found.filter(~whole).select("path").collect()]
    for p in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, broken):
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, False)
    return len(broken)


def cells(rows: DataFrame, column: str, number: str) -> DataFrame:
    """Rows of a data set whose cell holds a file in one of four kinds -> (number, path, content); null cells are left out.

    A struct with ``path`` and ``bytes``, one with a ``stream`` that has a ``name`` (an opened file), a path, or bytes alone,
    which have no path. Content is null where the cell has none. Data sets of several kinds are told apart by their
    column's type and put together by name.
    """
    kind, value = rows.schema[column].dataType, F.col(column)
    none = F.lit(None)
    if isinstance(kind, T.StructType):
        path = value["stream"]["name"] if "stream" in kind.names else value["path"] if "path" in kind.names else none
        content = value["bytes"] if "bytes" in kind.names else none
    elif isinstance(kind, T.BinaryType):
        path, content = none, value
    else:
        path, content = value.cast("string"), none
    return rows.filter(value.isNotNull()).select(F.col(number).alias("number"), F.coalesce(path, F.lit("")).alias("path"), content.cast("binary").alias("content"))


def extracted(wanted: DataFrame, found: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(wanted path) x cells -> (wanted, number, path, content): the first row whose file has the same name; null if there is none.

    Content that a cell lacks is taken from ``stored`` files (path, content), where they are given.
    """
    name = I.basename(F.col("path"))
    first = found.filter("path <> ''").groupBy(name.alias("name")).agg(F.min_by(F.struct("number", "path", "content"), "number").alias("first"))
    out = wanted.select("wanted", I.basename(F.col("wanted")).alias("name")).join(first, "name", "left").select("wanted", "first.*")
    if stored is None:
        return out
    kept = stored.select(F.col("path").alias("s_path"), F.col("content").alias("s_content"))
    lacking = out.join(kept, F.col("content").isNull() & (F.col("path") == F.col("s_path")), "left")
    return lacking.select("wanted", "number", "path", F.coalesce("content", "s_content").alias("content"))


def parse_pdf(*_):
    raise NotImplementedError("reading PDF needs pdfplumber, which is not installed; pass text or chunks instead")
