"""Incremental indexing by a manifest of ids and content hashes."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(docs: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    return docs.join(manifest, key, "left_anti")


def changed_rows(docs: DataFrame, manifest: DataFrame, key: str, digest: str = "content_hash") -> DataFrame:
    known = manifest.select(key, F.col(digest).alias("known_hash"))
    return docs.join(known, key).filter(F.col(digest) != F.col("known_hash"))


def first_of(docs: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes first: a minimum that is taken before the shuffle, so a key with many rows does no harm."""
    rest = [c for c in docs.columns if c not in (key, order)]
    first = F.min(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("first")
    return docs.groupBy(key).agg(first).select(key, "first.*")


def to_json(manifest: DataFrame, key: str, digest: str = "content_hash") -> DataFrame:
    """One JSON object a row, for a text sink."""
    return manifest.select(F.to_json(F.struct(F.col(key).alias("doc_id"), F.col(digest).alias("content_hash"))).alias("value"))


def from_json(lines: DataFrame) -> DataFrame:
    """(doc_id, content_hash); lines that are no such object are left out, as a missing manifest is an empty one."""
    parsed = F.from_json("value", "doc_id string, content_hash string")
    return lines.select(parsed.alias("m")).select("m.*").filter("doc_id IS NOT NULL AND content_hash IS NOT NULL")


def replace(manifest: DataFrame, path: str) -> None:
    """Writes a whole manifest beside the one at ``path`` and puts its name in place by one rename: readers see the old or the new."""
    spark = manifest.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    manifest.write.parquet(f"{path}/{version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    files = at("").getFileSystem(conf)
    out = files.create(at(f"_{version}"), True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(at(f"_{version}")), files.makeQualified(at("_CURRENT")), overwrite)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest that ``replace`` wrote last; None if there is none, or if it can't be read."""
    pointer = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_CURRENT")
    files = pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(pointer):
        return None
    try:
        stream = files.open(pointer)
        version = bytes(stream.readAllBytes()).decode()
        stream.close()
        return spark.read.parquet(f"{path}/{version}")
    except (AnalysisException, Py4JJavaError):
        return None


def append(batch: DataFrame, manifest_path: str, key: str) -> None:
    """Adds to the Parquet manifest what it has not; with ``foreachBatch`` this is the incremental indexer of a stream."""
    spark = batch.sparkSession
    batch = batch.select(key, "content_hash").dropDuplicates([key])
    try:
        known = spark.read.parquet(manifest_path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = None
    fresh = batch if known is None else new_rows(batch, known.select(key), key)
    fresh.write.mode("append").parquet(manifest_path)
