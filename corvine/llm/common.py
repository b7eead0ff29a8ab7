"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A word, as the contracts define it: anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The named table below ``sf_dir``, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``.

    Where neither is set (tests, one machine), a new local one; on a cluster that is an error.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = tempfile.mkdtemp(prefix="corvine-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: The folder that intermediate tables go to, where someone wants to remove them later.
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def tables_in(folder: str) -> Iterator[None]:
    """What ``written`` writes meanwhile goes to this folder."""
    before = _folder.set(folder)
    try:
        yield
    finally:
        _folder.reset(before)


def table_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{_folder.get() or f'{shared_dir(spark)}/corvine/{spark.sparkContext.applicationId}'}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, folder: str) -> None:
    """Removes a folder. No result that reads from it may be open."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Spark removes shuffle files at the end of each execution meanwhile."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def forget() -> None:
    """Frees what tokenizers remember in this Python worker: it serves one stage after the other, and the next needs the memory."""
    import ctypes
    import gc
    import sys

    import pyarrow as pa

    caches = [getattr(sys.modules.get(f"corvine.llm.{module}"), name, None) for module, name in (("bpe", "codec"), ("tokenbin", "encoder"))]
    held = [c for c in caches if c is not None and c.cache_info().currsize]
    for c in held:
        c.cache_clear()
    if held:
        gc.unfreeze()  # their tables refer to each other
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            return


def packed(df: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """The columns ``used`` and one struct ``rest`` of all others, so that no name of theirs meets one of an operator's; and their names."""
    rest = [c for c in df.columns if c not in used]
    fields = [F.col(f"`{c}`") for c in rest] or [F.lit(None).cast("string").alias("nothing")]
    return df.select(*[F.col(f"`{c}`") for c in used], F.struct(*fields).alias("rest")), rest


def unpacked(names: list[str], *made: str) -> list:
    """The packed columns again, but for those that ``made`` replaces, and then ``made``."""
    return [F.col(f"rest.`{c}`") for c in names if c not in made] + [F.col(c) for c in made]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: its lineage ends here, and a lost executor costs no recomputation.

    The shuffle files behind it are of no more use then, so Spark is asked to remove them when the write ends.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    with cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
