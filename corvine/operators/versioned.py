"""A table with versions: rows replaced or deleted by key, any number of writers, exactly-once commits, compaction.

A table is a folder. Rows are written to ``data/<id>`` first and count once a file ``log/<version>.json`` names them. A
version belongs to whoever creates its file first: the file system creates a file for one of two writers only (HDFS and local
disks do; an object store has to offer the same), and the other one goes on with the next version, so neither loses rows.
What a failed writer leaves in ``data`` is named by no version.

Reading merges the versions: of each key the row of the last version counts, unless it is a delete marker. ``compact`` writes
the merged state of one version; later versions stay on top of it, also those that come while it works.

A commit may carry an epoch (writer, number). An epoch that the log has is not committed again, whoever repeats it.
"""

from __future__ import annotations

import json
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "version long, data string, through long, writer string, epoch long"
#: On local disks a check and a creation are two steps; within a driver this makes them one.
_one_at_a_time = threading.Lock()


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def log(spark: SparkSession, at: str) -> list:
    """The commits by version. A file that is being written is none yet."""
    path, fs = _path(spark, f"{at}/log")
    if not fs.exists(path):
        return []
    return sorted(spark.read.schema(LOG).json(f"{at}/log").filter("version IS NOT NULL").collect(), key=lambda r: r.version)


def _claimed(spark: SparkSession, at: str, version: int, line: dict) -> bool:
    """Creates the file of a version; False if another writer has."""
    path, fs = _path(spark, f"{at}/log/{version:020}.json")
    with _one_at_a_time:
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "exist" not in str(e.java_exception).lower():
                raise
            return False
        out.write(bytearray(json.dumps(line | {"version": version}).encode()))
        out.close()
    return True


def _committed(spark: SparkSession, at: str, line: dict, epoch: tuple[str, int] | None) -> int | None:
    """The version that this commit became, or None if its epoch is there already."""
    if epoch:
        line |= {"writer": epoch[0], "epoch": epoch[1]}
    while True:
        known = log(spark, at)
        if epoch and any((r.writer, r.epoch) == epoch for r in known):
            return None
        version = known[-1].version + 1 if known else 1
        if _claimed(spark, at, version, line):
            return version


def write(rows: DataFrame, at: str, epoch: tuple[str, int] | None = None, deleted: bool = False) -> int | None:
    """Adds rows, each in place of the one with its key; keys with ``deleted``. A new version, or None for an epoch that the log has."""
    spark = rows.sparkSession
    if epoch and any((r.writer, r.epoch) == epoch for r in log(spark, at)):
        return None
    data = uuid.uuid4().hex
    rows.withColumn("_deleted", F.lit(deleted)).write.parquet(f"{at}/data/{data}")
    return _committed(spark, at, {"data": data}, epoch)


def delete(keys: DataFrame, at: str, epoch: tuple[str, int] | None = None) -> int | None:
    """Marks keys as deleted."""
    return write(keys, at, epoch, deleted=True)


def read(spark: SparkSession, at: str, schema, key: str = "doc_id", version: int | None = None) -> DataFrame:
    """The table as of a version, or of now. ``schema`` says what columns it has; rows written without one have null there.

    A version's own rows must differ in their key. The last row of a key is found by partial aggregation, so a key with many
    versions is no burden for a task.
    """
    empty = spark.createDataFrame([], schema)
    known = [r for r in log(spark, at) if version is None or r.version <= version]
    base = max((r for r in known if r.through is not None), key=lambda r: (r.through, r.version), default=None)
    live = [(r.version, r.data) for r in known if r.through is None and (base is None or r.version > base.through)]
    if base:
        live.append((base.through, base.data))
    if not live:
        return empty
    parts = None
    for v, data in live:
        part = spark.read.parquet(f"{at}/data/{data}")
        part = part.select(F.lit(v).alias("_version"), "_deleted", *[F.col(c) if c in part.columns else F.lit(None).cast(empty.schema[c].dataType).alias(c) for c in empty.columns])
        parts = part if parts is None else parts.unionByName(part)
    last = parts.groupBy(key).agg(F.max_by(F.struct("_deleted", *[c for c in empty.columns if c != key]), "_version").alias("last"))
    return last.filter("NOT last._deleted").select(*[F.col(c) if c == key else F.col(f"last.`{c}`") for c in empty.columns])


def compact(spark: SparkSession, at: str, schema, key: str = "doc_id") -> int | None:
    """Writes the merged state of now; readers need none of the versions before it any longer. None if there is nothing to merge."""
    known = log(spark, at)
    if not known:
        return None
    through, data = known[-1].version, uuid.uuid4().hex
    read(spark, at, schema, key, through).withColumn("_deleted", F.lit(False)).write.parquet(f"{at}/data/{data}")
    return _committed(spark, at, {"data": data, "through": through}, None)


def stream_into(rows: DataFrame, at: str, checkpoint: str, name: str, made=lambda df: df):
    """Writes a stream into the table, each micro-batch as ``made`` of it, exactly once; started with all that is available.

    A batch that was written but not committed, or committed but not checkpointed, is repeated under the same epoch.
    """

    def batch(df: DataFrame, number: int) -> None:
        write(made(df), at, (name, number))

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
