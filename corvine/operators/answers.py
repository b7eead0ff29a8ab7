"""Calls of a provider that costs money: each different prompt once, some at a time, with a memory that outlives executors.

A memory is a folder of files (digest of the prompt, answer). Prompts that it has are joined and never asked again. The others
go to tasks by digest, which ask ``at_a_time`` of them together and write their answers before they go on; a task that is
repeated finds the files of its former attempt and asks only what they lack. A prompt that fails has a row with the reason
and no place in the memory, so a later run asks it again.
"""

from __future__ import annotations

import hashlib
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AT_A_TIME = 16
ANSWER = "digest string, answer string"


def _system(path: str):
    """The Arrow file system of a path or address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _kept(folder: str, digests: list[str]) -> tuple[str, dict[str, str]]:
    """The file for these prompts, and what it has."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, at = _system(folder)
    name = f"{at}/{hashlib.sha256(' '.join(digests).encode()).hexdigest()}.parquet"
    if system.get_file_info(name).type == fs.FileType.NotFound:
        return name, {}
    table = pq.read_table(name, filesystem=system)
    return name, dict(zip(table.column("digest").to_pylist(), table.column("answer").to_pylist(), strict=True))


def _keep(folder: str, name: str, found: dict[str, str]) -> None:
    """Writes a file beside its place and moves it there, so that none is read in part."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    system, at = _system(folder)
    system.create_dir(at, recursive=True)
    table = pa.table({"digest": pa.array(list(found), pa.string()), "answer": pa.array(list(found.values()), pa.string())})
    part = f"{at}/_{uuid.uuid4().hex}"
    pq.write_table(table, part, filesystem=system)
    system.move(part, name)


def answered(requests: DataFrame, memory: str, complete, save, prompt: str = "prompt", at_a_time: int = AT_A_TIME) -> DataFrame:
    """Adds ``answer`` and ``error`` to rows with a prompt; of one prompt, all rows have the one answer. A null prompt has neither.

    ``complete`` maps a prompt to a text. ``save`` maps (table, name) to the table, written in a shared folder.
    """
    spark = requests.sparkSession
    rows = requests.withColumn("digest", F.sha2(F.col(prompt), 256))
    known = save(spark.read.schema(ANSWER).option("recursiveFileLookup", "true").parquet(memory).dropDuplicates(["digest"]), "known") if _exists(spark, memory) else spark.createDataFrame([], ANSWER)
    asked = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(prompt).alias("text")).join(known, "digest", "left_anti")

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return complete(text), None
        except Exception as e:  # whatever a service's client raises
            return None, f"{type(e).__name__}: {e}"

    def ask(batches):
        import pyarrow as pa

        with ThreadPoolExecutor(at_a_time) as pool:
            for digests, texts in _together(batches, at_a_time):
                name, had = _kept(memory, digests)
                left = [i for i, d in enumerate(digests) if d not in had]
                new = dict(zip(left, pool.map(one, [texts[i] for i in left]), strict=True))
                good = had | {digests[i]: a for i, (a, e) in new.items() if e is None}
                if len(good) > len(had):
                    _keep(memory, name, good)
                errors = [new[i][1] if i in new else None for i in range(len(digests))]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array([good.get(d) for d in digests], pa.string()), pa.array(errors, pa.string())], names=["digest", "answer", "error"])

    # the same prompts make the same groups when a task is repeated
    calls = asked.repartition("digest").sortWithinPartitions("digest").mapInArrow(ask, ANSWER + ", error string")
    every = save(calls, "calls").unionByName(known.withColumn("error", F.lit(None).cast("string")))
    return rows.join(every, "digest", "left").drop("digest")


def _together(batches, size: int):
    """Groups of ``size`` rows, over the ends of batches."""
    digests: list[str] = []
    texts: list[str] = []
    for batch in batches:
        digests += batch.column(0).to_pylist()
        texts += batch.column(1).to_pylist()
        while len(digests) >= size:
            yield digests[:size], texts[:size]
            digests, texts = digests[size:], texts[size:]
    if digests:
        yield digests, texts


def _exists(spark, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
