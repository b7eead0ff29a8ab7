"""A vector store that lasts: a Parquet table of chunks with their vectors, opened, searched and added to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corvine.operators.embed import by_provider
from corvine.operators.manifest import first_of, new_rows

#: Texts that a provider is given in one call.
BATCH = 100


def opened(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """What the store at ``path`` has; where there is none yet, an empty table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append(rows: DataFrame, path: str, key: str = "doc_id", order: str | None = None) -> None:
    """Adds rows (key, embedding, ...) whose key the store has not; of rows with one key the first by ``order``.

    A write that fails leaves nothing, as Spark commits it whole, and adding the same rows again adds none. One writer at a time.
    """
    fresh = new_rows(rows, opened(rows.sparkSession, path, rows.schema).select(key), key)
    fresh = first_of(fresh, key, order) if order else fresh.dropDuplicates([key])
    fresh.select(*rows.columns).write.mode("append").parquet(path)


def embedded(chunks: DataFrame, provider, key: str = "doc_id", text: str = "content") -> DataFrame:
    """Adds ``embedding`` to chunks by ``provider.embed_all``, ``BATCH`` texts a call, or text by text by ``provider.embed``."""
    if not hasattr(provider, "embed_all"):
        return chunks.join(by_provider(chunks, provider, key, text), key)
    kind = chunks.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, len(batch), BATCH):
                some = batch.slice(at, BATCH)
                vectors = provider.embed_all(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=[key, "embedding"])

    return chunks.join(chunks.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>"), key)


def without(store: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The store but for some keys: what a vacuum writes to a new path."""
    return store.join(keys, key, "left_anti")
