"""Text embeddings: a deterministic offline one by hashing words, and any provider in its place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions.text import words
from corvine.operators.workflow import called

DIMENSIONS = 64


def place(word: Column, dimensions: int) -> Column:
    return F.conv(F.substring(F.md5(F.lower(word)), 1, 4), 16, 10).cast("int") % dimensions


def hashed(docs: DataFrame, key: str = "doc_id", text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, text) -> (key, at, weight): the non-zero places of a unit vector; each word counts at the place its hash names."""
    counts = docs.select(key, F.explode(words(F.col(text))).alias("word")).groupBy(key, place(F.col("word"), dimensions).alias("at")).agg(F.count("*").alias("n"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, key).select(key, "at", (F.col("n") / F.col("norm")).alias("weight"))


def dense(places: DataFrame, key: str = "doc_id", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, at, weight) -> (key, embedding): at most ``dimensions`` rows a key."""
    found = F.map_from_entries(F.collect_list(F.struct("at", "weight")))
    return places.groupBy(key).agg(found.alias("m")).select(key, F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float")).alias("embedding"))


def dense_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, text) -> (key, embedding): as ``dense`` of ``hashed``, each row by itself, so nothing is shuffled; for keys that do not repeat."""
    found = docs.select(key, F.transform(words(F.col(text)), lambda w: place(w, dimensions)).alias("at")).filter(F.size("at") > 0)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n, lists = len(batch), batch.column(1)
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
            counts = np.bincount(row * dimensions + lists.flatten().to_numpy(), minlength=n * dimensions).reshape(n, dimensions)
            weights = (counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dimensions, pa.int32()), pa.array(weights.ravel()))], names=[key, "embedding"])

    return found.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, embedding array<float>")


def by_provider(docs: DataFrame, provider, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) -> (key, embedding) by ``provider.embed``, in Arrow batches."""
    return docs.select(key, called(provider, "embed", "array<float>", F.col(text)).alias("embedding"))
