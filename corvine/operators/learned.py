"""Vectors of texts learned from the corpus: weighted terms and a randomised low-rank factorisation by distributed products.

A text is a sparse row over ``FEATURES`` places, each term at the place of its hash, weighted by (1 + ln tf) * ln((1 + n) / (1 + df))
and of length 1. Let A be the matrix of all rows. An orthonormal basis Q of ``SIZE`` + ``MORE`` columns begins at random and
becomes the one of A'AQ in each of ``ROUNDS`` rounds: every task adds up its rows' part of the product, and blocks of places are
summed by Spark. Q comes to the driver, which only makes it orthonormal; its size does not depend on the corpus. A small
eigenproblem at the end gives the ``SIZE`` directions that hold most of the rows, and a text's vector is its row in them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions.text import words
from corvine.session import cleaned

FEATURES, SIZE, MORE, ROUNDS = 1 << 15, 64, 16, 3
#: Places that are summed together.
BLOCK = 512
SEED = 3


def place(term: Column, features: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(features)).cast("int")


def rows(docs: DataFrame, save, key: str = "doc_id", text: str = "text", features: int = FEATURES) -> DataFrame:
    """(key, places array<int>, weights array<double>): a sparse row of length 1 for each text; empty arrays for one without terms."""
    read = docs.select(F.col(key).alias("key"), F.transform(F.coalesce(words(F.lower(text)), F.array().cast("array<string>")), lambda w: place(w, features)).alias("at"))
    read = save(read, "places")
    df = read.select(F.explode(F.array_distinct("at")).alias("at")).groupBy("at").agg(F.count("*").alias("df"))
    # a number a place: at most ``features`` rows
    known = df.crossJoin(F.broadcast(read.agg(F.count("*").alias("n")))).select("at", F.log((1 + F.col("n")) / (1 + F.col("df"))).alias("idf"))
    idf = np.zeros(features)
    for r in known.collect():
        idf[r["at"]] = r["idf"]
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def weigh(batches):
        import pyarrow as pa

        for batch in batches:
            row, at = _entries(batch.column(1))
            terms = np.sort(row * features + at)
            new = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])[: len(terms)])
            tf, row, at = np.diff(np.append(new, len(terms))), terms[new] // features, terms[new] % features
            w = (1 + np.log(tf)) * shared.value[at]
            length = np.sqrt(np.bincount(row, w * w, minlength=len(batch)))
            w /= np.where(length > 0, length, 1.0)[row]
            offsets = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(at, pa.int32()), pa.array(w))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["key", "places", "weights"])

    return read.mapInArrow(weigh, f"key {docs.schema[key].dataType.simpleString()}, places array<int>, weights array<double>").withColumnRenamed("key", key)


def _entries(lists) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of each entry of a batch's lists."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()


def _flat(batch, places: str = "places", weights: str = "weights"):
    """The rows of a batch one behind the other: row number, place and weight of each entry."""
    row, at = _entries(batch.column(batch.schema.get_field_index(places)))
    return row, at, batch.column(batch.schema.get_field_index(weights)).flatten().to_numpy()


def added(to: np.ndarray, key: np.ndarray, other: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``to[key] += weight * rows[other]`` over entries in the order of their keys, with one product for all entries of a key."""
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    for k, low, high in zip(key[begins].tolist(), begins.tolist(), np.append(begins, len(key))[1:].tolist(), strict=True):
        to[k] += weight[low:high] @ rows[other[low:high]]
    return to


def times(row: np.ndarray, at: np.ndarray, weight: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """Sparse rows times a basis."""
    return added(np.zeros((n, basis.shape[1])), row, at, weight, basis)


def product(sparse: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A'A times a basis."""
    shared, (features, size) = sparse.sparkSession.sparkContext.broadcast(basis), basis.shape

    def part(batches):
        import pyarrow as pa

        total = np.zeros((features, size))
        for batch in batches:
            row, at, weight = _flat(batch)
            y = times(row, at, weight, len(batch), shared.value)
            order = np.argsort(at, kind="stable")
            added(total, at[order], row[order], weight[order], y)
        blocks = [b for b in range(0, features, BLOCK) if total[b : b + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([total[b : b + BLOCK].tobytes() for b in blocks], pa.binary())], names=["block", "sum"])

    def summed(batches):
        import pyarrow as pa

        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(data).reshape(-1, size)
                found[block] = found[block] + own if block in found else own
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["block", "sum"])

    out = np.zeros((features, size))
    with cleaned(sparse.sparkSession):
        for r in sparse.select("places", "weights").mapInArrow(part, "block int, sum binary").repartition("block").mapInArrow(summed, "block int, sum binary").collect():
            own = np.frombuffer(r["sum"]).reshape(-1, size)
            out[r["block"] : r["block"] + len(own)] = own
    return out


def fit(sparse: DataFrame, size: int = SIZE, more: int = MORE, rounds: int = ROUNDS, features: int = FEATURES) -> np.ndarray:
    """(place, direction): an orthonormal basis of the directions that hold most of the rows."""
    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED)).standard_normal((features, size + more)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(product(sparse, basis))[0]
    values, turned = np.linalg.eigh(basis.T @ product(sparse, basis))
    return basis @ turned[:, np.argsort(-values)[:size]]


def embedded(sparse: DataFrame, basis: np.ndarray, key: str = "doc_id") -> DataFrame:
    """(key, embedding array<float>) of length 1; zeros for a text without terms."""
    shared = sparse.sparkSession.sparkContext.broadcast(basis)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            row, at, weight = _flat(batch)
            y = times(row, at, weight, len(batch), shared.value)
            y /= np.maximum(np.sqrt((y * y).sum(axis=1, keepdims=True)), 1e-300)
            offsets = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(y.astype(np.float32).ravel()))], names=[key, "embedding"])

    return sparse.select(key, "places", "weights").mapInArrow(run, f"{key} {sparse.schema[key].dataType.simpleString()}, embedding array<float>")
