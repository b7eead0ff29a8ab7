"""A vector index that lasts: an inverted file over a coarse quantiser, with codes of the residuals, searched by probes.

An index is a folder with ``model`` and ``entries``. The model is fitted on about ``SAMPLE`` vectors, picked by hash: list
centres by spherical k-means, codebooks of ``PIECES`` pieces of what is left when the centre is taken away, and the least
number of lists that hold the share ``RECALL`` of the nearest of those sample vectors that the centres were not fitted on.
Every vector is in the list of its nearest centre, with a code of one byte a piece, and with the vector for reranking.

A search sends each query to its most similar lists. A unit of work is a block of one list's codes with a block of queries:
similarities are read from tables of the query's products with the codebooks. The ``RERANK`` x k best by codes are compared
with their vectors. ``vector.nearest`` stays as the exact way.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.config import DEFAULTS
from corvine.operators.vector import _groups, unit

SAMPLE, LIST, PIECES, CODES, RECALL, RERANK = 8192, 64, 16, 256, 0.95, 6
BLOCK = 8192
SEED = 5


def means(points: np.ndarray, n: int, rounds: int = 12, sphere: bool = False) -> np.ndarray:
    """Lloyd's centres; one that loses all its points takes a random one."""
    random = np.random.Generator(np.random.PCG64(SEED))
    centres = points[random.choice(len(points), n, replace=len(points) < n)].copy()
    for _ in range(rounds):
        near = (points @ centres.T - (0 if sphere else (centres * centres).sum(axis=1) / 2)).argmax(axis=1)
        counts = np.bincount(near, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        sums[counts == 0] = points[random.choice(len(points), int((counts == 0).sum()))]
        centres = sums / np.maximum(counts, 1)[:, None]
        if sphere:
            centres = unit(centres)
    return centres


class Model:
    """Centres (list, size), codebooks (piece, code, size of a piece), and how many lists a search looks at."""

    def __init__(self, centres: np.ndarray, books: np.ndarray, probes: int):
        self.centres, self.books, self.probes = centres, books, probes

    @classmethod
    def fitted(cls, points: np.ndarray, k: int, recall: float = RECALL) -> Model:
        held_out = np.arange(len(points)) % 4 == 3
        known, other = points[~held_out], points[held_out]
        lists = max(1, len(known) // LIST)
        centres = means(known, lists, sphere=True)
        pieces = next(p for p in range(min(PIECES, points.shape[1]), 0, -1) if points.shape[1] % p == 0)
        left = (known - centres[(known @ centres.T).argmax(axis=1)]).reshape(len(known), pieces, -1)
        books = np.stack([means(left[:, p], CODES) for p in range(pieces)])
        probes = lists
        if len(other) > k:
            near = other @ other.T
            np.fill_diagonal(near, -np.inf)
            nearest = np.argpartition(-near, k - 1, axis=1)[:, :k]
            to_lists = other @ centres.T
            turn = np.argsort(np.argsort(-to_lists, axis=1, kind="stable"), axis=1, kind="stable")
            place = np.take_along_axis(turn, to_lists.argmax(axis=1)[nearest], axis=1)
            probes = int(np.searchsorted(np.cumsum(np.bincount(place.reshape(-1), minlength=lists)) / place.size, recall)) + 1
        return cls(centres, books, probes)

    def coded(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the code of each vector."""
        lists = (points @ self.centres.T).argmax(axis=1)
        left = (points - self.centres[lists]).reshape(len(points), len(self.books), -1)
        codes = [(left[:, p] @ book.T - (book * book).sum(axis=1) / 2).argmax(axis=1) for p, book in enumerate(self.books)]
        return lists, np.stack(codes, axis=1).astype(np.uint8)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centres=self.centres.astype(np.float32), books=self.books.astype(np.float32), probes=self.probes)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Model:
        held = np.load(io.BytesIO(data))
        return cls(held["centres"].astype(np.float64), held["books"].astype(np.float64), int(held["probes"]))


def build(vectors: DataFrame, path: str, k: int = DEFAULTS.VECTOR_FETCH_K) -> None:
    """Fits a model on a sample of (id, embedding) and makes an index of all of them; null vectors are left out."""
    vectors = vectors.filter("embedding IS NOT NULL")
    share = min(1.0, SAMPLE / max(1, vectors.count()))
    sample = vectors.filter(F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < int(share * (1 << 30))).select("embedding").repartition(1)

    def fit(batches):
        import pyarrow as pa

        held = sorted(v for batch in batches for v in batch.column(0).to_pylist())
        if held:
            points = unit(held)[np.random.Generator(np.random.PCG64(SEED)).permutation(len(held))]
            yield pa.RecordBatch.from_arrays([pa.array([Model.fitted(points, k).packed()], pa.binary())], names=["model"])

    sample.mapInArrow(fit, "model binary").write.parquet(f"{path}/model")
    add(vectors, path)


def model_at(spark: SparkSession, path: str) -> Model | None:
    row = spark.read.schema("model binary").parquet(f"{path}/model").first()
    return Model.unpacked(row[0]) if row else None


def add(vectors: DataFrame, path: str) -> None:
    """Puts further vectors into the lists of the index; the model stays."""
    model = model_at(vectors.sparkSession, path)
    shared = vectors.sparkSession.sparkContext.broadcast(model and model.packed())

    def code(batches):
        import pyarrow as pa

        own = Model.unpacked(shared.value) if shared.value else None
        for batch in batches:
            if len(batch):
                lists, codes = own.coded(unit(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], names=["list", "id", "code", "embedding"])

    rows = vectors.filter("embedding IS NOT NULL").select(F.col("id").cast("long"), F.col("embedding").cast("array<float>"))
    rows.mapInArrow(code, "list int, id long, code binary, embedding array<float>").write.mode("append").parquet(f"{path}/entries")


def search(queries: DataFrame, path: str, save, k: int = DEFAULTS.VECTOR_FETCH_K, probes: int | None = None, rerank: int = RERANK, block: int = BLOCK) -> DataFrame:
    """(query, embedding) -> (query, id, similarity, rank): the ``k`` most similar by cosine that were found, ties by id.

    ``save`` maps (table, name) to the table, written or checkpointed in a shared folder.
    """
    spark = queries.sparkSession
    queries = queries.filter("embedding IS NOT NULL").select(F.col("query").cast("long").alias("query"), "embedding")
    model = model_at(spark, path)
    entries = spark.read.schema("list int, id long, code binary, embedding array<float>").parquet(f"{path}/entries")
    shared, wanted = spark.sparkContext.broadcast(model and model.packed()), rerank * k

    def routed(batches):
        import pyarrow as pa

        own = Model.unpacked(shared.value) if shared.value else None
        for batch in batches:
            if own is None or not len(batch):
                continue
            order = np.argsort(-(unit(batch.column(1).to_pylist()) @ own.centres.T), axis=1, kind="stable")[:, : probes or own.probes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order.tolist(), pa.list_(pa.int32()))], names=["query", "embedding", "lists"])

    asked = save(queries.mapInArrow(routed, "query long, embedding array<float>, lists array<int>"), "routed").select("query", "embedding", F.explode("lists").alias("list"))
    # a row a list, as many as the sample allows
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    shape = F.broadcast(save(blocks(entries, "mine").join(blocks(asked, "theirs"), "list"), "shape"))
    side = lambda df, flag, key, own, other, code, vector: df.join(shape, "list").select(
        "list", F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), F.lit(flag).alias("side"), F.col(key).alias("id"), code.alias("code"), vector.alias("embedding")
    )
    columns = ["list", "mine", "theirs", "side", "id", "code", "embedding"]
    units = side(entries.select("list", "id", "code"), 0, "id", "mine", "theirs", F.col("code"), F.lit(None).cast("array<float>")).select(columns)
    units = units.unionByName(side(asked, 1, "query", "theirs", "mine", F.lit(None).cast("binary"), F.col("embedding")).select(columns))
    units = units.repartition("list", "mine", "theirs").sortWithinPartitions("list", "mine", "theirs", "side", "id")

    def by_codes(batches):
        import pyarrow as pa

        own = Model.unpacked(shared.value) if shared.value else None
        for group in _groups(batches, 3):
            side, ids = group.column(3).to_numpy(), group.column(4).to_numpy()
            n = int((side == 0).sum())
            if n in (0, len(ids)):
                continue
            codes = np.frombuffer(b"".join(group.column(5).slice(0, n).to_pylist()), np.uint8).reshape(n, -1)
            points = unit(group.column(6).slice(n).to_pylist())
            near = np.repeat((points @ own.centres[group.column(0)[0].as_py()])[:, None], n, axis=1)
            for p, book in enumerate(own.books):
                near += (points[:, p * book.shape[1] : (p + 1) * book.shape[1]] @ book.T)[:, codes[:, p]]
            top = np.argpartition(-near, wanted - 1, axis=1)[:, :wanted] if n > wanted else np.broadcast_to(np.arange(n), near.shape)
            columns = [np.repeat(ids[n:], top.shape[1]), ids[:n][top.reshape(-1)], np.take_along_axis(near, top, axis=1).reshape(-1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "id", "guess"])

    guessed = units.mapInArrow(by_codes, "query long, id long, guess double")
    few = guessed.withColumn("turn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("guess"), "id"))).filter(F.col("turn") <= wanted)
    few = save(few.select("query", "id"), "guessed")
    pairs = few.join(entries.select("id", F.col("embedding").alias("theirs")), "id").join(queries, "query")

    def exact(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                a, b = unit(batch.column(2).to_pylist()), unit(batch.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round((a * b).sum(axis=1), 9))], names=["query", "id", "similarity"])

    found = pairs.select("query", "id", "theirs", "embedding").mapInArrow(exact, "query long, id long, similarity double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))).filter(F.col("rank") <= k)
