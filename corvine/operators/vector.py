"""Nearest neighbours of a set of query vectors against all vectors, in blocks, and re-ranking for diversity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.config import DEFAULTS

QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192


def _groups(batches, n_keys: int):
    """Sorted Arrow batches -> one table for each value of the first columns."""
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(n_keys)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(keys[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(keys[a])
    if held:
        yield pa.Table.from_batches(held)


def unit(vectors: list) -> np.ndarray:
    data = np.array(vectors, dtype=np.float64)
    return data / np.maximum(np.sqrt((data * data).sum(axis=1, keepdims=True)), 1e-300)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = DEFAULTS.VECTOR_FETCH_K, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """(query, embedding) x (id, embedding) -> (query, id, similarity, rank): the ``k`` most similar by cosine, ties by id.

    Both sides are dealt to blocks; each pair of blocks is one unit of work with a product of two matrices, which puts out
    ``k`` rows a query. So nothing is broadcast, and memory is bounded by the blocks. Null vectors have no neighbours.
    """
    queries, vectors = queries.filter("embedding IS NOT NULL"), vectors.filter("embedding IS NOT NULL")
    n_queries = F.greatest(F.lit(1), F.ceil(F.count("*") / query_block)).cast("int")
    n_vectors = F.greatest(F.lit(1), F.ceil(F.count("*") / vector_block)).cast("int")
    q_blocks, v_blocks = queries.agg(n_queries).first()[0], vectors.agg(n_vectors).first()[0]
    side = lambda df, name, own, own_n, other, other_n, flag: df.select(
        F.pmod(F.xxhash64(name), F.lit(own_n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(other_n - 1))).alias(other), F.lit(flag).alias("side"), F.col(name).cast("long").alias("id"), "embedding"
    )
    both = side(queries, "query", "q_block", q_blocks, "v_block", v_blocks, 0).unionByName(side(vectors, "id", "v_block", v_blocks, "q_block", q_blocks, 1))
    units = both.select("q_block", "v_block", "side", "id", "embedding").repartition("q_block", "v_block").sortWithinPartitions("q_block", "v_block", "side", "id")

    def run(batches):
        import pyarrow as pa

        for group in _groups(batches, 2):
            side, ids = group.column(2).to_numpy(), group.column(3).to_numpy()
            points = unit(group.column(4).to_pylist())
            n = int((side == 0).sum())
            if n in (0, len(ids)):
                continue
            similar = np.round(points[:n] @ points[n:].T, 9)
            # what is at least as similar as the k-th, and of that the first k: only ties at the end are more than k
            least = np.partition(similar, -k, axis=1)[:, -k] if similar.shape[1] > k else np.full(n, -np.inf)
            query, place = np.nonzero(similar >= least[:, None])
            found, own = similar[query, place], ids[n:][place]
            order = np.lexsort((own, -found, query))
            query = query[order]
            among = np.arange(len(query)) - np.searchsorted(query, query) < k
            query, first = query[among], order[among]
            yield pa.RecordBatch.from_arrays([pa.array(ids[:n][query]), pa.array(own[first]), pa.array(found[first])], names=["query", "id", "similarity"])

    found = units.mapInArrow(run, "query long, id long, similarity double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))).filter(F.col("rank") <= k)


def diverse(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, k: int = DEFAULTS.MMR_K, weight: float = DEFAULTS.MMR_LAMBDA) -> DataFrame:
    """(query, id, rank) -> (query, id, rank): the maximal marginal relevance order of each query's few candidates.

    Greedy: next comes the candidate with the highest ``weight`` x similarity to the query - (1 - weight) x its highest
    similarity to one that was taken; ties by the order of candidates.
    """
    rows = candidates.select("query", "id", "rank").join(vectors.select("id", "embedding"), "id").select(F.col("query"), F.col("rank"), F.col("id"), "embedding")
    asked = queries.select("query", F.lit(0).alias("rank"), F.lit(-1).cast("long").alias("id"), "embedding")
    sorted_rows = asked.unionByName(rows).repartition("query").sortWithinPartitions("query", "rank")

    def run(batches):
        import pyarrow as pa

        for group in _groups(batches, 1):
            ids = group.column(2).to_numpy()[1:]
            if group.column(1)[0].as_py() != 0 or not len(ids):
                continue
            points = unit(group.column(3).to_pylist())
            to_query, among = np.round(points[1:] @ points[0], 9), np.round(points[1:] @ points[1:].T, 9)
            taken: list[int] = []
            closest = np.zeros(len(ids))
            for _ in range(min(k, len(ids))):
                score = np.round(weight * to_query - (1 - weight) * closest, 9) if taken else to_query.copy()
                score[taken] = -np.inf
                best = int(score.argmax())
                closest = among[best] if not taken else np.maximum(closest, among[best])
                taken.append(best)
            query = group.column(0)[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([query] * len(taken), pa.int64()), pa.array(ids[taken]), pa.array(range(1, len(taken) + 1), pa.int32())], names=["query", "id", "rank"])

    return sorted_rows.withColumn("query", F.col("query").cast("long")).mapInArrow(run, "query long, id long, rank int")
