"""Approximate nearest vectors by learned partitions.

1. *Nodes.* Equal vectors are one node with the least ids of its rows, as many as a result can name.
2. *Graph.* On a sample of nodes (``SAMPLE`` of them, by hash) each is linked to its ``NEIGHBOURS`` nearest. The graph is
   bisected until there are as many parts as wanted, all of one size: a smooth vector over each part's graph is cut at its
   median, then pairs that both gain by it change sides.
3. *Classifier.* A network of one hidden layer learns from a vector which parts its neighbours are in. It places every node
   of the whole table in its most probable part. A quarter of the sample is left out of graph and training; on it, the least
   number of most probable parts is found that hold the share ``RECALL`` of the nearest.
4. *Reranking.* A query meets all nodes of that many parts. Parts are cut into blocks, so a unit of work is a block of nodes
   and one of queries; the measure is taken in double precision on the original vectors.

Only the network (about 100 kB) is sent to all executors. Vectors of another length than most are a part by length and are
compared in full.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; rows that repeat an id and
vector count once, and a query never finds its own id; rows of one id with different vectors are queries of their own; null
ids are candidates, last among ties; fewer candidates than asked for are all returned; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.llm.common import read, written

K = 20
#: Nodes that graph and classifier are fitted on, at most about.
SAMPLE = 8192
#: Nodes of the sample in a part; links of a node; units of the hidden layer; passes over the sample in training.
PART, NEIGHBOURS, HIDDEN, EPOCHS = 64, 10, 128, 24
#: Share of the nearest that the parts looked at should hold.
RECALL = 0.93
#: Nodes and queries in a block.
BLOCK = 4096
SEED = 13


def unit(points: np.ndarray) -> np.ndarray:
    points = points / np.abs(points).max(axis=1, keepdims=True)
    return points / np.sqrt((points * points).sum(axis=1, keepdims=True))


def neighbours(queries: np.ndarray, points: np.ndarray, k: int, same: bool) -> np.ndarray:
    """The places of the ``k`` points with the largest inner product with each query; ``same`` leaves out its own place."""
    out = np.empty((len(queries), k), dtype=np.int64)
    for at in range(0, len(queries), 1024):
        near = queries[at : at + 1024] @ points.T
        if same:
            near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        out[at : at + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def bisected(links: np.ndarray, parts: int, rounds: int = 50, swaps: int = 6) -> np.ndarray:
    """The part of each node of a graph (node -> its neighbours), in ``parts`` (a power of two) of equal size."""
    n, k = links.shape
    a, b = np.repeat(np.arange(n), k), links.reshape(-1)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    part, done = np.zeros(n, dtype=np.int64), 1
    random = np.random.Generator(np.random.PCG64(SEED))
    while done < parts:
        inner = part[a] == part[b]
        i, j = a[inner], b[inner]
        degree = np.bincount(i, minlength=n).astype(np.float64) + 1e-9
        weight = np.bincount(part, degree, done)
        x = random.standard_normal(n)
        for _ in range(rounds):  # all parts at once: a lazy walk, without its limit
            x = (x + np.bincount(i, x[j], n) / degree) / 2
            x -= (np.bincount(part, x * degree, done) / weight)[part]
            x /= np.sqrt(np.bincount(part, x * x, done) + 1e-300)[part]
        order = np.lexsort((x, part))
        begin = np.searchsorted(part[order], np.arange(done))
        size = np.bincount(part, minlength=done)
        side = np.empty(n, dtype=np.int64)
        side[order] = (np.arange(n) - begin[part[order]]) * 2 >= size[part[order]]
        for _ in range(swaps):
            to_one = np.bincount(i, side[j], n)
            gain = np.where(side == 1, degree - 2 * to_one, 2 * to_one - degree)
            best, moved = np.lexsort((-gain, side, part)), 0
            half = part * 2 + side
            first = np.searchsorted(half[best], np.arange(2 * done + 1))
            for p in range(done):
                left, right = best[first[2 * p] : first[2 * p + 1]], best[first[2 * p + 1] : first[2 * p + 2]]
                pairs = min(len(left), len(right))
                better = int((gain[left[:pairs]] + gain[right[:pairs]] > 0).sum()) // 2  # half of them: neighbours may both move
                side[left[:better]], side[right[:better]] = 1, 0
                moved += better
            if not moved:
                break
        part, done = part * 2 + side, done * 2
    return part


class Classifier:
    """From a vector to the probability of each part: one hidden layer."""

    def __init__(self, weights: list[np.ndarray], probes: int):
        self.weights, self.probes = weights, probes

    @classmethod
    def trained(cls, points: np.ndarray, wanted: np.ndarray, epochs: int = EPOCHS, rows: int = 256) -> Classifier:
        """Fitted to the wanted distribution over parts of each point, by Adam."""
        random = np.random.Generator(np.random.PCG64(SEED + 1))
        size, parts = points.shape[1], wanted.shape[1]
        scale = np.sqrt(size)
        weights = [random.standard_normal((size, HIDDEN)) * np.sqrt(2), np.zeros(HIDDEN), random.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
        weights[0] /= scale
        weights, wanted = [w.astype(np.float32) for w in weights], wanted.astype(np.float32)
        mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        x, steps = (points * scale).astype(np.float32), 0
        for epoch in range(epochs):
            order, rate = random.permutation(len(x)), 3e-3 * (1 - epoch / epochs)
            for at in range(0, len(x), rows):
                own = order[at : at + rows]
                hidden = np.maximum(x[own] @ weights[0] + weights[1], 0)
                out = hidden @ weights[2] + weights[3]
                out = np.exp(out - out.max(axis=1, keepdims=True))
                wrong = (out / out.sum(axis=1, keepdims=True) - wanted[own]) / len(own)
                back = (wrong @ weights[2].T) * (hidden > 0)
                slopes = [x[own].T @ back, back.sum(axis=0), hidden.T @ wrong, wrong.sum(axis=0)]
                steps += 1
                for w, g, m, s in zip(weights, slopes, mean, square, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    w -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.99**steps)) + 1e-8)
        return cls(weights, parts)

    def scores(self, points: np.ndarray) -> np.ndarray:
        """The logarithm of each part's probability, up to a constant a row."""
        w = self.weights
        return np.maximum(points * np.sqrt(points.shape[1]) @ w[0] + w[1], 0) @ w[2] + w[3]

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *[w.astype(np.float32) for w in self.weights], probes=self.probes)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Classifier:
        held = np.load(io.BytesIO(data))
        return cls([held[f"arr_{i}"].astype(np.float64) for i in range(4)], int(held["probes"]))


def fitted(points: np.ndarray, parts: int, recall: float = RECALL, k: int = K) -> Classifier:
    """The classifier of a sample of vectors, and how many parts it takes to hold the share ``recall`` of the nearest."""
    held_out = np.arange(len(points)) % 4 == 3
    known, other = points[~held_out], points[held_out]
    directions = unit(known)
    links = neighbours(known, known, min(NEIGHBOURS, len(known) - 1), same=True)
    part = bisected(links, parts)
    wanted = np.zeros((len(known), parts))
    near = np.concatenate([part[:, None], part[links]], axis=1)
    np.add.at(wanted, (np.repeat(np.arange(len(known)), near.shape[1]), near.reshape(-1)), 1 / near.shape[1])
    model = Classifier.trained(directions, wanted)
    scores = model.scores(unit(other))
    nearest = neighbours(other, other, min(k, len(other) - 1), same=True)
    order = np.argsort(np.argsort(-scores, axis=1, kind="stable"), axis=1, kind="stable")
    place = np.take_along_axis(order, scores.argmax(axis=1)[nearest], axis=1)
    share = np.cumsum(np.bincount(place.reshape(-1), minlength=parts)) / place.size
    model.probes = int(np.searchsorted(share, recall)) + 1
    return model


def parts_for(n: int) -> int:
    """The number of parts for ``n`` nodes: a power of two, ``PART`` of the known sample in each."""
    return 1 << max(0, int(np.log2(max(1, min(n, SAMPLE) * 3 // 4 / PART))))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: finite components, of which one at least is not 0."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def fit(nodes: DataFrame, n: int, size: int) -> Classifier | None:
    """Fits the classifier on nodes of one length; none where a single part holds all."""
    parts = parts_for(n)
    if parts == 1:
        return None
    share = min(1.0, SAMPLE / n)
    sample = nodes.filter((F.size("embedding") == size) & (F.pmod(F.xxhash64("embedding"), F.lit(1 << 30)) < int(share * (1 << 30))))

    def run(batches):
        import pyarrow as pa

        held = sorted((v for batch in batches for v in batch.column(0).to_pylist()))
        if held:
            points = np.array(held, dtype=np.float64)
            points = points[np.random.Generator(np.random.PCG64(SEED)).permutation(len(points))]
            yield pa.RecordBatch.from_arrays([pa.array([fitted(points, parts).packed()], pa.binary())], names=["model"])

    row = sample.select("embedding").repartition(1).mapInArrow(run, "model binary").first()
    return Classifier.unpacked(row[0]) if row else None


def placed(nodes: DataFrame, model: Classifier | None, size: int) -> DataFrame:
    """Adds to nodes their ``part``, and ``probes``: the parts that a query with this vector looks at."""
    shared = nodes.sparkSession.sparkContext.broadcast(model.packed() if model else None)

    def run(batches):
        import pyarrow as pa

        own = Classifier.unpacked(shared.value) if shared.value else None
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            parts = np.array([-len(v) for v in vectors], dtype=np.int64)
            probes = [[p] for p in parts.tolist()]
            known = np.flatnonzero(parts == -size) if own else []
            if len(known):
                scores = own.scores(unit(np.array([vectors[i] for i in known], dtype=np.float64)))
                order = np.argsort(-scores, axis=1, kind="stable")[:, : own.probes]
                parts[known] = order[:, 0]
                for i, some in zip(known.tolist(), order.tolist(), strict=True):
                    probes[i] = some
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts), pa.array(probes, pa.list_(pa.int64()))], names=["node", "part", "probes"])

    return nodes.select("node", "embedding").mapInArrow(run, "node long, part long, probes array<long>")


def _reranked(units: DataFrame, k: int) -> DataFrame:
    """(part, node_block, query_block, side, node, embedding, ids), sorted -> (query, vec_id, score): the best of each unit for each query."""

    def run(batches):
        import pyarrow as pa

        unit_of, points, ids, least = None, None, None, None
        held: list = []

        def found(queries, names):
            near = queries @ points.T
            n = min(k, near.shape[1])
            floor = np.partition(near, -n, axis=1)[:, -n] if near.shape[1] > n else near.min(axis=1)
            slack = 1e-12 * np.abs(queries).sum(axis=1) * np.abs(points).max()
            query, place = np.nonzero(near >= (floor - slack)[:, None])
            # once more in an order of additions that is the same wherever a vector stands
            score = np.concatenate([(queries[query[at : at + 65536]] * points[place[at : at + 65536]]).sum(axis=1) for at in range(0, len(query), 65536)])
            order = np.lexsort((least[place], -score, query))
            query, place, score = query[order], place[order], score[order]
            among = np.arange(len(query)) - np.searchsorted(query, query) < k
            query, place, score = query[among], place[among], score[among]
            counts = [len(ids[p]) for p in place.tolist()]
            each = [x for p in place.tolist() for x in ids[p]]
            columns = [pa.array(np.repeat(names[query], counts)), pa.array(each, pa.int64()), pa.array(np.repeat(score, counts))]
            return pa.RecordBatch.from_arrays(columns, names=["query", "vec_id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                some, key = batch.slice(a, b - a), tuple(keys[a][:3])
                if key != unit_of:
                    unit_of, points, held = key, None, []
                if keys[a][3] == 0:  # the nodes of a unit come before its queries
                    held.append(some)
                    continue
                if not held and points is None:
                    continue
                if held:
                    group, held = pa.Table.from_batches(held), []
                    points, ids = np.array(group.column(5).to_pylist(), dtype=np.float64), group.column(6).to_pylist()
                    least = np.array([x[0] if x[0] is not None else np.iinfo(np.int64).max for x in ids])
                for at in range(0, len(some), 512):
                    part = some.slice(at, 512)
                    yield found(np.array(part.column(5).to_pylist(), dtype=np.float64), part.column(4).to_numpy())

    return units.mapInArrow(run, "query long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """(vec_id, embedding), and which rows are queries -> query_id, rank, vec_id, score: the ``k`` with the largest inner product."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(queries, F.lit(False)).alias("asked")).filter(usable(F.col("embedding")))
    # a result names at most k rows beside the query's own
    few = vectors.groupBy("embedding", "vec_id").agg(F.max("asked").alias("asked"))
    few = few.withColumn("at", F.row_number().over(Window.partitionBy("embedding").orderBy(F.asc_nulls_last("vec_id")))).filter(F.col("at") <= k + 1)
    asked = vectors.filter("asked").select("vec_id", "embedding").distinct()
    ids = F.transform(F.array_sort(F.collect_list(F.struct("at", "vec_id"))), lambda x: x["vec_id"])
    nodes = few.groupBy("embedding").agg(ids.alias("ids")).withColumn("node", F.monotonically_increasing_id())
    nodes = written(nodes, "nodes")
    sizes = nodes.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return vectors.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    where = written(placed(nodes, fit(nodes, sizes["count"], sizes["size"]), sizes["size"]), "parts")
    asked_nodes = asked.select("embedding").distinct().join(nodes.select("node", "embedding").hint("merge"), "embedding")
    asked_nodes = asked_nodes.join(where.select("node", "probes").hint("merge"), "node").select("node", "embedding", F.explode("probes").alias("part"))
    asked_nodes = written(asked_nodes, "asked")
    # a row for each part: at most as many as the sample allows, and one for each length of vector
    blocks = lambda df, name: df.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    shape = F.broadcast(written(blocks(where, "node_blocks").join(blocks(asked_nodes, "query_blocks"), "part"), "shape"))

    def side(df: DataFrame, flag: int, own: str, other: str, ids: Column) -> DataFrame:
        block = F.pmod(F.xxhash64("node"), F.col(f"{own}_blocks")).cast("long").alias(f"{own}_block")
        each = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias("other")
        df = df.join(shape, "part").select("part", block, each, F.lit(flag).cast("long").alias("side"), "node", "embedding", ids.alias("ids"))
        return df.withColumn(f"{other}_block", F.col("other").cast("long")).select("part", "node_block", "query_block", "side", "node", "embedding", "ids")

    stored = nodes.join(where.select("node", "part").hint("merge"), "node")
    units = side(stored, 0, "node", "query", F.col("ids")).unionByName(side(asked_nodes, 1, "query", "node", F.lit(None).cast("array<bigint>")))
    units = units.repartition("part", "node_block", "query_block").sortWithinPartitions("part", "node_block", "query_block", "side", "node")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    hits = _reranked(units, k + 1).withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k + 1)
    hits = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("hits"))
    hits = written(hits.join(nodes.select(F.col("node").alias("query"), "embedding").hint("merge"), "query").select("embedding", "hits"), "hits")
    found = asked.withColumnRenamed("vec_id", "query_id").join(hits, "embedding")
    others = F.slice(F.filter("hits", lambda h: ~h["vec_id"].eqNullSafe(F.col("query_id"))), 1, k)
    return found.select("query_id", F.posexplode(others)).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))


def op13_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
