"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

1. Equal vectors with equal labels become one node. Unit vectors are projected on many random lines; two vectors at the
   threshold differ by a known spread on each line. A node's places on ``LINES`` lines, in steps of a quarter of the
   spread, are its sketch of as many bytes.
2. *Sorted lines.* A window on a single line holds a constant share of all vectors, so sorting alone would look at a share
   of all pairs. So each of several tables first parts the vectors of a label by a few coarse projections, and sorts each
   part along one line; a vector meets those in the window that is centred at it. How many projections part them grows with
   the logarithm of the largest label, so that a window holds about ``MATES`` unrelated vectors at any size, and how many
   tables there are follows from the target recall. A large part (a dense group) is cut into blocks, and each pair of blocks
   is sorted and read by itself.
3. *Collisions.* A pair in a window counts the lines on which one lies in the window of one spread around the other, in the
   sketches. Pairs that reach the count that a pair at the threshold misses with probability 1 - ``RECALL`` at most join
   their nodes to candidate clusters. Only ids, places and sketches are shuffled up to here, and no pairs put out.
4. *Verification.* Clusters, again in pairs of blocks, meet with their vectors: all cosines are taken in double precision,
   each pair once. Units put out a number of links a node and a spanning forest.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those without a label, link with
nothing, as do vectors of different length; rows that repeat a vector and label are linked; a null vec_id is one like
others, and the least of a component only if all are null; an empty table gives an empty result; further columns are
ignored by the query.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm.common import read, written
from corvine.llm.components import components
from corvine.llm.jaccard import grouped, in_blocks, least_neighbours

COSINE, RECALL = 0.98, 0.9999
#: Lines of a sketch; width of a part along a coarse projection; half a window along the sorted line, in spreads; vectors in one.
LINES, CELL, WINDOW, MATES = 128, 1.2, 2.5, 32
#: Steps of a sketch in a spread.
STEPS = 4
BLOCK, PAIRS_AT_ONCE = 1024, 100_000


def spread(cosine: float) -> float:
    """The standard deviation, on a random line, of the difference of two unit vectors."""
    return math.sqrt(2 - 2 * cosine)


def shape(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(coarse projections, tables): about ``MATES`` unrelated ones of ``n`` vectors share a window, pairs at the threshold almost surely one."""
    near = 1 - spread(cosine) * math.sqrt(2 / math.pi) / CELL
    far, in_window = CELL / (2 * math.sqrt(math.pi)), WINDOW * spread(cosine) / math.sqrt(math.pi)
    k = max(1, math.ceil(math.log(max(n, 2) * in_window / MATES) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k * math.erf(WINDOW / math.sqrt(2))))


def least_count(recall: float = RECALL, lines: int = LINES) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall``."""
    p = math.erf(1 / math.sqrt(2))  # the steps of a sketch make it more, never less
    below, c = 0.0, 0
    while (below := below + math.comb(lines, c) * p**c * (1 - p) ** (lines - c)) <= 1 - recall:
        c += 1
    return c


def directions(seed: int, n: int, size: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, size])).standard_normal((size, n))


def unit(vectors: list) -> np.ndarray:
    data = np.array(vectors, dtype=np.float64)
    data /= np.abs(data).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return data / np.sqrt((data * data).sum(axis=1, keepdims=True))


def projected(nodes: DataFrame, k: int, tables: int, cosine: float) -> DataFrame:
    """(node, label, embedding) -> node, its part and its place on the sorted line in each table, and its sketch."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            labels, vectors = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cells, lines, sketches = ([None] * len(vectors) for _ in range(3))
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                points = unit([vectors[i] for i in own])
                offset = np.random.Generator(np.random.PCG64([2, size])).random(k * tables)
                coarse = np.floor(points @ directions(1, k * tables, size) / CELL + offset).astype("<i4").reshape(len(own), tables, k)
                sorted_lines = (points @ directions(4, tables, size)).astype(np.float32)
                places = np.clip(np.floor(points @ directions(3, LINES, size) / (spread(cosine) / STEPS)), -128, 127).astype(np.int8)
                for at, i in enumerate(own.tolist()):
                    head = repr((labels[i], size)).encode()
                    cells[i] = [xxhash.xxh64_intdigest(head + coarse[at, t].tobytes(), t) - (1 << 63) for t in range(tables)]
                    lines[i], sketches[i] = sorted_lines[at], places[at].tobytes()
            columns = [batch.column(0), pa.array(cells, pa.list_(pa.int64())), pa.array(lines, pa.list_(pa.float32())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "cells", "lines", "sketch"])

    return nodes.select("node", "label", "embedding").mapInArrow(run, "node long, cells array<long>, lines array<float>, sketch binary")


def colliding(members: DataFrame, cosine: float, count: int) -> DataFrame:
    """(cell, block_a, block_b, line, mine, node, sketch), sorted -> (a, b): a spanning forest of what collides often enough in each unit."""
    window = np.float64(WINDOW * spread(cosine))

    def run(batches):
        import pyarrow as pa

        def found(batch):
            """The links of whole units."""
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1, 2)], axis=1)
            line, mine, ids = (batch.column(i).to_numpy() for i in (3, 4, 5))
            sketch = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.int8).reshape(len(ids), LINES).astype(np.int16)
            unit_of = np.cumsum(np.concatenate([[False], (keys[1:] != keys[:-1]).any(axis=1)]))
            # units one behind the other on one long line
            along = (line.astype(np.float64) - line.min()) + unit_of * (float(line.max()) - float(line.min()) + 2 * window)
            partners = np.searchsorted(along, along + window, side="right") - np.arange(len(ids)) - 1
            upto = np.concatenate([[0], np.cumsum(partners)])
            near_i, near_j = [], []
            row = 0
            while row < len(ids):
                last = max(row + 1, int(np.searchsorted(upto, upto[row] + PAIRS_AT_ONCE, side="right")) - 1)
                n = partners[row:last]
                i = np.repeat(np.arange(row, last), n)
                j = i + 1 + np.arange(len(i)) - np.repeat(upto[row:last] - upto[row], n)
                for low in range(0, len(i), PAIRS_AT_ONCE):  # a single row may have more partners
                    p, q = i[low : low + PAIRS_AT_ONCE], j[low : low + PAIRS_AT_ONCE]
                    meet = (keys[p, 1] == keys[p, 2]) | (mine[p] != mine[q])
                    p, q = p[meet], q[meet]
                    enough = (np.abs(sketch[p] - sketch[q]) <= STEPS).sum(axis=1) >= count
                    near_i.append(p[enough])
                    near_j.append(q[enough])
                row = last
            i, j = np.concatenate([np.zeros(0, np.int64), *near_i]), np.concatenate([np.zeros(0, np.int64), *near_j])
            label = np.arange(len(ids))
            while True:
                new = label.copy()
                np.minimum.at(new, i, label[j])
                np.minimum.at(new, j, label[i])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            moved = np.flatnonzero(label != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"])

        rest = None
        for batch in batches:
            if not len(batch):
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1, 2)], axis=1)
            other = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield found(batch.slice(0, cut))
            rest = batch.slice(cut)
        if rest is not None:
            yield found(rest)

    return members.select("cell", "block_a", "block_b", "line", "mine", "node", "sketch").mapInArrow(run, "a long, b long")


def linked(members: DataFrame, cosine: float) -> DataFrame:
    """(cluster, block_a, block_b, node, mine, copies, embedding), sorted -> (a, b, links): exact links of each unit.

    A row with b null gives links of a: the vectors that it links to in this unit. The other rows are a spanning forest.
    """

    def run(batches):
        import pyarrow as pa

        for group in grouped(batches, 3):
            nodes, mine, copies = (group.column(i).to_numpy() for i in (3, 4, 5))
            if len(nodes) < 2:
                continue
            points = unit(group.column(6).to_pylist())
            near = points @ points.T >= cosine
            if group.column(1)[0] != group.column(2)[0]:
                near &= mine[:, None] != mine[None, :]
            np.fill_diagonal(near, False)
            links, label = near @ copies.astype(np.float64), least_neighbours(near)
            has, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(nodes)))
            a = np.concatenate([nodes[has], nodes[moved]])
            b = pa.array(np.concatenate([nodes[has], nodes[label[moved]]]), mask=np.arange(len(a)) < len(has))
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([links[has], np.zeros(len(moved))]).astype(np.int64))], names=["a", "b", "links"])

    return members.select("cluster", "block_a", "block_b", "node", "mine", "copies", "embedding").mapInArrow(run, "a long, b long, links long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    vectors = vectors.select("vec_id", "embedding", "label").withColumn("fine", F.coalesce(fine & F.col("label").isNotNull(), F.lit(False)))
    nodes = vectors.filter("fine").groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    k, tables = shape(largest, cosine, recall)
    placed = written(projected(nodes, k, tables, cosine), "projections")
    cells = placed.select("node", F.explode(F.arrays_zip("cells", "lines")).alias("c")).select("node", F.col("c.cells").alias("cell"), F.col("c.lines").alias("line"))
    # what is joined here grows with the table: nothing is broadcast, at any size; counts are written, so that Spark may split large groups
    sizes = written(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "cell-sizes")
    parts = cells.join(sizes.hint("merge"), "cell").join(placed.select("node", "sketch").hint("merge"), "node")
    clusters = written(components(colliding(in_blocks(parts, "cell", "node", "n", BLOCK, order="line"), cosine, least_count(recall))).withColumnRenamed("component", "cluster"), "vector-clusters")
    sizes = written(clusters.groupBy("cluster").agg(F.count("*").alias("n")), "cluster-sizes")
    members = nodes.select("node", "copies", "embedding").join(clusters.hint("merge"), "node").join(sizes.hint("merge"), "cluster")
    links = written(linked(in_blocks(members, "cluster", "node", "n", BLOCK), cosine), "vector-links")
    counts = links.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("other_links"))
    groups = components(links.filter("b IS NOT NULL"))
    known = nodes.join(counts, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = written(known.select("label", "embedding", "first", "component", (F.col("copies") - 1 + F.coalesce("other_links", F.lit(0))).alias("n_links")), "vector-groups")
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    known = known.join(least, "component").select(F.col("label").alias("k_label"), F.col("embedding").alias("k_embedding"), "n_links", "component_id")
    found = vectors.join(known, F.col("fine") & (F.col("label") == F.col("k_label")) & (F.col("embedding") == F.col("k_embedding")), "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT r, vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.r AS a, b.r AS b
  FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), n AS (
  SELECT a AS r, count(*) AS n_links FROM link GROUP BY a
), reach AS (
  SELECT r, r AS to_r FROM v
  UNION
  SELECT reach.r, link.b FROM reach JOIN link ON reach.to_r = link.a
), least AS (
  SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.to_r = v.r GROUP BY reach.r
)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least USING (r) LEFT JOIN n USING (r)
"""
