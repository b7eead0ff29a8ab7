"""Set-similarity self-join of documents on word shingles, by chosen paths.

1. Each document becomes 64 MinHash tokens (a pair with Jaccard similarity s shares each with probability s); documents
   with the same words are one node from here on.
2. *Chosen paths.* A run begins with all nodes in one bucket and splits it on ``BRANCHES`` sampled tokens: nodes with the
   same value of a sampled token go on together. A bucket of up to ``SMALL`` nodes is a leaf; a larger one is split again
   on tokens that its path chooses, up to ``DEPTH`` times, so nodes that share one frequent passage are parted. There are
   as many runs as the target recall needs for a pair at the threshold.
3. *Leaves.* The pairs of a leaf are compared by their MinHash tokens; a leaf that is still large is cut into blocks, and
   each pair of blocks is a unit of its own. What passes a low bound joins the nodes to candidate clusters.
4. *Verification.* One node stands for each cluster. Every other is set beside it once, whole text by whole text, and told
   by the shingles that it lost and gained. Clusters, again in pairs of blocks, meet with these differences, from which the
   shared shingles of any two follow, so every link is exact and each pair is counted once. Units put out one number of
   links a node and a spanning forest, never all pairs of a group. A large cluster of near copies is so many short lists.

Only the bound on recall is probabilistic: by default a pair at exactly the threshold is lost with probability below 1e-4.

Defined results: null and empty texts (no words) link with nothing; a text of fewer than five words is one shingle; rows
that repeat a text are linked to each other and to all that it links to; an empty table gives an empty result; further
columns stay.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.llm.common import forget, packed, read, unpacked, written
from corvine.llm.components import components
from corvine.llm.shingles import portions, shingles

THRESHOLD, TARGET_RECALL = 0.8, 0.9999
TOKENS, BRANCHES, SMALL, DEPTH = 64, 2, 1024, 4
#: Of the tokens as many must agree for a candidate: 4.7 standard deviations below what the threshold expects.
AGREE = 36
LEAF_BLOCK, DIFF_BLOCK, VOCABULARY_BLOCK = 2048, 2048, 4096
_RANDOM = np.random.Generator(np.random.PCG64(6))
_A = _RANDOM.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def runs(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, branches: int = BRANCHES, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold is together in a leaf with probability ``recall``, if all its buckets are large."""
    lost = 0.0
    for _ in range(depth):
        lost = (1 - threshold * (1 - lost)) ** branches
    return math.ceil(math.log(1 - recall) / math.log(lost))


def signatures(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """MinHash tokens, digest of the words, and the number of shingles (repeats included) of each text."""
    out = np.zeros((len(texts), TOKENS), dtype=np.uint32)
    digests: list[bytes] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    row = 0
    for some in portions(texts):
        values, offsets, own = shingles(some)
        digests += own
        n = np.diff(offsets)
        counts[row : row + len(some)] = n
        full = np.flatnonzero(n)
        if len(full):
            for j in range(TOKENS):
                hashed = ((values * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32)
                out[row + full, j] = np.minimum.reduceat(hashed, offsets[full])
        row += len(some)
    return out, digests, counts


def _stored(docs: DataFrame) -> DataFrame:
    """(text, doc_id, rest) as a table: j_id, j_digest, j_size, j_tokens, their low bytes, the compressed text, doc_id, rest."""
    schema = T.StructType(T.StructType.fromDDL("j_id long, j_digest binary, j_size long, j_tokens array<int>, j_sketch binary, j_text binary").fields + [docs.schema["doc_id"], docs.schema["rest"]])

    def run(batches):
        import pyarrow as pa
        import zstandard
        forget()
        from pyspark import TaskContext

        pack, at = zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            tokens, digests, sizes = signatures(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tokens.size + 1, TOKENS, dtype=np.int32)), pa.array(tokens.view(np.int32).reshape(-1)))
            columns = [pa.array(range(at, at + len(texts)), pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes), lists, pa.array([row.tobytes() for row in tokens.astype(np.uint8)], pa.binary()), pa.array(map(pack, texts), pa.binary())]
            at += len(texts)
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[1:]], names=schema.names)

    return written(docs.mapInArrow(run, schema), "jaccard-docs")


def leaves(nodes: DataFrame, n_runs: int) -> DataFrame:
    """(node, j_tokens) -> (path, node, n): the leaves with two nodes or more."""
    tokens = nodes.select("node", "j_tokens")
    first = [(r, int(i)) for r in range(n_runs) for i in np.random.Generator(np.random.PCG64(100 + r)).choice(TOKENS, BRANCHES, replace=False)]
    start = F.array(*[F.xxhash64(F.lit(r), F.lit(i), F.get("j_tokens", F.lit(i))) for r, i in first])
    paths = tokens.select("node", F.explode(start).alias("path"))
    found = []
    for depth in range(1, DEPTH + 1):
        paths = written(paths, f"paths-{depth}")
        sizes = paths.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        if depth == DEPTH:
            found.append(paths.join(sizes.hint("merge"), "path"))
            break
        sizes = written(sizes, f"sizes-{depth}")
        found.append(paths.join(sizes.filter(F.col("n") <= SMALL).hint("merge"), "path"))
        large = sizes.filter(F.col("n") > SMALL).select("path")
        if large.isEmpty():
            break
        at = [F.pmod(F.xxhash64(F.col("path"), F.lit(b)), F.lit(TOKENS)).cast("int") for b in range(BRANCHES)]
        deeper = paths.join(large, "path", "left_semi").join(tokens, "node")
        paths = deeper.select("node", F.explode(F.array_distinct(F.array(*[F.xxhash64("path", i, F.get("j_tokens", i)) for i in at]))).alias("path"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def in_blocks(rows: DataFrame, key: str, node: str, n: str, size: int, order: str | None = None) -> DataFrame:
    """Deals each group to ceil(n / size) blocks, and its rows to the pairs of blocks: adds block_a, block_b, mine (block of the row).

    Each pair of blocks is sorted by ``order``, or else by node.
    """
    rows = rows.withColumn("blocks", F.ceil(F.col(n) / size).cast("int")).withColumn("mine", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("block_a", F.least("mine", "other")).withColumn("block_b", F.greatest("mine", "other"))
    return rows.repartition(key, "block_a", "block_b").sortWithinPartitions(key, "block_a", "block_b", order or node)


def grouped(batches, n_keys: int):
    """Arrow batches sorted by their first columns -> one table for each value of these."""
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(n_keys)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[a].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def least_neighbours(near: np.ndarray) -> np.ndarray:
    """Of a symmetric matrix of links, the least place that each place can reach."""
    n = len(near)
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        new = np.minimum(new, label)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def candidate_links(members: DataFrame) -> DataFrame:
    """(path, block_a, block_b, node, j_sketch), sorted -> (a, b): a spanning forest of what agrees in each unit."""

    def run(batches):
        import pyarrow as pa

        out_a: list[np.ndarray] = []
        out_b: list[np.ndarray] = []
        held = 0

        def batch_out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

        for group in grouped(batches, 3):
            nodes = group.column(3).to_numpy()
            if len(nodes) < 2:
                continue
            tokens = np.frombuffer(b"".join(group.column(4).to_pylist()), np.uint8).reshape(len(nodes), TOKENS)
            if len(nodes) == 2:
                pairs = np.array([[0, 1]]) if (tokens[0] == tokens[1]).sum() >= AGREE else np.zeros((0, 2), np.int64)
            else:
                agree = np.zeros((len(nodes), len(nodes)), dtype=np.uint8)
                for j in range(TOKENS):
                    agree += tokens[:, j][:, None] == tokens[:, j][None, :]
                label = least_neighbours(agree >= AGREE)
                moved = np.flatnonzero(label != np.arange(len(nodes)))
                pairs = np.stack([moved, label[moved]], axis=1)
            if len(pairs):
                out_a.append(nodes[pairs[:, 0]])
                out_b.append(nodes[pairs[:, 1]])
                held += len(pairs)
            if held > 10_000:
                yield batch_out()
                out_a, out_b, held = [], [], 0
        if held:
            yield batch_out()

    return members.select("path", "block_a", "block_b", "node", "j_sketch").mapInArrow(run, "a long, b long")


def shared_counts(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """How many elements each two sets share: of ``sets`` with one another, or with ``others``."""
    every = sets if others is None else sets + others
    sizes = [len(s) for s in every]
    values, ids = np.unique(np.concatenate(every), return_inverse=True)
    rows = np.repeat(np.arange(len(every)), sizes)
    often = np.bincount(ids) > 1
    number = np.cumsum(often) - 1
    keep = often[ids]
    rows, ids = rows[keep], number[ids[keep]]
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    n = len(sets)
    out = np.zeros((n, len(every) - (0 if others is None else n)), dtype=np.float32)
    for low in range(0, int(often.sum()), VOCABULARY_BLOCK):
        a, b = np.searchsorted(ids, (low, low + VOCABULARY_BLOCK))
        has = np.zeros((len(every), min(VOCABULARY_BLOCK, int(often.sum()) - low)), dtype=np.float32)
        has[rows[a:b], ids[a:b] - low] = 1
        out += has[:n] @ (has if others is None else has[n:]).T
    return out


def differences(members: DataFrame) -> DataFrame:
    """(cluster, node, copies, n, j_text, r_text) -> (cluster, node, copies, n, r_size, size, lost, diff): each set beside that of its cluster's representative.

    ``size`` is how many different shingles the node has, and ``diff`` the ``lost`` ones of the representative's ``r_size``
    that it hasn't (as places, even numbers), then those that it has beside them (as hashes, odd numbers).
    """
    schema = "cluster long, node long, copies long, n long, r_size long, size long, lost long, diff binary"

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in batches:
            r_size, size, lost, diff = [], [], [], []
            texts, whole = (batch.column(i).to_pylist() for i in (4, 5))
            at = 0
            for some in portions([unpack(t) for t in texts]):
                values, offsets, _ = shingles(some)
                for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    if held[0] != whole[at]:
                        held = whole[at], np.unique(shingles([unpack(whole[at])])[0])
                    own, first = np.unique(values[x:y]), held[1]
                    there = np.searchsorted(own, first)
                    shared = own[np.minimum(there, len(own) - 1)] == first
                    missed, extra = np.flatnonzero(~shared), np.setdiff1d(own, first[shared], assume_unique=True)
                    r_size.append(len(first))
                    size.append(len(own))
                    lost.append(len(missed))
                    diff.append(np.concatenate([missed.astype(np.uint64) << np.uint64(1), extra | np.uint64(1)]).tobytes())
                    at += 1
            made = [pa.array(x, pa.int64()) for x in (r_size, size, lost)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made, pa.array(diff, pa.binary())], names=[x.split()[0] for x in schema.split(", ")])

    return members.select("cluster", "node", "copies", "n", "j_text", "r_text").mapInArrow(run, schema)


def verified_links(members: DataFrame, threshold: float) -> DataFrame:
    """(cluster, block_a, block_b, node, mine, copies, r_size, size, lost, diff), sorted -> (a, b, links): exact links of each unit.

    Two sets share what the representative has and neither lost, and what both have beside it. A row with b null gives
    links of a: the documents that it links to in this unit. The other rows are a spanning forest.
    """

    def run(batches):
        import pyarrow as pa

        for group in grouped(batches, 3):
            nodes, mine, copies, r_size, size, lost = (group.column(i).to_numpy() for i in (3, 4, 5, 6, 7, 8))
            if len(nodes) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in group.column(9).to_pylist()]
            block_a, block_b = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            p = np.flatnonzero(mine == block_a)
            q = p if block_a == block_b else np.flatnonzero(mine == block_b)
            if not len(p) or not len(q):
                continue
            shared = shared_counts([sets[i] for i in p], None if q is p else [sets[i] for i in q])
            shared += (r_size[p] - lost[p])[:, None].astype(np.float32) - lost[q][None, :].astype(np.float32)
            near = shared >= threshold * (size[p].astype(np.float64)[:, None] + size[q][None, :] - shared) - 1e-6
            links = np.zeros(len(nodes))
            if q is p:
                np.fill_diagonal(near, False)
                links[p] = near @ copies[p].astype(np.float64)
            else:
                links[p], links[q] = near @ copies[q].astype(np.float64), near.T @ copies[p].astype(np.float64)
            label = np.arange(len(nodes))
            while True:
                new = label.copy()
                new[p] = np.minimum(new[p], np.where(near, label[q][None, :], len(nodes)).min(axis=1))
                new[q] = np.minimum(new[q], np.where(near, new[p][:, None], len(nodes)).min(axis=0))
                new = new[new]
                if (new == label).all():
                    break
                label = new
            moved, has = np.flatnonzero(label != np.arange(len(nodes))), np.flatnonzero(links)
            a = np.concatenate([nodes[has], nodes[moved]])
            b = pa.array(np.concatenate([nodes[has], nodes[label[moved]]]), mask=np.arange(len(a)) < len(has))
            n_links = np.concatenate([links[has], np.zeros(len(moved))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n_links)], names=["a", "b", "links"])

    return members.select("cluster", "block_a", "block_b", "node", "mine", "copies", "r_size", "size", "lost", "diff").mapInArrow(run, "a long, b long, links long")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL) -> DataFrame:
    """Adds to documents (doc_id, text, ...) j_text (the compressed text, in place of text), n_links, component_id (least doc_id that links reach, its own included) and kept.

    ``kept`` is true for one row of each component.
    """
    # both sides of the joins below grow with the corpus: none is broadcast, at any size
    docs, names = packed(docs, "text", "doc_id")
    stored = _stored(docs)
    nodes = stored.filter("j_size > 0").groupBy("j_digest").agg(F.min("j_id").alias("node"), F.count("*").alias("copies"))
    nodes = written(nodes, "jaccard-nodes")
    heads = stored.join(nodes.select(F.col("node").alias("j_id"), F.col("node"), "copies").hint("merge"), "j_id")
    tokens = written(heads.select("node", "j_tokens", "j_sketch"), "jaccard-tokens")
    units = in_blocks(leaves(tokens, runs(threshold, recall)).join(tokens.select("node", "j_sketch").hint("merge"), "node"), "path", "node", "n", LEAF_BLOCK)
    clusters = written(components(candidate_links(units)).withColumnRenamed("component", "cluster"), "jaccard-clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    # the node that a cluster is called by stands for it: the others are told by what differs
    texts = heads.select("node", "copies", "j_text")
    whole = texts.join(sizes.withColumnRenamed("cluster", "node").hint("merge"), "node").select(F.col("node").alias("cluster"), "n", F.col("j_text").alias("r_text"))
    whole = written(whole, "jaccard-representatives")  # so that Spark may split a large cluster in the join with it
    members = texts.join(clusters.hint("merge"), "node").join(whole.hint("merge"), "cluster")
    differing = written(differences(members), "jaccard-differences")
    links = written(verified_links(in_blocks(differing, "cluster", "node", "n", DIFF_BLOCK), threshold), "jaccard-links")
    counts = links.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("other_links"))
    groups = components(links.filter("b IS NOT NULL"))
    known = nodes.join(counts.hint("merge"), "node", "left").join(groups.hint("merge"), "node", "left").select("j_digest", "copies", "other_links", F.coalesce("component", "node").alias("j_group"))
    placed = written(stored.select("j_id", "j_digest", "j_size", "doc_id").join(known.hint("merge"), "j_digest", "left").select("j_id", "doc_id", "copies", "other_links", F.when(F.col("j_size") > 0, F.col("j_group")).alias("j_group")), "jaccard-groups")
    # written, so that Spark may split the rows of a large group in the join behind it
    first = written(placed.filter("j_group IS NOT NULL").groupBy("j_group").agg(F.min("doc_id").alias("g_doc"), F.min(F.struct("doc_id", "j_id")).alias("g_first")), "jaccard-first")
    found = placed.join(first.hint("merge"), "j_group", "left").select(
        "j_id",
        F.when(F.col("j_group").isNull(), 0).otherwise(F.col("copies") - 1 + F.coalesce("other_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("j_group").isNull(), F.col("doc_id")).otherwise(F.col("g_doc")).alias("component_id"),
        F.coalesce(F.col("g_first.j_id") == F.col("j_id"), F.lit(True)).alias("kept"),
    )
    return stored.select("j_id", "doc_id", "rest", "j_text").join(found.hint("merge"), "j_id").select("doc_id", *unpacked(names, "j_text", "n_links", "component_id", "kept"))


def with_text(joined: DataFrame) -> DataFrame:
    """Puts ``text`` back for ``j_text``."""
    rest = [c for c in joined.columns if c != "j_text"]
    schema = T.StructType([T.StructField("text", T.StringType())] + [joined.schema[c] for c in rest])

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([unpack(t).decode() for t in batch.column(0).to_pylist()], pa.string()), *batch.columns[1:]], names=schema.names)

    return joined.select("j_text", *[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join(docs).select("doc_id", "component_id", "n_links", "kept")


#: All pairs that share a shingle, and their exact similarity.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT r, md5(array_to_string(w[i:i + 4], ' ')) AS shingle FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0) GROUP BY ALL
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), link AS (
  SELECT p.a, p.b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.r <> y.r GROUP BY ALL) p JOIN n na ON na.r = p.a JOIN n nb ON nb.r = p.b
  WHERE c >= 0.8::DOUBLE * (na.n + nb.n - c) - 1e-6::DOUBLE
), degree AS (
  SELECT a AS r, count(*) AS n_links FROM link GROUP BY a
), reach AS (
  SELECT r, r AS to_r FROM d
  UNION
  SELECT reach.r, link.b FROM reach JOIN link ON reach.to_r = link.a
), least AS (
  SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON reach.to_r = d.r GROUP BY reach.r
)
SELECT d.doc_id, least.component_id, CAST(coalesce(degree.n_links, 0) AS BIGINT) AS n_links, d.doc_id = least.component_id AS kept
FROM d JOIN least USING (r) LEFT JOIN degree USING (r)
"""
