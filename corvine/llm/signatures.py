"""Ranked search over bit-sliced Bloom signatures.

1. *Index*, in one pass over the texts. A document's keys are its terms, and for each term that occurs often (term, level)
   for the levels of ``LEVELS`` that its number of occurrences reaches. Documents of about the same number of keys make a
   block of bit slices: row r of a block has one bit a document, which is set if a key of the document has r among its
   ``HASHES`` places. How many rows a block has follows from the number of keys. The same pass puts out each document's
   terms with their occurrences, and in how many documents of a task each term is.
2. *Bounds.* A term's slices are combined by AND: the bitmap has every document that holds the key, and a few others. Summed
   up with the terms' weights, level by level, with what a document of this length can score at most at the level, they give
   an upper bound of each document's score for each item.
3. *Threshold.* The ``FIRST`` documents with the highest bounds are scored exactly for each item. The score of the k-th of
   them is a score that the k-th of all documents reaches at least.
4. *Rescoring.* Every document whose bound reaches that is scored exactly, and no other, as it is provably no result.

Items go to the executors in portions of a bounded number of terms (``PORTION``; an item is never cut), one after the other.
Term weights, thresholds and documents' scores never meet in one task.

Defined results: a null text has no terms; items or documents without a term have no result; rows that repeat a doc_id are
documents of their own, and items that repeat an item_id are one item by text each; null doc_ids come last among equal
scores; an empty table on either side gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.llm.common import read, written
from corvine.llm.shingles import portions

K = 20
#: Documents an item that give the threshold.
FIRST = 60
#: Occurrences at which a term has one key more; rows of a block a key, and places of a key.
LEVELS = (1, 2, 3, 4, 5, 6, 8, 10, 13, 17, 22, 29, 38, 50, 70, 100, 150, 250, 500, 1000, 4000, 20000)
ROWS, HASHES = 10, 4
#: Documents of a block at most, its bits at most (with eight documents more), and terms of a portion of items.
BLOCK, BITS, PORTION = 1024, 1 << 25, 20_000
#: Different terms that a task counts documents of before it puts the counts out.
COUNTED = 500_000
#: Separators become spaces, and only A to Z are lower-cased; bytes beyond ASCII belong to terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
INDEX = "doc long, doc_id long, n long, terms binary, term binary, df long, rows int, docs array<long>, ns array<long>, slices binary"


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text: maximal runs of ASCII letters, digits and all that is beyond ASCII."""
    return text.translate(_TERMS).split() if text else []


def hashed(values: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, values), np.uint64, len(values))


def places(hashes: np.ndarray, level: int | np.ndarray, rows: int | np.ndarray) -> np.ndarray:
    """(key, place): the rows of a block of ``rows`` rows that a key of this level sets."""
    mixed = (hashes + np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    at = (mixed & np.uint64(0xFFFFFFFF))[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)
    at = (at * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)
    rows = np.asarray(rows, dtype=np.uint64)
    return ((at * (rows[:, None] if rows.ndim else rows)) >> np.uint64(32)).astype(np.int64)


def rows_of(keys: int) -> tuple[int, int]:
    """(rows, documents) of the blocks for documents of so many keys: classes are a half power of two wide."""
    rows = max(64, math.ceil(ROWS * 2 ** (math.ceil(2 * math.log2(max(keys, 1))) / 2)))
    return rows, max(8, min(BLOCK, BITS // rows // 8 * 8))


class Blocks:
    """Blocks that are being filled, one a class of documents."""

    def __init__(self):
        self.open: dict[int, list] = defaultdict(list)

    def add(self, rows: int, full: int, doc: int, n: int, at: np.ndarray):
        own = self.open[rows]
        own.append((doc, n, at))
        if len(own) == full:
            yield self.closed(rows)

    def closed(self, rows: int) -> tuple:
        own = self.open.pop(rows)
        bits = np.zeros((rows, -(-len(own) // 8) * 8), dtype=bool)
        for column, (_, _, at) in enumerate(own):
            bits[at, column] = True
        return rows, [d for d, _, _ in own], [n for _, n, _ in own], np.packbits(bits, axis=1, bitorder="little").tobytes()


def index(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> rows of three kinds: documents (doc, doc_id, n, terms), documents that hold a term (term, df), blocks (rows, docs, ns, slices)."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("term", pa.binary()), ("df", pa.int64()), ("rows", pa.int32()), ("docs", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64())), ("slices", pa.binary())])

        def batch_of(length: int, **columns):
            return pa.RecordBatch.from_arrays([(c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type)) if f.name in columns else pa.nulls(length, f.type) for f in schema], schema=schema)

        def block_of(block: tuple):
            return batch_of(1, **{k: [v] for k, v in zip(("rows", "docs", "ns", "slices"), block, strict=True)})

        doc, blocks, df, known = TaskContext.get().partitionId() << 33, Blocks(), Counter(), {}
        levels = np.array(LEVELS)
        for batch in batches:
            at = 0
            for some in portions([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]):
                ids, at = batch.column(0).slice(at, len(some)), at + len(some)
                found = [terms(t) for t in some]
                there = [i for i, x in enumerate(found) if x]
                if not there:
                    continue
                counts = [Counter(found[i]) for i in there]
                ns, own = [len(found[i]) for i in there], [t for c in counts for t in c]
                for c in counts:
                    df.update(c.keys())
                if len(known) > COUNTED:
                    known.clear()
                new = list({t for t in own if t not in known})
                known.update(zip(new, hashed(new).tolist(), strict=True))
                hashes = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
                reached = np.searchsorted(levels, np.fromiter((x for c in counts for x in c.values()), np.int64, len(own)), side="right")
                level = np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached)
                keys = np.add.reduceat(reached, np.cumsum([0, *map(len, counts)])[:-1])
                shapes = [rows_of(n) for n in keys.tolist()]
                places_of = np.split(places(np.repeat(hashes, reached), level, np.repeat([rows for rows, _ in shapes], keys)), np.cumsum(keys)[:-1])
                rows_named = range(doc, doc + len(there))
                doc += len(there)
                held = [b" ".join(c) + b"\n" + b" ".join(map(b"%d".__mod__, c.values())) for c in counts]
                yield batch_of(len(there), doc=list(rows_named), doc_id=ids.take(pa.array(there)), n=ns, terms=held)
                for (rows, full), name, n, set_by in zip(shapes, rows_named, ns, places_of, strict=True):
                    for b in blocks.add(rows, full, name, n, set_by.reshape(-1)):
                        yield block_of(b)
                if len(df) > COUNTED:
                    yield batch_of(len(df), term=list(df), df=list(df.values()))
                    df.clear()
        for rows in list(blocks.open):
            yield block_of(blocks.closed(rows))
        if df:
            yield batch_of(len(df), term=list(df), df=list(df.values()))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX)


def asked_terms(items: DataFrame) -> DataFrame:
    """(item_id, text) -> (item, item_id, term, times)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for item, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = Counter(terms(text.encode() if text else None))
                n = len(counts)
                yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array([item_id] * n, pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["item", "item_id", "term", "times"])

    return items.select("item", "item_id", "text").mapInArrow(run, "item long, item_id long, term binary, times long")


class Portion:
    """Some items: their terms with weights, as arrays that tasks share."""

    def __init__(self, rows: list, n_docs: int, length: int, k: int):
        self.n_docs, self.length, self.k = n_docs, length, k
        self.items = sorted({r["item"] for r in rows})
        at = {item: i for i, item in enumerate(self.items)}
        self.terms = sorted({r["term"] for r in rows})
        term_at = {t: i for i, t in enumerate(self.terms)}
        weight = {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in rows}
        self.weight = [weight[t] for t in self.terms]
        self.of_item: list[list[tuple[int, int]]] = [[] for _ in self.items]
        for r in rows:
            self.of_item[at[r["item"]]].append((term_at[r["term"]], r["times"]))

    def m(self, n):
        """The length factor of documents of ``n`` terms."""
        return 100 - 25 + (25 * n * self.n_docs) // self.length

    def bounds(self, rows: int, ns: list[int], slices: bytes) -> np.ndarray:
        """(item, document) -> an upper bound of the score, for one block."""
        if not hasattr(self, "hashes"):
            self.hashes = hashed(self.terms)
            self.lists = [(np.array([t for t, _ in own]), np.array([float(self.weight[t] * times) for t, times in own])) for own in self.of_item]
        grid = np.frombuffer(slices, np.uint8).reshape(rows, -1)
        m, n = self.m(np.array(ns, dtype=np.int64)).astype(np.float64), np.array(ns, dtype=np.float64)
        out, alive, before, last = np.zeros((len(self.items), len(ns))), np.arange(len(self.terms)), np.zeros(len(ns)), None
        for level in range(len(LEVELS)):
            at = places(self.hashes[alive], level, rows)
            bits = grid[at[:, 0]]
            for h in range(1, HASHES):
                bits = bits & grid[at[:, h]]
            if level:
                bits &= last  # who lacks a lower level lacks this one
            some = bits.any(axis=1)
            alive, last = alive[some], bits[some]
            if not len(alive):
                break
            tf = np.minimum(n, LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else np.inf)
            most = 1e9 * tf / (1000 * tf + 12 * m)
            gain, before = most - before, most
            there = np.unpackbits(last, axis=1, count=len(ns), bitorder="little")
            where = np.full(len(self.terms), -1)
            where[alive] = np.arange(len(alive))
            for i, (own, weights) in enumerate(self.lists):
                place = where[own]
                held = place >= 0
                if held.any():
                    out[i] += (weights[held] @ there[place[held]]) * gain
        return out * (1 + 1e-9)

    def score(self, item: int, n: int, tf: dict[bytes, int]) -> int:
        m, total = self.m(n), 0
        for t, times in self.of_item[item]:
            if count := tf.get(self.terms[t]):
                total += times * (self.weight[t] * ((1_000_000_000 * count) // (1000 * count + 12 * m)))
        return total


def bounded(blocks: DataFrame, portion, thresholds: dict[int, int] | None, first: int = FIRST) -> DataFrame:
    """(item, doc, bound): of each task the ``first`` highest bounds of each item, or every one that reaches the item's threshold."""
    least = None if thresholds is None else blocks.sparkSession.sparkContext.broadcast(thresholds)

    def run(batches):
        import pyarrow as pa

        own = portion.value
        floor = None if least is None else np.array([max(1, least.value.get(i, 0)) for i in range(len(own.items))], dtype=np.float64)
        best, best_doc = np.zeros((len(own.items), 0)), np.zeros((len(own.items), 0), dtype=np.int64)

        def rows(item, doc, bound):
            return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(bound, pa.float64())], names=["item", "doc", "bound"])

        for batch in batches:
            for n_rows, docs, ns, slices in zip(*(batch.column(i) for i in range(4)), strict=True):
                docs = np.array(docs.as_py(), dtype=np.int64)
                bounds = own.bounds(n_rows.as_py(), ns.as_py(), slices.as_buffer())
                if floor is not None:
                    item, at = np.nonzero(bounds >= floor[:, None])
                    yield rows(item, docs[at], bounds[item, at])
                    continue
                best = np.concatenate([best, bounds], axis=1)
                best_doc = np.concatenate([best_doc, np.broadcast_to(docs, bounds.shape)], axis=1)
                if best.shape[1] > first:
                    top = np.argpartition(-best, first - 1, axis=1)[:, :first]
                    best, best_doc = np.take_along_axis(best, top, axis=1), np.take_along_axis(best_doc, top, axis=1)
        item, at = np.nonzero(best > 0)
        yield rows(item, best_doc[item, at], best[item, at])

    return blocks.select("rows", "docs", "ns", "slices").mapInArrow(run, "item int, doc long, bound double")


def scored(pairs: DataFrame, forward: DataFrame, portion) -> DataFrame:
    """(item, doc) -> (item, doc, doc_id, score), exactly; a document's items come together, at most a portion of them."""

    def run(batches):
        import pyarrow as pa

        own = portion.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, doc_id, n, held, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, counts = held.split(b"\n")
                tf = dict(zip(names.split(b" "), map(int, counts.split(b" ")), strict=True))
                for item in items:
                    for column, value in zip(out, (item, doc, doc_id, own.score(item, n, tf)), strict=True):
                        column.append(value)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["item", "doc", "doc_id", "score"])

    wanted = pairs.groupBy("doc").agg(F.collect_list("item").alias("items"))
    return forward.join(wanted, "doc").select("doc", "doc_id", "n", "terms", "items").mapInArrow(run, "item int, doc long, doc_id long, score long")


def _first(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text) x (item_id, text) -> item_id, rank, doc_id, score: the ``k`` documents of each item that score highest, above 0."""
    spark = docs.sparkSession
    held = written(index(docs), "signatures")
    forward, blocks = held.filter("doc IS NOT NULL"), held.filter("slices IS NOT NULL")
    n_docs, length = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    items = written(items.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("item", F.monotonically_increasing_id()), "items")
    asked = written(asked_terms(items), "item-terms")
    df = held.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    # a term that no document holds adds nothing
    asked = written(asked.join(df, "term"), "weighted")
    sizes = asked.groupBy("item").agg(F.count("*").alias("size"))
    running = F.sum("size").over(Window.orderBy("item").rowsBetween(Window.unboundedPreceding, -1))
    dealt = written(sizes.select("item", F.floor(F.coalesce(running, F.lit(0)) / PORTION).alias("portion")), "portions")
    results = []
    for r in dealt.groupBy("portion").count().orderBy("portion").toLocalIterator():
        own = dealt.filter(F.col("portion") == r["portion"])
        made = Portion(asked.join(own, "item").select("item", "term", "times", "df").collect(), n_docs, length, k)
        shared = spark.sparkContext.broadcast(made)
        first = max(FIRST, k)
        top = _first(bounded(blocks, shared, None, first), first, F.desc("bound"), F.col("doc"))
        exact = written(scored(written(top.select("item", "doc"), "first"), forward, shared), "first-scores")
        kth = _first(exact.filter("score > 0"), k, F.desc("score"), F.asc_nulls_last("doc_id"), F.col("doc"))
        thresholds = {r["item"]: r["score"] for r in kth.filter(F.col("rank") == k).select("item", "score").collect()}
        reach = written(bounded(blocks, shared, thresholds).select("item", "doc"), "reaching")
        found = _first(scored(reach, forward, shared).filter("score > 0"), k, F.desc("score"), F.asc_nulls_last("doc_id"), F.col("doc"))
        names = spark.createDataFrame(list(enumerate(made.items)), "item int, number long")
        found = found.join(F.broadcast(names), "item").join(items.select(F.col("item").alias("number"), "item_id"), "number")
        results.append(written(found.select("item_id", "rank", "doc_id", "score"), "ranked"))
        shared.unpersist()
    none = items.limit(0).select("item_id", F.lit(1).alias("rank"), F.col("item").alias("doc_id"), F.col("item").alias("score"))
    for found in results:
        none = none.unionByName(found)
    return none


def op11_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'TERM') AS ts FROM documents
), b AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'TERM') AS ts FROM benchmark
), asked AS (
  SELECT i, item_id, t, count(*) AS times FROM (SELECT i, item_id, unnest(ts) AS t FROM b) GROUP BY ALL
), tf AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY ALL
), total AS (
  SELECT count(*) AS n_docs, sum(len(ts)) AS l FROM d WHERE len(ts) > 0
), w AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t
), m AS (
  SELECT r, doc_id, CAST(75 + (25 * len(ts) * n_docs) // l AS BIGINT) AS m FROM d, total WHERE len(ts) > 0
), s AS (
  SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
""".replace("TERM", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
