"""Token ids in a binary format of patched frame-of-reference blocks, written and read back by Spark.

A shard holds the ids of consecutive documents (little-endian throughout)::

    "TKB1"  u32 ids  u32 ids in a block  u32 blocks  u32 x (blocks + 1): where each block starts in the body
    block:  u32 base  u8 width  u8 0  u16 exceptions
            ids - base, low ``width`` bits each, packed from the low bit
            u16 x exceptions: place    u32 x exceptions: the bits above ``width``

The base is the least id of the block, and the width what ``PERCENTILE`` of the differences fit in; the others are the
exceptions. The index of block starts lets a reader take any block on its own.

Documents are dealt by ranges of doc_id (of one doc_id, by how their texts begin) and sorted, and each task cuts its documents into shards: a shard ends behind the
document that fills it. Shards are rows of a Parquet table in the shared folder (part, shard, ids of its documents, their
lengths, the body), so Spark's commit protocol covers lost executors, and the writer needs no file system but Spark's.
Where a document starts in the whole stream follows from sums over shards: in a part by a window over its shards, and
over parts by a window over one row per part.

Defined results: a null text is an empty one, which still gets its end id; rows that repeat a doc_id are in the stream one
after the other, by text; a null doc_id comes first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import gc
import os
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.llm.common import read, table_path
from corvine.llm.pieces import Pieces

VOCABULARY = "byte_bpe_50k.json"
END_ID, BLOCK, PERCENTILE, SHARD_IDS = 0, 1024, 97, 1 << 18
REMEMBERED = 500_000
#: Blocks that are packed together.
TOGETHER = 64
#: Characters of a text that rows of one doc_id are dealt by.
RANGED = 32
MAGIC = b"TKB1"
SHARDS = "part int, shard int, n_ids long, doc_ids array<long>, lengths array<int>, body binary"


def lanes(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values, the low ``width`` bits of each packed from the low bit, as rows of bytes: 32 values fill ``width`` words."""
    rows, n = values.shape
    if n % 32:
        values = np.pad(values, ((0, 0), (0, -n % 32)))
    by_place = np.ascontiguousarray((values & np.uint32((1 << width) - 1)).reshape(-1, 32).T)
    words = np.zeros((width, by_place.shape[1]), dtype=np.uint32)
    for place in range(32 if width else 0):
        at, shift = divmod(place * width, 32)
        words[at] |= by_place[place] << np.uint32(shift)
        if shift + width > 32:
            words[at + 1] |= by_place[place] >> np.uint32(32 - shift)
    return np.ascontiguousarray(words.T, dtype="<u4").view(np.uint8).reshape(rows, -1 if width else 0)


def from_lanes(data: bytes, rows: int, n: int, width: int) -> np.ndarray:
    """The rows of ``n`` values again."""
    if not width:
        return np.zeros((rows, n), dtype=np.uint32)
    words = np.ascontiguousarray(np.frombuffer(data, "<u4").reshape(-1, width).T, dtype=np.uint32)
    by_place = np.empty((32, words.shape[1]), dtype=np.uint32)
    for place in range(32):
        at, shift = divmod(place * width, 32)
        by_place[place] = words[at] >> np.uint32(shift)
        if shift + width > 32:
            by_place[place] |= words[at + 1] << np.uint32(32 - shift)
    by_place &= np.uint32((1 << width) - 1)
    return by_place.T.reshape(rows, -1)[:, :n]


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The ids as one shard. Blocks of equal width are packed together."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    n_blocks = -(-len(ids) // block)
    bodies = []
    for at in range(0, len(ids), block * TOGETHER):
        some = ids[at : at + block * TOGETHER]
        rows = -(-len(some) // block)
        grid = np.full((rows, block), some[-1] if len(some) else 0, dtype=np.uint32)
        grid.reshape(-1)[: len(some)] = some
        base = grid.min(axis=1)
        over = grid - base[:, None]
        bound = np.partition(over, int(block * percentile / 100) - 1, axis=1)[:, int(block * percentile / 100) - 1].astype(np.uint64)
        width = np.ceil(np.log2(bound + 1.0)).astype(np.int64)
        over.reshape(-1)[len(some) :] = 0
        low: list[bytes] = [b""] * rows
        for w in np.unique(width).tolist():
            equal = np.flatnonzero(width == w)
            for row, data in zip(equal.tolist(), lanes(over[equal], w), strict=True):
                low[row] = data[: -(-min(block, len(some) - row * block) * w // 8)].tobytes()
        high = np.where(width[:, None] < 32, over >> np.minimum(width, 31).astype(np.uint32)[:, None], np.uint32(0))
        in_row, places = np.nonzero(high)
        bounds = np.searchsorted(in_row, np.arange(rows + 1)).tolist()
        above, places = high[in_row, places].astype("<u4"), places.astype("<u2")
        for row, (least, w) in enumerate(zip(base.tolist(), width.tolist(), strict=True)):
            a, b = bounds[row : row + 2]
            bodies.append(b"".join((least.to_bytes(4, "little"), bytes((w, 0)), (b - a).to_bytes(2, "little"), low[row], places[a:b].tobytes(), above[a:b].tobytes())))
    starts = np.zeros(n_blocks + 1, dtype="<u4")
    np.cumsum([len(b) for b in bodies], out=starts[1:]) if bodies else None
    return b"".join([MAGIC, np.array([len(ids), block, n_blocks], dtype="<u4").tobytes(), starts.tobytes(), *bodies])


def unpack(shard: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (excluded) of a shard; all by default."""
    if shard[:4] != MAGIC:
        raise ValueError("not a token shard")
    n, block, n_blocks = (int(x) for x in np.frombuffer(shard, "<u4", 3, 4))
    starts = (np.frombuffer(shard, "<u4", n_blocks + 1, 16).astype(np.int64) + 16 + 4 * (n_blocks + 1)).tolist()
    last = n_blocks if last is None else min(last, n_blocks)
    out = np.empty((max(0, last - first), block), dtype=np.uint32)
    for begin in range(first, last, TOGETHER):
        grid = out[begin - first :][:TOGETHER]
        heads = [(at, int.from_bytes(shard[at : at + 4], "little"), shard[at + 4], int.from_bytes(shard[at + 6 : at + 8], "little")) for at in starts[begin : begin + len(grid)]]
        sizes = [-(-min(block, n - b * block) * w // 8) for b, (_, _, w, _) in enumerate(heads, begin)]
        for w in {w for _, _, w, _ in heads}:
            equal = [row for row, head in enumerate(heads) if head[2] == w]
            full = 4 * w * -(-block // 32)
            data = b"".join([shard[heads[row][0] + 8 : heads[row][0] + 8 + sizes[row]].ljust(full, b"\0") for row in equal])
            grid[equal] = from_lanes(data, len(equal), block, w)
        for values, size, (at, _, w, n_places) in zip(grid, sizes, heads, strict=True):
            if n_places:
                places = np.frombuffer(shard, "<u2", n_places, at + 8 + size)
                values[places] |= np.frombuffer(shard, "<u4", n_places, at + 8 + size + 2 * n_places) << np.uint32(w)
        grid += np.array([base for _, base, _, _ in heads], dtype=np.uint32)[:, None]
    return out.reshape(-1)[: max(0, min(n, last * block) - first * block)]


class Encoder:
    """The library's tokenizer, with a memory of pieces, for one Python worker."""

    def __init__(self, path: str, limit: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size_of = self._sizes()
        # the library finds these before it cuts a text by its pattern
        added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.joined = 1 if any(" " in x for x in added) else 256
        self.pieces = Pieces(self.encode_all, self.encode_whole, limit, added)

    def _sizes(self) -> np.ndarray:
        """The bytes that each id stands for: of an ordinary token as many as it has characters, as each is a byte."""
        special = {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            sizes[i] = special.get(i) or len(token)
        return sizes

    def encode_all(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as bytes. Pieces that begin with a space are encoded many in one text and cut apart again."""
        alone = [i for i, p in enumerate(pieces) if p[:1] != " "]
        rest = [i for i, p in enumerate(pieces) if p[:1] == " "]
        out: list[bytes] = [b""] * len(pieces)
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
        groups = [rest[i : i + self.joined] for i in range(0, len(rest), self.joined)]
        encoded = self.tokenizer.encode_batch_fast(["".join([pieces[i] for i in g]) for g in groups], add_special_tokens=False)
        # each group's ids stand for all its bytes, so sums may run through all groups
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in encoded] or [np.empty(0, "<u4")])
        cuts = np.searchsorted(np.cumsum(self.size_of[ids]), np.cumsum([len(pieces[i].encode()) for i in rest]), side="right")
        data, at = ids.tobytes(), 0
        for i, cut in zip(rest, (4 * cuts).tolist(), strict=True):
            out[i] = data[at:cut]
            at = cut
        return out

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    made = Encoder(path)
    gc.freeze()  # tables for the worker's life, which the collector need not walk through
    return made


def write_tokens(docs: DataFrame, to: str, vocabulary: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encodes (doc_id, text) and writes the shards, in ascending doc_id order, as a table at ``to``."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own, part, end = encoder(vocabulary), TaskContext.get().partitionId(), np.array([end_id], dtype="<u4").tobytes()
        doc_ids, lengths, data, held, shard = [], [], [], 0, 0

        def row():
            ids = np.frombuffer(b"".join(data), "<u4")
            values = ([part], [shard], [len(ids)], [doc_ids], [lengths], [pack(ids)])
            types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["part", "shard", "n_ids", "doc_ids", "lengths", "body"])

        for batch in batches:
            ids, counts = own.pieces.of(batch.column(1))
            encoded, at = memoryview(ids.tobytes()), 0
            for doc_id, count in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                doc_ids.append(doc_id)
                lengths.append(count + 1)
                data += (encoded[at : at + 4 * count], end)
                at += 4 * count
                held += count + 1
                if held >= shard_ids:
                    yield row()
                    doc_ids, lengths, data, held, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield row()

    # a prefix has the order of the texts, so many rows of one doc_id need not meet in one task
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.substring("text", 1, RANGED)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SHARDS).write.parquet(to)


def read_tokens(spark: SparkSession, at: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and with ``keep_ids`` ids) from the shards at ``at``."""
    shards = spark.read.schema(SHARDS).parquet(at)
    sizes = shards.select("part", "shard", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("part_start"))
    starts = sizes.withColumn("shard_start", before(Window.partitionBy("part").orderBy("shard"))).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("shard_start"))
    schema = "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, shard, _, doc_ids, lengths, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = unpack(body).astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                columns = [pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                if keep_ids:
                    columns.append(pa.array(np.split(ids.astype(np.int32), ends[:-1]), pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)

    rows = shards.mapInArrow(run, schema).join(starts, ["part", "shard"])
    return rows.select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def op7_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    to = table_path(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), to, public_tokenizers.path(VOCABULARY))
    return read_tokens(spark, to)
