"""Exact removal of long repeated substrings.

A byte goes if a string of ``length`` bytes covers it that starts at another place too, in any document. The named method,
inserting one byte of every document a round, needs as many rounds over the whole collection as the longest document has
bytes. So it runs here over the places where a repeat can be, which cuts the rounds to a constant:

1. *Anchors.* Of the grams of ``GRAM`` bytes in a window of ``length`` bytes the one with the least hash is its anchor.
   Equal windows have equal anchors at equal offsets, so a window repeats only if its anchor's gram does. About one place
   in a hundred is an anchor; Spark counts grams and keeps the anchors that occur twice or more.
2. *Contexts.* What surrounds such an anchor holds every window that it is the anchor of. Contexts are counted by hash:
   where one occurs twice, all its windows repeat. Only grams that have a context that occurs once, the places where
   repeats begin and end, go on, with one occurrence of each of their contexts.
3. *Columns.* The different contexts of a gram are sorted column by column from the right: each round inserts one byte of
   every context into the order of the suffixes so far (stable by the new byte, which is the step of a Burrows-Wheeler
   transform over a collection) and updates the common prefixes of neighbours. A window repeats if the common prefix with
   a neighbour is ``length`` or more. There are as many rounds as a context has bytes (under 400), whatever the documents' length.
   A gram with more than ``MANY`` different contexts is not gathered: its windows are hashed (128 bits) and counted by Spark.
4. *Spans.* What was found goes back to the documents, which are cut.

Documents travel compressed. A shared passage is a key with many rows only in joins that Spark can split, and in counts
that it sums before the shuffle.

Defined results: a null text is empty; a text shorter than ``length`` keeps all; rows that repeat a text are other places,
so they lose all of it; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.llm.common import forget, packed, read, unpacked, written

LENGTH, GRAM = 200, 32
#: Bytes of text handled at once in a task; different contexts of one gram that are gathered; contexts sorted at once.
PORTION, MANY, AT_ONCE = 1 << 20, 5_000, 20_000
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
PLACE_BITS = 21


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place on."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,)) * np.uint64(MIX[4])
    words ^= words >> np.uint64(32)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(GRAM // 8):
        out += words[8 * i : 8 * i + n] * np.uint64(MIX[i])
    out ^= out >> np.uint64(29)
    out *= np.uint64(MIX[4])
    out ^= out >> np.uint64(32)
    return out


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima from both ends of blocks."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    grid = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    grid[: len(values)] = values
    grid = grid.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).reshape(-1)
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its anchors' places and their grams' hashes."""
    width = length - GRAM + 1
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    some: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        data = np.frombuffer(b"".join(p for _, _, p in some), np.uint8)
        hashes = gram_hashes(data)
        keys = (hashes >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        least = least_in_window(keys, width)
        at = 0
        for i, start, part in some:
            own = least[at : at + len(part) - length + 1]
            places = own[np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))] & np.uint64((1 << PLACE_BITS) - 1)
            places = places.astype(np.int64)
            found[i].append((places - at + start, hashes[places].view(np.int64)))
            at += len(part)
        some.clear()

    for i, text in enumerate(texts):
        for start in range(0, max(0, len(text) - length + 1), PORTION - length + 1):
            part = text[start : start + PORTION]
            if some and held + len(part) > PORTION:
                flush()
                held = 0
            some.append((i, start, part))
            held += len(part)
    if some:
        flush()
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    out = []
    for parts in found:
        if len(parts) > 1:
            places, first = np.unique(np.concatenate([p for p, _ in parts]), return_index=True)
            out.append((places, np.concatenate([h for _, h in parts])[first]))
        else:
            out.append(parts[0] if parts else nothing)
    return out


def range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last] for each pair."""
    size = last - first + 1
    level = np.zeros(len(size), dtype=np.int64)
    level[size > 1] = np.log2(size[size > 1]).astype(np.int64)
    out, table = np.empty(len(size), dtype=values.dtype), values
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[: len(table) - half], table[half:])
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(table[first[mine]], table[last[mine] - (1 << k) + 1])
    return out


def repeated_windows(columns: np.ndarray, length: int) -> np.ndarray:
    """Contexts as columns (bytes x contexts) -> (window starts x contexts): whether another context has the same window there.

    The suffixes of all contexts are kept in order while a column is inserted in each round, from the last to the first.
    """
    size, n = columns.shape
    order, common = np.arange(n), np.zeros(n, dtype=np.int16)
    found = np.zeros((size - length + 1, n), dtype=bool)
    for j in range(size - 1, -1, -1):
        symbols = columns[j][order]
        step = np.argsort(symbols, kind="stable")
        symbols, order = symbols[step], order[step]
        same = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
        fresh = np.zeros(n, dtype=np.int16)
        if len(same):
            fresh[same] = np.minimum(range_least(common, step[same - 1] + 1, step[same]), length) + 1
        common = fresh
        if j <= size - length:
            equal = np.flatnonzero(common >= length)
            found[j, order[equal]] = True
            found[j, order[equal - 1]] = True
    return found


def spans_of(windows: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> list[list[int]]:
    """(window starts x contexts) -> for each context the ends of runs of covered bytes, counted from the anchor."""
    reach = windows.shape[0] - 1
    back = reach - np.arange(reach + 1)[:, None]  # the window starts so many bytes before the anchor
    ok = (windows & (back <= left) & (length - back <= right)).T
    edges = np.diff(np.pad(ok, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    out: list[list[int]] = [[] for _ in range(len(ok))]
    (who, begin), (_, end) = np.nonzero(edges == 1), np.nonzero(edges == -1)
    for i, a, b in zip(who.tolist(), begin.tolist(), end.tolist(), strict=True):
        out[i] += (a - reach, b - 1 - reach + length)
    return out


def _stored(docs: DataFrame, length: int) -> DataFrame:
    """(text, rest) as a table: r_id, the compressed text, its size, its anchors (place, hash of the gram, hash of the context), rest."""
    made = T.StructType.fromDDL("r_id long, r_text binary, r_size int, r_places array<int>, r_grams array<long>, r_codes array<long>")
    schema = T.StructType(made.fields + [docs.schema["rest"]])
    reach = length - GRAM

    def run(batches):
        import pyarrow as pa
        import xxhash
        import zstandard
        forget()
        from pyspark import TaskContext

        pack, row = zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId() << 33
        half = 1 << 63
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            found = anchors(texts, length)
            # the seed: contexts with equal bytes but the gram at another place must differ
            codes = [[xxhash.xxh64_intdigest(t[max(0, p - reach) : p + length], min(p, reach)) - half for p in places.tolist()] for t, (places, _) in zip(texts, found, strict=True)]
            columns = [pa.array(range(row, row + len(texts)), pa.int64()), pa.array(map(pack, texts), pa.binary()), pa.array([len(t) for t in texts], pa.int32())]
            columns += [pa.array([p for p, _ in found], pa.list_(pa.int32())), pa.array([h for _, h in found], pa.list_(pa.int64())), pa.array(codes, pa.list_(pa.int64()))]
            row += len(texts)
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[1:]], names=schema.names)

    return written(docs.mapInArrow(run, schema), "repeats-docs")


def _statuses(places: DataFrame, many: int) -> DataFrame:
    """(gram, code, n, r_id, open, crowded) of contexts whose gram occurs twice or more; r_id is the first document that has it.

    ``open``: a context of the gram occurs once, and another is there to compare it with; ``crowded``: there are more than ``many``.
    """
    counts = written(places.groupBy("gram", "code").agg(F.count("*").alias("n"), F.min("r_id").alias("r_id")), "repeats-counts")
    grams = counts.groupBy("gram").agg(F.sum("n").alias("total"), F.count("*").alias("codes"), F.min("n").alias("least")).filter("total > 1")
    grams = grams.select("gram", ((F.col("codes") > 1) & (F.col("least") == 1)).alias("open"), (F.col("codes") > many).alias("crowded"))
    # both written, so that Spark may split the contexts of a frequent gram in the join; neither side is broadcast
    return written(counts.join(written(grams, "repeats-grams").hint("merge"), "gram"), "repeats-statuses")


def _contexts(stored: DataFrame, statuses: DataFrame, length: int) -> DataFrame:
    """(gram, code, n, crowded, left, right, context) of one occurrence of each open context."""
    reach = length - GRAM
    wanted = statuses.filter("open").groupBy("r_id").agg(F.collect_list(F.struct("gram", "code", "n", "crowded")).alias("wanted"))
    schema = "gram long, code long, n long, crowded boolean, left int, right int, context binary"

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        names = [x.split()[0] for x in schema.split(", ")]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for packed, places, codes, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = unpack(packed)
                size, place_of = len(text), dict(zip(codes, places, strict=True))
                for w in wanted:
                    p = place_of[w["code"]]
                    left, right = min(p, reach), min(size - p, length)
                    context = bytes(reach - left) + text[p - left : p + right] + bytes(length - right)
                    for column, value in zip(out, (w["gram"], w["code"], w["n"], w["crowded"], left, right, context), strict=True):
                        column.append(value)
                if len(out[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=names)

    return stored.select("r_id", "r_text", "r_places", "r_codes").join(wanted, "r_id").select("r_text", "r_places", "r_codes", "wanted").mapInArrow(run, schema)


def _by_columns(contexts: DataFrame, length: int) -> DataFrame:
    """(gram, code, spans) of different contexts, all of a gram in one partition and in order of gram."""

    def run(batches):
        import pyarrow as pa

        def sort(held):
            grams = np.concatenate([b.column(0).to_numpy() for b in held])
            codes, counts, left, right = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (1, 2, 3, 4))
            data = np.frombuffer(b"".join([c for b in held for c in b.column(5).to_pylist()]), np.uint8).reshape(len(grams), -1)
            windows = repeated_windows(np.ascontiguousarray(data.T), length)
            spans = spans_of(windows, left, right, length)
            keep = [i for i, s in enumerate(spans) if s and counts[i] == 1]
            return pa.RecordBatch.from_arrays([pa.array(grams[keep]), pa.array(codes[keep]), pa.array([spans[i] for i in keep], pa.list_(pa.int32()))], names=["gram", "code", "spans"])

        held, n = [], 0
        for batch in batches:
            while len(batch):
                if n < AT_ONCE:
                    cut = len(batch)
                    held.append(batch)
                    n += cut
                    batch = batch.slice(cut)
                    continue
                # enough is held: it ends with the gram that its last row has
                more = batch.column(0).to_numpy() == held[-1].column(0)[len(held[-1]) - 1].as_py()
                cut = len(batch) if more.all() else int(np.argmin(more))
                if cut:
                    held.append(batch.slice(0, cut))
                    n += cut
                if cut < len(batch):
                    yield sort(held)
                    held, n = [], 0
                batch = batch.slice(cut)
        if held:
            yield sort(held)

    return contexts.select("gram", "code", "n", "left", "right", "context").mapInArrow(run, "gram long, code long, spans array<int>")


def _by_hashes(contexts: DataFrame, length: int) -> DataFrame:
    """(gram, code, spans) of different contexts of grams that have very many: windows are hashed and counted by Spark."""
    reach = length - GRAM
    window = F.substring(F.col("context"), F.col("start") + 1, F.lit(length))
    windows = contexts.select("gram", "code", "n", "left", "right", "context", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("start"))
    windows = windows.filter((reach - F.col("start") <= F.col("left")) & (length - reach + F.col("start") <= F.col("right")))
    windows = windows.select("gram", "code", "n", "start", F.md5(window).alias("window"))
    often = windows.groupBy("gram", "start", "window").agg(F.sum("n").alias("m")).filter("m > 1").select("gram", "start", "window")
    found = windows.filter("n = 1").join(often, ["gram", "start", "window"], "left_semi")
    ends = lambda s: F.array(s - reach, s - reach + length)
    return found.groupBy("gram", "code").agg(F.flatten(F.transform(F.array_sort(F.collect_list("start")), ends)).alias("spans"))


def repeats(docs: DataFrame, length: int = LENGTH, many: int = MANY, characters: bool = False) -> DataFrame:
    """Replaces ``text`` by kept (binary: what is left), n_bytes, n_removed, n_spans, spans (ends of removed runs), kept_sha256.

    With ``characters`` a character goes only if all its bytes do, so that what is left is UTF-8.
    """
    reach = length - GRAM
    docs, names = packed(docs, "text")
    stored = _stored(docs, length)
    places = stored.select("r_id", "r_size", F.explode(F.arrays_zip("r_places", "r_grams", "r_codes")).alias("a"))
    places = places.select("r_id", "r_size", F.col("a.r_places").alias("place"), F.col("a.r_grams").alias("gram"), F.col("a.r_codes").alias("code"))
    statuses = _statuses(places.select("r_id", "gram", "code"), many)
    contexts = _contexts(stored, statuses, length)
    crowd = statuses.filter("crowded AND open").isEmpty()
    contexts = contexts if crowd else written(contexts, "repeats-contexts")
    found = _by_columns((contexts if crowd else contexts.filter("NOT crowded")).repartition("gram").sortWithinPartitions("gram"), length)
    if not crowd:
        found = found.unionByName(_by_hashes(contexts.filter("crowded"), length))
    found = written(found, "repeats-spans")
    # a context that occurs twice repeats whole; of the others the spans are known
    known = statuses.filter("n > 1").select("gram", "code", F.lit(None).cast("array<int>").alias("spans")).unionByName(found)
    whole = F.array(F.greatest(F.col("place") - reach, F.lit(0)), F.least(F.col("place") + length, F.col("r_size")))
    own = places.join(known, ["gram", "code"]).select("r_id", F.coalesce(F.transform("spans", lambda x: x + F.col("place")), whole).alias("spans"))
    own = own.groupBy("r_id").agg(F.flatten(F.collect_list("spans")).alias("r_spans"))
    made = T.StructType.fromDDL("kept binary, n_bytes long, n_removed long, n_spans long, spans array<int>, kept_sha256 string")
    schema = T.StructType([docs.schema["rest"], *made.fields])

    def cut(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for packed, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = unpack(packed)
                ends = np.zeros(0, dtype=np.int64)
                kept = text
                if spans:
                    depth = np.zeros(len(text) + 1, dtype=np.int64)
                    np.add.at(depth, spans[::2], 1)
                    np.add.at(depth, spans[1::2], -1)
                    gone = np.cumsum(depth) > 0
                    if characters:
                        begins = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                        gone[:-1] = np.repeat(np.logical_and.reduceat(gone[:-1], begins), np.diff(begins, append=len(text)))
                    ends = np.flatnonzero(np.diff(gone, prepend=False))
                    kept = np.frombuffer(text, np.uint8)[~gone[:-1]].tobytes()
                for column, value in zip(out, (kept, len(text), len(text) - len(kept), len(ends) // 2, ends, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *[pa.array(v, t) for v, t in zip(out, types, strict=True)]], names=schema.names)

    return stored.join(own, "r_id", "left").select("r_text", "r_spans", "rest").mapInArrow(cut, schema).select(*unpacked(names, *made.names))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Windows of all texts by hash; each text is cut to segments first, as a substring far into a long text is slow there.
ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), seg AS (
  SELECT r, n, k, substr(h, 2000 * k + 1, 2398) AS s FROM (SELECT r, n, h, unnest(range(0, n // 1000 + 1)) AS k FROM d)
), win AS (
  SELECT r, 1000 * k + i AS at_byte, md5(substr(s, 2 * i + 1, 400)) AS w FROM (SELECT r, n, k, s, unnest(range(0, 1000)) AS i FROM seg) WHERE 1000 * k + i <= n - 200
), twice AS (
  SELECT r, at_byte FROM win JOIN (SELECT w FROM win GROUP BY w HAVING count(*) > 1) USING (w)
), runs AS (
  SELECT r, at_byte, sum(fresh) OVER (PARTITION BY r ORDER BY at_byte) AS run
  FROM (SELECT r, at_byte, CASE WHEN at_byte <= lag(at_byte) OVER (PARTITION BY r ORDER BY at_byte) + 200 THEN 0 ELSE 1 END AS fresh FROM twice)
), spans AS (
  SELECT r, min(at_byte) AS a, max(at_byte) + 200 AS b FROM runs GROUP BY r, run
), cut AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans
), kept AS (
  SELECT d.r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS left_over
  FROM d JOIN cut USING (r) GROUP BY d.r
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
