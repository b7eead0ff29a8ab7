"""Periodic runs of words, by suffix trees of a document and of its reversal.

A run is a stretch of words with least period q, of at least ``max(LEAST, TIMES * q)`` words, that no neighbouring word
extends.

1. *Where repetition can be.* In a run with q <= ``GRAM`` each word equals the one q places before it; in one with a longer
   period each ``GRAM`` words in a row occur three times in the document. Both are told for many documents at once, by
   comparison and by sorting hashes of grams. Only the stretches where this holds go on; every run lies whole in one of
   them, so nothing is lost, and equal hashes of different grams only make a stretch longer.
2. *Trees.* The stretches of a document, each with a separator of its own behind it, and the reversal of that sequence get
   a suffix tree each, by Ukkonen's construction. An Euler tour with constant-time range minima (blocks of ``WIDE``
   places, a sparse table over blocks, bit masks within one) gives the depth of the lowest common ancestor of two leaves,
   which is how far two suffixes agree.
3. *Lyndon roots.* Ranks of suffixes from the tree, under the order of words and under its reverse, give the longest Lyndon
   word at each place: it ends before the next smaller suffix. Every run has a root among them. A root is a candidate, and is
   extended to both sides by the longest common extensions of its two ends; what is long enough is a run.

There is no shuffle. A task holds one portion of texts at a time; trees take some hundred bytes a word of the stretches of
one document, so a text is bounded by memory only where it repeats itself throughout.

Defined results: null and empty texts have no words and no runs; repeated rows are treated one by one; an empty table gives
an empty result; further columns are kept, also those that are called as what is added (those in ``MADE`` are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.llm.common import packed, read, unpacked
from corvine.llm.quality import let
from corvine.llm.shingles import portions

#: The least words of a run, and how often its period fits in.
LEAST, TIMES = 6, 4
#: Up to this period words are compared directly; longer ones are told by grams of so many words.
GRAM = 8
#: Places in a block of the range minima.
WIDE = 32
MADE = ("n_words", "runs", "collapsed")


class SuffixTree:
    """The suffix tree of whole numbers from 1, of which the last is the only 0; with ranks and longest common extensions."""

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        self.sigma = max(symbols, default=0) + 1
        self._build(symbols)
        self._walk()
        self.minima = Minima(self.tour)

    def _build(self, s: list[int]) -> None:
        """Ukkonen's construction: nodes are numbers, 0 is the root; the edge to a node has the symbols from start to end."""
        n, sigma = self.n, self.sigma
        start, end, link, child = [0], [0], [0], {}
        node = edge = length = remaining = 0
        for i, c in enumerate(s):
            remaining += 1
            waiting = 0
            while remaining:
                if not length:
                    edge = i
                key = node * sigma + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    at = start[below]
                    span = end[below] - at
                    if length >= span:  # the place is beyond this edge
                        edge += span
                        length -= span
                        node = below
                        continue
                    if s[at + length] == c:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    split = len(start)
                    child[key] = split
                    start += (at, i)
                    end += (at + length, n)
                    link += (0, 0)
                    child[split * sigma + c] = split + 1
                    start[below] = at + length
                    child[split * sigma + s[at + length]] = below
                    if waiting:
                        link[waiting] = split
                    waiting = split
                remaining -= 1
                if node == 0 and length:
                    length -= 1
                    edge = i - remaining + 1
                else:
                    node = link[node]
        self.start, self.end, self.child = start, end, child

    def _walk(self) -> None:
        """The Euler tour as depths in symbols, each leaf's first place in it, and the leaves under each node."""
        n, start, end = self.n, self.start, self.end
        keys = np.fromiter(self.child.keys(), np.int64, len(self.child))
        nodes = np.fromiter(self.child.values(), np.int64, len(self.child))
        order = np.argsort(keys)
        parents = keys[order] // self.sigma
        bounds = np.searchsorted(parents, np.arange(len(start) + 1)).tolist()
        kids, turn, stop = nodes[order].tolist(), bounds[:-1], bounds[1:]
        depth, low, high = [0] * len(start), [0] * len(start), [0] * len(start)
        tour, first, leaves = [], [0] * n, []
        stack = [0]
        while stack:
            node = stack[-1]
            tour.append(depth[node])
            at = turn[node]
            if at == stop[node]:
                high[node] = len(leaves)
                stack.pop()
                continue
            turn[node] = at + 1
            kid = kids[at]
            d = depth[node] + end[kid] - start[kid]
            low[kid] = len(leaves)
            if end[kid] == n:
                first[n - d] = len(tour)
                tour.append(d)
                leaves.append(n - d)
                high[kid] = len(leaves)
            else:
                depth[kid] = d
                stack.append(kid)
        self.tour, self.first = np.array(tour, dtype=np.int32), np.array(first)
        self.kids, self.parents, self.symbols = nodes[order], parents, keys[order] % self.sigma
        self.low, self.high, self.leaves = np.array(low), np.array(high), np.array(leaves)

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each suffix under the order of symbols, and under its reverse, in which 0 is still the least."""
        up, down = np.empty(self.n, dtype=np.int64), np.empty(self.n, dtype=np.int64)
        up[self.leaves] = np.arange(self.n)
        # in reverse, a child comes behind the leaves of all greater siblings, and behind the leaf that 0 leads to
        ended = np.zeros(len(self.low), dtype=np.int64)
        ended[self.parents[self.symbols == 0]] = 1
        before = np.where(self.symbols == 0, 0, ended[self.parents] + self.high[self.parents] - self.high[self.kids])
        steps = np.zeros(self.n + 1, dtype=np.int64)
        np.add.at(steps, self.low[self.kids], before)
        np.subtract.at(steps, self.high[self.kids], before)
        down[self.leaves] = np.cumsum(steps)[:-1]
        return up, down

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``i`` and ``j`` (different places) have in common."""
        a, b = self.first[i], self.first[j]
        return self.minima.of(np.minimum(a, b), np.maximum(a, b))


class Minima:
    """Minima of ranges of an array, each in constant time, with memory in proportion to the array."""

    def __init__(self, values: np.ndarray):
        n_blocks = -(-len(values) // WIDE)
        grid = np.full((n_blocks, WIDE), np.iinfo(np.int32).max, dtype=np.int32)
        grid.reshape(-1)[: len(values)] = values
        self.values = grid.reshape(-1)
        self.upto = np.minimum.accumulate(grid, axis=1).reshape(-1)
        self.behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        # bit l of a place's mask: no value between place l of its block and it is less
        masks, bits = np.zeros((n_blocks, WIDE), dtype=np.uint32), np.uint32(1) << np.arange(WIDE, dtype=np.uint32)
        mask = np.zeros(n_blocks, dtype=np.uint32)
        for r in range(WIDE):
            stays = ((grid[:, :r] <= grid[:, r : r + 1]) * bits[:r]).sum(axis=1, dtype=np.uint32)
            mask = (mask & stays) | bits[r]
            masks[:, r] = mask
        self.masks = masks.reshape(-1)
        self.levels = [grid.min(axis=1)]
        while 2 << (len(self.levels) - 1) <= n_blocks:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value from ``low`` to ``high``, both included."""
        a, b = low // WIDE, high // WIDE
        out = np.minimum(self.behind[low], self.upto[high])
        inside = np.flatnonzero(a == b)
        left = self.masks[high[inside]] >> (low[inside] % WIDE).astype(np.uint32)
        lowest = np.frexp((left & (~left + np.uint32(1))).astype(np.float64))[1] - 1
        out[inside] = self.values[low[inside] + lowest]
        between = np.flatnonzero(b - a > 1)
        x, y = a[between] + 1, b[between]
        level = np.frexp((y - x).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            own = level == k
            table = self.levels[k]
            out[between[own]] = np.minimum(out[between[own]], np.minimum(table[x[own]], table[y[own] - (1 << k)]))
        return out


def next_smaller(ranks: list[int]) -> list[int]:
    """For each place the next one with a smaller rank; the last place has the least."""
    out, stack = [len(ranks)] * len(ranks), []
    for i, r in enumerate(ranks):
        while stack and ranks[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(symbols: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of all runs of a sequence of whole numbers, by start and then period."""
    n = len(symbols)
    if n < least:
        return np.zeros((0, 3), dtype=np.int64)
    dense = np.unique(symbols, return_inverse=True)[1] + 1
    tree, back = SuffixTree([*dense.tolist(), 0]), SuffixTree([*dense[::-1].tolist(), 0])
    found = []
    for ranks in tree.ranks():
        period = np.array(next_smaller(ranks.tolist())[:n]) - np.arange(n)
        root = np.flatnonzero(times * period <= n)
        period = period[root]
        before = back.common(n - root, n - root - period)
        length = before + period + tree.common(root, root + period)
        long = length >= np.maximum(least, times * period)
        found.append(np.stack([root - before, length, period], axis=1)[long])
    found = np.unique(np.concatenate(found), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _stretches(places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of at least ``least`` consecutive numbers among sorted ones."""
    cuts = np.flatnonzero(np.diff(places) != 1)
    first, last = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(places) - 1]])
    long = last - first + 1 >= least
    return places[first[long]], places[last[long]]


def candidates(symbols: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Where runs can be in many documents one behind the other, with separators between them: (begin, end) of stretches."""
    steps = np.zeros(len(symbols) + 1, dtype=np.int64)
    for q in range(1, min(GRAM, len(symbols) - 1) + 1):
        same = np.flatnonzero(symbols[:-q] == symbols[q:])
        if len(same):
            first, last = _stretches(same, max(least - q, (times - 1) * q))
            np.add.at(steps, first, 1)
            np.subtract.at(steps, last + q + 1, 1)
    if len(symbols) > GRAM:
        hashes = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        size = 1
        while size < GRAM:
            hashes = (hashes[:-size] ^ (hashes[:-size] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[size:]
            size *= 2
        hashes = (hashes ^ (hashes >> np.uint64(32))) + doc[: len(hashes)].astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        order = np.argsort(hashes)
        cuts = np.flatnonzero(np.diff(hashes[order], prepend=hashes[order[0]] ^ np.uint64(1)) != 0)
        counts = np.diff(np.append(cuts, len(hashes)))
        often = np.zeros(len(hashes), dtype=bool)
        often[order] = np.repeat(counts >= times - 1, counts)
        places = np.flatnonzero(often)
        if len(places):
            first, last = _stretches(places, times * (GRAM + 1) - GRAM + 1)
            np.add.at(steps, first, 1)
            np.subtract.at(steps, last + GRAM, 1)
    inside = np.cumsum(steps[:-1]) > 0
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def document_runs(texts: list[bytes], least: int = LEAST, times: int = TIMES) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """For each text the number of its words, its runs, and the words that are left when only a run's first period stays."""
    ids: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    own = [[ids.setdefault(w, len(ids)) for w in ws] for ws in words]
    sizes = np.array([len(x) + 1 for x in own])
    ends = np.cumsum(sizes)
    symbols = np.concatenate([np.append(x, -1 - i) for i, x in enumerate(own)]).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    stretches: dict[int, list[tuple[int, int]]] = {}
    for a, b in candidates(symbols, doc, least, times):
        stretches.setdefault(int(doc[a]), []).append((a, min(b, int(ends[doc[a]]) - 1)))
    for i, ws in enumerate(words):
        if i not in stretches:
            yield len(ws), np.zeros((0, 3), dtype=np.int64), b" ".join(ws)
            continue
        begin = int(ends[i] - sizes[i])
        parts, at = [], []
        for k, (a, b) in enumerate(stretches[i]):
            parts += (symbols[a:b], [len(ids) + k])
            at.append(np.arange(a - begin, b - begin + 1))
        runs = runs_of(np.concatenate(parts), least, times)
        runs[:, 0] = np.concatenate(at)[runs[:, 0]]
        steps = np.zeros(len(ws) + 1, dtype=np.int64)
        np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
        np.subtract.at(steps, runs[:, 0] + runs[:, 1], 1)
        kept = np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()
        yield len(ws), runs, b" ".join([ws[k] for k in kept])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Replaces the ``text`` of documents by n_words, runs (start, length, period; by start, then period) and the collapsed text."""
    docs, names = packed(docs, "text")
    run = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    schema = T.StructType([T.StructField("rest", docs.schema["rest"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def found(batches):
        import pyarrow as pa

        for batch in batches:
            at = 0
            for some in portions([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]):
                n_words, runs, collapsed = zip(*document_runs(some, least, times), strict=True)
                offsets = np.cumsum([0, *map(len, runs)])
                each = np.concatenate(runs).T
                items = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in each], names=["start", "length", "period"])
                columns = [batch.column(0).slice(at, len(some)), pa.array(n_words, pa.int64())]
                columns += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items), pa.array([c.decode() for c in collapsed], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                at += len(some)

    return docs.select("rest", "text").mapInArrow(found, schema).select(*unpacked(names, *MADE))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where one text in ten repeats from some word on, as the contract of ``op12_runs`` says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.get(ws, (a + i % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(ws, F.lit(1), a.cast("int")), tail), " ")).otherwise("")

    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), let(words, planted)).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(read(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    found = found.withColumn("longest", longest)
    start, length, period = -F.col("longest.start"), F.col("longest.length"), -F.col("longest.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
