"""Language identification by prediction by partial matching.

For each language a context tree over bytes predicts the next byte from the longest context it knows, up to ``ORDER``
bytes. A byte that was not seen in a context costs an escape (method C: with n bytes seen, t of them different, a byte
seen c times has probability c / (n + t), and the escape t / (n + t)) and is then predicted in the next shorter context,
at last evenly over 256 bytes. The statistics are frozen, so the code length of a whole text under each language is exact,
a sum over its bytes; the language with the shortest code wins.

The trees are fitted on a sample of labelled texts of about ``SAMPLE_BYTES`` bytes a language (different texts in the order
of a hash, the last one cut, so that each language is learned and the bound holds whatever the lengths and copies; of a
smaller corpus each text is used once). Spark counts contexts
over the sample. Languages go in groups of up to ``GROUP``. Of a group, contexts seen fewer than ``MIN_COUNT`` times are
pruned and the ``NODES`` times its languages most frequent kept, so a tree has the same size among two languages as among
hundreds. Only the counts at these contexts are broadcast, some hundred kilobytes a language. A worker makes tables of one
group at a time (at most about ``MODEL_BYTES``; a single group's stay): the trees of a group share their nodes, a table leads
from a node to the one with one more byte of context, and a table for each language has the code length of each byte at each
node, so that scoring is a few vectorised look-ups a byte.
Texts are scored whole, in segments of ``SEGMENT`` bytes that overlap by the longest context.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and no code length; if nothing can be
learned, every text is; repeated rows are judged one by one; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.llm.common import forget, packed, read, unpacked, written

ORDER, MIN_COUNT, NODES, SAMPLE_BYTES, SEGMENT = 4, 24, 3_000, 800_000, 1 << 19
#: Bytes of the tables of one group, and languages in it: five times ``NODES`` nodes, with tables for all bytes, stay within.
MODEL_BYTES = 1 << 27
GROUP = next(g for g in range(99, 0, -1) if 4 * 257 * NODES * g * (g + 2) <= MODEL_BYTES)
#: What stands before a text.
BEFORE = b"\n" * ORDER
UNDETERMINED = "und"


def remainder(doc_id: Column) -> Column:
    """The fold of a document: crc32 of its id as text, mod 4; fold 2 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def sample(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(text, lang) -> different texts of each language in the order of their hashes, until they have ``sample_bytes``; the last one is cut there."""
    hashed = labelled.withColumn("s_hash", F.xxhash64("text"))
    texts = hashed.groupBy("lang", "s_hash").agg(F.max(F.octet_length("text")).alias("n")).withColumn("bucket", F.shiftright("s_hash", 48))
    # running sums over at most 65,536 buckets of a language, then within those that matter
    earlier = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = texts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).select("lang", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("lang", "bucket").orderBy("s_hash").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(sample_bytes) - F.col("before") - F.coalesce(F.sum("n").over(within), F.lit(0))
    chosen = texts.join(buckets.filter(F.col("before") < sample_bytes), ["lang", "bucket"]).select("lang", "s_hash", left.alias("left")).filter("left > 0")
    # two numbers for each language, as the model holds whole tables for each
    last = {r["lang"]: r["last"] for r in chosen.groupBy("lang").agg(F.max(F.struct("s_hash", "left")).alias("last")).collect()}
    if not last:
        return labelled.filter(F.lit(False)).select("lang", "text")
    limit, room = (F.try_element_at(F.create_map(*[x for lang, r in last.items() for x in (F.lit(lang), F.lit(r[k]).cast("long"))]), F.col("lang")) for k in ("s_hash", "left"))
    found = hashed.filter(F.col("s_hash") <= limit).groupBy("lang", "s_hash").agg(F.min("text").alias("text"))
    # as many characters as have about the bytes that are left
    fit_in = F.ceil(room * F.length("text") / F.greatest(F.octet_length("text"), F.lit(1))).cast("int")
    return found.select("lang", F.when(F.col("s_hash") == limit, F.substring(F.col("text"), F.lit(1), fit_in)).otherwise(F.col("text")).alias("text"))


def contexts(data: np.ndarray, order: int) -> np.ndarray:
    """The bytes from ``ORDER`` on with the ``order`` bytes before each, as one number."""
    n = len(data) - ORDER
    key = np.zeros(n, dtype=np.int64)
    for back in range(order, -1, -1):
        key = key << 8 | data[ORDER - back : ORDER - back + n]
    return key


def count_contexts(texts: DataFrame) -> DataFrame:
    """(lang, text) -> (lang, k, key, n): how often each byte came behind each context of k bytes."""

    def run(batches):
        import pyarrow as pa

        forget()

        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text.encode())
            for lang, all_texts in by.items():
                # ORDER pad bytes between texts; what is counted at a pad byte is left out
                data = np.frombuffer(b"".join(BEFORE + t for t in all_texts), np.uint8)
                pad = np.zeros(len(data), dtype=bool)
                starts = np.cumsum([0] + [ORDER + len(t) for t in all_texts[:-1]])
                for i in range(ORDER):
                    pad[starts + i] = True
                real = ~pad[ORDER:]
                for k in range(ORDER + 1):
                    key, n = np.unique(contexts(data, k)[real], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(np.full(len(key), k, np.int32)), pa.array(key), pa.array(n.astype(np.int64))], names=["lang", "k", "key", "n"])

    return texts.mapInArrow(run, "lang string, k int, key long, n long").groupBy("lang", "k", "key").agg(F.sum("n").alias("n"))


class Model:
    """The trees of a group of languages as look-up tables."""

    def __init__(self, langs: list[str], k: np.ndarray, key: np.ndarray, lang: np.ndarray, n: np.ndarray):
        self.langs = langs
        seen = np.unique(np.append(key[k == 0], list(BEFORE)))
        self.symbol = np.full(256, len(seen), dtype=np.int32)  # bytes that were never seen share one symbol
        self.symbol[seen] = np.arange(len(seen))
        width = len(seen) + 1
        context = key >> 8
        (tags, inverse) = np.unique(np.stack([k, context], axis=1), axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        order = np.lexsort((tags[:, 1], tags[:, 0]))
        node_of = {(int(a), int(b)): i for i, (a, b) in enumerate(tags[order])}
        nodes = len(order)
        self.bits = np.empty((len(langs), nodes, width), dtype=np.float32)
        #: rows of nodes that go on, then of nodes where the context has ended
        self.longer = np.tile(np.arange(nodes, 2 * nodes, dtype=np.int32)[:, None], (2, width))
        rows = np.argsort(inverse, kind="stable")
        bounds = np.searchsorted(inverse[rows], np.arange(len(tags) + 1))
        for i, tag in enumerate(order):
            depth, ctx = int(tags[tag, 0]), int(tags[tag, 1])
            if depth:
                parent = node_of[depth - 1, ctx & ((1 << 8 * (depth - 1)) - 1)]
                self.longer[parent, self.symbol[ctx >> 8 * (depth - 1)]] = i
            mine = rows[bounds[tag] : bounds[tag + 1]]
            for j in range(len(langs)):
                own = mine[lang[mine] == j]
                lower = self.bits[j, parent] if depth else np.full(width, 8.0)
                if not len(own):
                    self.bits[j, i] = lower
                    continue
                all_n = n[own].sum() + len(own)
                self.bits[j, i] = lower - np.log2(len(own) / all_n)
                self.bits[j, i, self.symbol[key[own] & 255]] = -np.log2(n[own] / all_n)

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        some: list[tuple[int, bytes]] = []
        held = 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), SEGMENT):
                part = text[at - ORDER : at + SEGMENT] if at else BEFORE + text[:SEGMENT]
                if held + len(part) > SEGMENT and some:
                    self._add(some, out)
                    some, held = [], 0
                some.append((i, part))
                held += len(part)
        if some:
            self._add(some, out)
        return out

    def _add(self, some: list[tuple[int, bytes]], out: np.ndarray) -> None:
        symbols = self.symbol[np.frombuffer(b"".join(p for _, p in some), np.uint8)]
        nodes, width = self.bits.shape[1:]
        n = len(symbols) - ORDER
        state = np.zeros(n, dtype=np.int32)
        longer = self.longer.reshape(-1)
        for back in range(1, ORDER + 1):
            state = longer[state * width + symbols[ORDER - back : ORDER - back + n]]
        at = (state % nodes) * width + symbols[ORDER:]
        sizes = np.array([len(p) for _, p in some])
        begins = np.cumsum(sizes) - sizes
        which = np.array([i for i, _ in some])
        ends = begins + sizes - ORDER  # in places of ``at``, which start ORDER bytes in
        for j in range(len(self.langs)):
            total = np.concatenate([[0.0], np.cumsum(self.bits[j].reshape(-1)[at], dtype=np.float64)])
            np.add.at(out[:, j], which, total[ends] - total[begins])


class Trees:
    """The counts of all groups of languages: (langs, k, key, lang, n) each, of which tables are made as they are needed."""

    def __init__(self, groups: list[tuple]):
        self.groups = groups
        self.langs = [x for g in groups for x in g[0]]
        self.only: Model | None = None

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        if len(self.groups) == 1:
            self.only = self.only or Model(*self.groups[0])
            return self.only.code_lengths(texts)
        return np.concatenate([Model(*g).code_lengths(texts) for g in self.groups], axis=1)


def fit(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES, min_count: int = MIN_COUNT, max_nodes: int | None = None) -> Trees | None:
    """The trees of (text, lang), bounded by the sample; None if there is no labelled text. ``max_nodes`` is of a group."""
    known = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    counts = written(count_contexts(sample(known, sample_bytes)), "contexts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    place = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))])[F.col("lang")]
    counts = counts.withColumns({"at": place, "context": F.shiftright("key", 8)}).withColumn("group", F.floor(F.col("at") / GROUP).cast("int"))
    common = counts.groupBy("group", "k", "context").agg(F.sum("n").alias("m")).filter((F.col("m") >= min_count) | (F.col("k") == 0))
    # frequent contexts first, of equal ones the shorter: a context's suffixes always come before it
    order = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("m"), "k", "context"))
    sizes = F.least(F.lit(GROUP), F.lit(len(langs)) - F.col("group") * GROUP)
    kept = common.withColumn("order", order).filter(F.col("order") <= (F.lit(max_nodes) if max_nodes else NODES * sizes)).select("group", "k", "context")
    # the counts at a bounded number of contexts a language
    table = counts.join(kept, ["group", "k", "context"], "left_semi").select("group", "at", F.col("k").cast("long").alias("k"), "key", F.col("n").cast("double").alias("n")).toArrow()
    group, at, k, key, n = (table.column(c).to_numpy() for c in ("group", "at", "k", "key", "n"))
    return Trees([(langs[g * GROUP : (g + 1) * GROUP], k[own], key[own], at[own] - g * GROUP, n[own]) for g in range(-(-len(langs) // GROUP)) for own in (group == g,)])


def identify(docs: DataFrame, model: Trees | None) -> DataFrame:
    """Adds lang_pred, score (how sure the winner is, given equal odds before) and bits_per_byte of the winner."""
    made = T.StructType.fromDDL("lang_pred string, score double, bits_per_byte double")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "bits_per_byte": F.lit(None).cast("double")})
    docs, names = packed(docs, "text")
    schema = T.StructType(docs.schema.fields + made.fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        forget()

        trees = shared.value
        for batch in batches:
            has = batch.column(1).to_pylist()
            data = [t if ok else b"" for t, ok in zip(batch.column(0).cast(pa.binary()).to_pylist(), has, strict=True)]
            bits = trees.code_lengths(data)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(bits)), best]
            score = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
            lang = [trees.langs[i] if ok else UNDETERMINED for i, ok in zip(best, has, strict=True)]
            columns = [batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array([float(s) if ok else 0.0 for s, ok in zip(score, has, strict=True)], pa.float64())]
            columns.append(pa.array([float(b) / len(d) if d else None for b, d in zip(least, data, strict=True)], pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    letters = F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False))
    return docs.select("text", letters.alias("letters"), "rest").mapInArrow(run, schema).select("text", *unpacked(names, *made.names))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(remainder(F.col("doc_id")) != 2))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")
