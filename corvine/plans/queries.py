"""Registered queries over the given tables, each with the SQL that says the same.

Where a table has no column that an operator needs, the query derives it from the table's rows by arithmetic, so that its
work grows with the table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.config import DEFAULTS
from corvine.functions import charts as C
from corvine.functions import identity as I
from corvine.functions import prompts as P
from corvine.functions import tables as M
from corvine.functions import text as X
from corvine.functions import verdicts as V
from corvine.operators import answers, bm25, chart_flow, context, embed, fusion, hash_tree, ivf, learned, line_voting, manifest, numbering, postings, splitter, store, vector, versioned, workflow
from corvine.session import cleaned
from corvine.sources import files, page_format, pages
from corvine.streaming import rate_limit as R

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The folder that the session has for checkpoints, which all executors share; on one machine, where it has none, a new one."""
    context = spark.sparkContext
    if not (found := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found := tempfile.mkdtemp(prefix="corvine-"))
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, read back: cheaper than a checkpoint, and Spark knows its size. Shuffle files behind it are removed."""
    path = f"{_shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with cleaned(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """A checkpoint in the folder that the session has for them."""
    _shared(df.sparkSession)
    return df.checkpoint()


# --- identity, scans, validation, caches


def _chunked(docs: DataFrame) -> DataFrame:
    """Each document as the one chunk of its file."""
    h = I.sha256(F.coalesce("text", F.lit("")))
    rows = docs.withColumn("file_hash", h).withColumn("path", F.concat(F.lit("corpus/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    rows = rows.withColumn("stable_source", I.stable_source(F.col("path"), F.col("file_hash"))).withColumn("chunk_id", I.chunk_id(F.col("file_hash"), F.lit(1), F.lit(0)))
    return rows.withColumn("doc_key", I.doc_key(F.col("stable_source"), F.lit(1), F.col("chunk_id"), F.coalesce("text", F.lit(""))))


@query("""
SELECT doc_id, h AS content_hash, stable_source, chunk_id, sha256(stable_source || '::1::' || chunk_id || '::' || substr(h, 1, 16)) AS doc_key
FROM (SELECT doc_id, h, doc_id || '.txt::' || h AS stable_source, 'txt_' || h || '_1_0' AS chunk_id FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents))
""")
def doc_identity(spark, sf):
    return _chunked(table(spark, sf, "documents")).select("doc_id", F.col("file_hash").alias("content_hash"), "stable_source", "chunk_id", "doc_key")


@query("SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents GROUP BY 2")
def content_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", I.sha256(F.coalesce("text", F.lit(""))).alias("content_hash"))
    return manifest.first_of(docs, "content_hash", "doc_id").select("doc_id", "content_hash")


@query("SELECT count(*) - count(DISTINCT sha256(coalesce(text, ''))) AS duplicates, count(*) AS n FROM documents")
def dup_count(spark, sf):
    counts = table(spark, sf, "documents").groupBy(I.sha256(F.coalesce("text", F.lit(""))).alias("h")).agg(F.count("*").alias("n"))
    return counts.agg((F.sum("n") - F.count("*")).alias("duplicates"), F.sum("n").alias("n"))


@query("""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, h) - 1 AS i, h FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)),
a AS (SELECT i // 1000 AS i, sha256(string_agg(h, '' ORDER BY d.i)) AS h FROM d GROUP BY 1),
b AS (SELECT i // 1000 AS i, sha256(string_agg(h, '' ORDER BY a.i)) AS h FROM a GROUP BY 1)
SELECT coalesce(min(h), sha256('')) AS set_hash FROM (SELECT * FROM b WHERE (SELECT count(*) FROM a) > 1 UNION ALL SELECT * FROM a WHERE (SELECT count(*) FROM a) = 1)
""")
def docset_hash(spark, sf):
    return I.set_hash(table(spark, sf, "documents").select("doc_id", I.sha256(F.coalesce("text", F.lit(""))).alias("h")), "doc_id", "h")


@query("SELECT DISTINCT source, sha256(coalesce(text, '')) AS file_hash FROM documents")
def file_hash_set(spark, sf):
    """The set of hashes of each source, as rows: a source may have any number."""
    return table(spark, sf, "documents").select("source", I.sha256(F.coalesce("text", F.lit(""))).alias("file_hash")).distinct()


_EXT = ("txt", "PDF", "docx", "md", "exe")


@query("""
WITH f AS (SELECT doc_id, source, 'corpus/' || doc_id || '.' || ['txt', 'PDF', 'docx', 'md', 'exe'][CAST(doc_id % 5 + 1 AS BIGINT)] AS path, strlen(coalesce(text, '')) * 5000 AS length FROM documents),
t AS (SELECT source, sum(length) AS total, count(*) AS n_files FROM f GROUP BY source)
SELECT f.doc_id, f.path, CAST(f.length AS BIGINT) AS length, f.length <= 52428800 AS size_ok, lower(regexp_extract(f.path, '(\\.[^./]+)$', 1)) IN ('.txt', '.pdf', '.docx', '.md') AS type_ok,
       t.total <= 209715200 AS total_ok, CAST(t.n_files AS BIGINT) AS n_files
FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source
""")
def file_validation(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, sf, "documents").select("doc_id", "source", F.concat(F.lit("corpus/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * 5000).alias("length"))
    totals = files.totals(rows, "source").withColumnRenamed("source", "t_source")
    return rows.join(totals, F.col("source").eqNullSafe(F.col("t_source"))).select("doc_id", "path", "length", files.size_ok(F.col("length")).alias("size_ok"), files.type_ok(F.col("path")).alias("type_ok"), "total_ok", "n_files")


@query("""
WITH n AS (SELECT max(ts) AS now FROM events)
SELECT event_id, date_diff('second', ts, now) // 86400 AS age_days, now - ts > INTERVAL 7 DAYS AS expired, strftime(ts, '%Y-%m-%d %H:%M') AS cached_at FROM events, n
""")
def cache_ttl(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.lit(events.agg(F.max("ts")).first()[0])
    age = F.floor((F.unix_seconds(now) - F.unix_seconds("ts")) / 86400)
    return events.select("event_id", age.cast("long").alias("age_days"), files.expired(F.col("ts"), now).alias("expired"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("cached_at"))


@query("""
SELECT e.o_orderkey AS wanted, min(p.p_partkey) AS found FROM (SELECT o_orderkey, 'part-' || (o_orderkey % 2500) || '.txt' AS name FROM orders) e
LEFT JOIN (SELECT p_partkey, 'part-' || (p_partkey // 2) || '.txt' AS name FROM part) p USING (name) GROUP BY e.o_orderkey
""")
def example_lookup(spark, sf):
    wanted = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("part-"), (F.col("o_orderkey") % 2500).cast("string"), F.lit(".txt")).alias("name"))
    have = table(spark, sf, "part").select(F.concat(F.lit("examples/part-"), F.floor(F.col("p_partkey") / 2).cast("string"), F.lit(".txt")).alias("path"), "p_partkey")
    first = manifest.first_of(have.withColumn("name", I.basename(F.col("path"))).drop("path"), "name", "p_partkey")
    return wanted.join(first, "name", "left").select(F.col("o_orderkey").alias("wanted"), F.col("p_partkey").alias("found"))


# --- manifest


def _docs_hashed(spark, sf):
    return table(spark, sf, "documents").select("doc_id", I.sha256(F.coalesce("text", F.lit(""))).alias("content_hash"))


def _manifest(spark, sf):
    """Labelled documents are indexed; the toxic ones with what they had been before."""
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    return _docs_hashed(spark, sf).join(labels, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, F.sha2(F.concat("content_hash", F.lit("!")), 256)).otherwise(F.col("content_hash")).alias("content_hash"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_new(spark, sf):
    return manifest.new_rows(_docs_hashed(spark, sf), _manifest(spark, sf).select("doc_id"), "doc_id")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, sha256(sha256(coalesce(text, '')) || '!') AS known_hash FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def incremental_changed(spark, sf):
    return manifest.changed_rows(_docs_hashed(spark, sf), _manifest(spark, sf), "doc_id").select("doc_id", "content_hash", "known_hash")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def manifest_json(spark, sf):
    return manifest.from_json(manifest.to_json(_docs_hashed(spark, sf), "doc_id"))


@query("SELECT md5(coalesce(text, '')) AS key, min(doc_id) AS doc_id, count(*) - 1 AS repeats FROM documents GROUP BY 1")
def batch_dedup(spark, sf):
    rows = table(spark, sf, "documents").select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), "doc_id")
    return rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("repeats"))


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100 + 1 AS batch FROM documents")
def chunk_batches(spark, sf):
    docs = numbering.numbered(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id")
    return docs.select("doc_id", "source", (F.floor(F.col("at") / 100) + 1).cast("long").alias("batch"))


# --- chunking and text


@query("SELECT doc_id, sha256(coalesce(text, '') || 'lang' || coalesce(lang, '') || 'n_chars' || coalesce(CAST(n_chars AS VARCHAR), '') || 'source' || coalesce(source, '')) AS digest FROM documents")
def document_digest(spark, sf):
    meta = F.create_map(*[x for k in ("source", "n_chars", "lang") for x in (F.lit(k), F.col(k).cast("string"))])
    return table(spark, sf, "documents").select("doc_id", I.document_digest(F.col("text"), meta).alias("digest"))


@query()
def chunk_documents(spark, sf):
    return splitter.chunks(table(spark, sf, "documents")).select("doc_id", "seq", F.length("content").alias("n_chars"), I.sha256(F.col("content")).alias("content_hash"))


@query()
def chunk_stats(spark, sf):
    rows = splitter.chunks(table(spark, sf, "documents"))
    return rows.agg(F.count("*").alias("n_chunks"), F.max(F.length("content")).alias("longest"), F.sum(F.length("content")).alias("n_chars"), F.count_distinct("doc_id").alias("n_docs"))


@query("""
SELECT source, count(*) AS n_docs, CAST(sum(c) AS BIGINT) AS total_chars, CAST(sum(c // 4) AS BIGINT) AS tokens_4, CAST(sum(c // 3) AS BIGINT) AS tokens_3, CAST(floor(sum(c) / 4.5) AS BIGINT) AS tokens_45,
       CAST(sum(c) // count(*) AS BIGINT) AS avg_chars, round(sum(c) / 3 / 250000 * 100, 1) AS quota_percent
FROM (SELECT source, CAST(length(coalesce(text, '')) AS BIGINT) AS c FROM documents) GROUP BY source
""")
def token_stats(spark, sf):
    docs = table(spark, sf, "documents").select("source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("c"))
    return docs.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("c").alias("total_chars"), F.sum(X.tokens(F.col("c"), 4)).alias("tokens_4"), F.sum(X.tokens(F.col("c"), 3)).alias("tokens_3"),
        F.floor(F.sum("c") / 4.5).cast("long").alias("tokens_45"), F.floor(F.sum("c") / F.count("*")).cast("long").alias("avg_chars"), F.round(F.sum("c") / 3 / 250000 * 100, 1).alias("quota_percent"),
    )


@query("SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\x{00}-\\x{ff}]', '?', 'g') AS text, trim(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) = coalesce(text, '') AS stripped FROM documents")
def sanitised(spark, sf):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", X.latin1(text).alias("text"), (X.strip(text) == text).alias("stripped"))


@query("SELECT event_id, CAST(CAST(round_even(value * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS share FROM (SELECT event_id, (event_id % 1001) / 1000.0::DOUBLE AS value FROM events)")
def percent_format(spark, sf):
    return table(spark, sf, "events").select("event_id", X.percent((F.col("event_id") % 1001) / F.lit(1000.0)).alias("share"))


_TERMS = """
q AS (SELECT item_id AS question, text, list_filter(list_transform(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda w: lower(w)), lambda w: NOT list_contains([STOP], w) AND length(w) > 2)[1:5] AS terms FROM benchmark)
""".replace("STOP", ", ".join(f"'{w}'" for w in X.STOP_WORDS))
_BM25 = """
d AS (SELECT doc_id AS doc, text, unnest(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS term FROM documents),
p AS (SELECT doc, term, count(*) AS tf FROM d GROUP BY ALL),
dl AS (SELECT doc_id AS doc, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS dl FROM documents),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
t0 AS (SELECT term, count(*) AS df, ln((SELECT n FROM st) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf0 FROM p GROUP BY term),
t AS (SELECT term, df, CASE WHEN idf0 >= 0 THEN idf0 ELSE 0.25::DOUBLE * (SELECT avg(idf0) FROM t0) END AS idf FROM t0),
qt AS (SELECT item_id AS question, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS term FROM benchmark),
sc AS (SELECT question, doc, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM qt JOIN p USING (term) JOIN t USING (term) JOIN dl USING (doc), st GROUP BY question, doc),
al AS (SELECT b.item_id AS question, dl.doc, coalesce(score, 0) AS score FROM benchmark b CROSS JOIN dl LEFT JOIN sc ON sc.question = b.item_id AND sc.doc = dl.doc),
top AS (SELECT question, doc, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, doc) AS rank FROM al QUALIFY rank <= 8)
"""


_TERM_STATS = _BM25[: _BM25.index("qt AS")].rstrip().rstrip(",")


@query(f"WITH {_TERM_STATS} SELECT term, df, round(idf, 6) AS idf FROM t")
def bm25_stats(spark, sf):
    """A row for each term of the vocabulary."""
    docs = table(spark, sf, "documents")
    return bm25.term_stats(bm25.document_counts(docs), bm25.corpus_stats(bm25.lengths(docs))).select("term", "df", F.round("idf", 6).alias("idf"))


def _questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("question"), "text")


@query(f"WITH {_BM25} SELECT question, doc, score, CAST(rank AS INTEGER) AS rank FROM top")
def bm25_topk(spark, sf):
    """By a stored word index; texts are read once, when it is made."""
    at = f"{_shared(spark)}/words-{uuid.uuid4().hex}"
    postings.append(table(spark, sf, "documents"), at)
    return postings.search(postings.Index(spark, at), _questions(spark, sf), written)


@query(f"WITH {_BM25} SELECT question, doc, score, CAST(rank AS INTEGER) AS rank FROM top")
def bm25_appended(spark, sf):
    """The same of an index that three parts of the documents were added to one after the other, in small zones."""
    docs, at = table(spark, sf, "documents"), f"{_shared(spark)}/words-{uuid.uuid4().hex}"
    for part in range(3):
        postings.append(docs.filter(F.col("doc_id") % 3 == part), at, zone=16)
    return postings.search(postings.Index(spark, at), _questions(spark, sf), written)


@query(f"WITH {_BM25} SELECT count(DISTINCT term) AS vocabulary, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens FROM p")
def vocabulary(spark, sf):
    by_term = bm25.postings(table(spark, sf, "documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return by_term.agg(F.count("*").alias("vocabulary"), F.sum("df").alias("postings"), F.sum("tf").alias("tokens"))


def _ranked(spark, sf):
    top = written(bm25_topk(spark, sf), "top")  # Spark knows that it is small, and leaves the texts where they are
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("content"), F.concat(F.lit("corpus/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"))
    return top.join(docs, "doc").join(_questions(spark, sf), "question")


@query(f"WITH {_BM25} SELECT question, substr(string_agg(content, chr(10) || chr(10) ORDER BY rank), 1, 20000) AS context FROM top JOIN (SELECT doc_id AS doc, coalesce(text, '') AS content FROM documents) USING (doc) GROUP BY question")
def context_concat(spark, sf):
    return context.joined_context(_ranked(spark, sf), DEFAULTS.RESEARCH_TOP_K, 20000)


def _sql_nested_highlight() -> str:
    steps, last = [], "h0"
    for i in range(1, 6):
        steps.append(f"h{i} AS (SELECT * REPLACE (CASE WHEN terms[{i}] IS NULL THEN body ELSE regexp_replace(body, '(?i)\\Q' || terms[{i}] || '\\E', '**' || replace(terms[{i}], '\\', '\\\\') || '**', 'g') END AS body) FROM {last})")
        last = f"h{i}"
    return ", ".join(steps)


@query(f"""
WITH {_BM25}, {_TERMS},
h0 AS (SELECT question, rank, terms, doc, CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END AS body FROM top JOIN q USING (question) JOIN (SELECT doc_id AS doc, coalesce(text, '') AS content FROM documents) USING (doc)),
{_sql_nested_highlight()}
SELECT question, '### 📚 Retrieved Context (' || count(*) || ' chunks)' || chr(10) || chr(10)
  || string_agg(chr(10) || '<details>' || chr(10) || '<summary>📄 Chunk ' || rank || ' - ' || doc || '.txt</summary>' || chr(10) || chr(10) || body || chr(10) || chr(10) || '</details>' || chr(10), chr(10) ORDER BY rank) FILTER (rank <= 5)
  || CASE WHEN count(*) > 5 THEN chr(10) || chr(10) || '*... and ' || (count(*) - 5) || ' more chunks*' ELSE '' END AS context
FROM h5 GROUP BY question
""")
def highlight_context(spark, sf):
    return context.rendered_context(_ranked(spark, sf))


# --- vectors and fusion

_KNN = """
v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
qv AS (SELECT QUERYID AS query, e FROM v WHERE QUERYCOND),
kn AS (SELECT query, id, round(list_cosine_similarity(qv.e, v.e), 9) AS similarity FROM qv CROSS JOIN v),
kr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM kn QUALIFY rank <= 35)
"""


def _sql_mmr(queries: str) -> str:
    parts = [
        f"c AS (SELECT query, id, rank, similarity FROM kr WHERE {queries})",
        "pr AS (SELECT a.query, a.id AS a, b.id AS b, round(list_cosine_similarity(x.e, y.e), 9) AS s FROM c a JOIN c b USING (query) JOIN v x ON x.id = a.id JOIN v y ON y.id = b.id)",
        "m1 AS (SELECT query, arg_min(id, (-similarity, rank)) AS id, 1 AS n FROM c GROUP BY query)",
    ]
    for n in range(2, 16):
        best = f"SELECT c.query, c.id, c.rank, round(0.7::DOUBLE * c.similarity - (1 - 0.7::DOUBLE) * max(pr.s), 9) AS s FROM c JOIN m{n - 1} m USING (query) JOIN pr ON pr.query = c.query AND pr.a = c.id AND pr.b = m.id WHERE NOT EXISTS (SELECT 1 FROM m{n - 1} z WHERE z.query = c.query AND z.id = c.id) GROUP BY c.query, c.id, c.rank, c.similarity"
        parts.append(f"m{n} AS MATERIALIZED (SELECT * FROM m{n - 1} UNION ALL SELECT query, arg_min(id, (-s, rank)), {n} FROM ({best}) GROUP BY query)")
    return ", ".join(parts)


_EVERY_100 = _KNN.replace("QUERYID", "id").replace("QUERYCOND", "id % 100 = 0")
_BY_QUESTION = _KNN.replace("QUERYID", "id").replace("QUERYCOND", "id IN (SELECT item_id FROM benchmark)")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _neighbours(spark, sf):
    vectors = _vectors(spark, sf)
    queries = vectors.filter("id % 100 = 0").withColumnRenamed("id", "query")
    return queries, vectors, vector.nearest(queries, vectors)


@query(f"WITH {_EVERY_100} SELECT query, id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM kr")
def knn_topk(spark, sf):
    return _neighbours(spark, sf)[2].select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"WITH {_EVERY_100}, {_sql_mmr('true')} SELECT query, id, CAST(n AS INTEGER) AS rank FROM m15")
def mmr_rerank(spark, sf):
    queries, vectors, found = _neighbours(spark, sf)
    return vector.diverse(found, queries, vectors)


def _lists(spark, sf):
    """For each question its best documents by words, and by vector: a question's vector is the one with its number."""
    vectors = _vectors(spark, sf)
    queries = vectors.join(_questions(spark, sf).select(F.col("question").alias("id")), "id", "left_semi").select(F.col("id").alias("query"), "embedding")
    by_vector = vector.diverse(vector.nearest(queries, vectors), queries, vectors)
    one = bm25_topk(spark, sf).select(F.col("question").alias("query"), F.lit(0).alias("retriever"), "rank", F.lit(DEFAULTS.BM25_WEIGHT).alias("weight"), F.col("doc").alias("id"))
    return one.unionByName(by_vector.select("query", F.lit(1).alias("retriever"), "rank", F.lit(DEFAULTS.VECTOR_WEIGHT).alias("weight"), "id"))


_RRF = f"""{_BM25}, {_BY_QUESTION}, {_sql_mmr('true')},
ls AS (SELECT question AS query, 0 AS retriever, rank, 0.4::DOUBLE AS weight, doc AS id FROM top UNION ALL SELECT query, 1, n, 0.6::DOUBLE, id FROM m15),
fu AS (SELECT query, id, round(sum(weight / (rank + 60)), 9) AS score, min((retriever, rank)) AS seen FROM ls GROUP BY query, id),
fr AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, seen, id) AS rank FROM fu QUALIFY rank <= 25)
"""


@query()
def knn_indexed(spark, sf):
    """What ``knn_topk`` finds, by an index of lists and codes; recall against it is measured in a test."""
    vectors, at = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), f"{_shared(spark)}/vectors-{uuid.uuid4().hex}"
    ivf.build(vectors, at)
    asked = vectors.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query"), "embedding")
    return ivf.search(asked, at, written)


@query(f"WITH {_RRF} SELECT query, id, score, CAST(rank AS INTEGER) AS rank FROM fr")
def rrf_fusion(spark, sf):
    return fusion.fuse(_lists(spark, sf))


@query(f"WITH {_RRF} SELECT query, list_sort(list_distinct(list(CAST(id % 7 AS BIGINT) ORDER BY id))) AS pages FROM ls GROUP BY query")
def rrf_pages(spark, sf):
    return fusion.pages(_lists(spark, sf).withColumn("page", F.col("id") % 7), "query")


# --- chats and answers


@query("""
SELECT conv_id, string_agg(chr(10) || '---' || chr(10) || '### 💬 Q' || i || ' (' || turn || ')' || chr(10) || '**Question:** ' || coalesce(text, '') || chr(10) || chr(10) || '**Answer:** ' || coalesce(answer, '')
  || chr(10) || chr(10) || '*Confidence: N/A*' || chr(10), chr(10) ORDER BY turn) AS chat
FROM (SELECT c.conv_id, c.turn, c.text, a.text AS answer, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS i
      FROM conversations c LEFT JOIN (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn) a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 WHERE c.role = 'user') GROUP BY conv_id
""")
def chat_render(spark, sf):
    said = table(spark, sf, "conversations")
    replies = said.filter("role = 'assistant'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.min("text").alias("answer"))
    turns = said.filter("role = 'user'").join(replies, ["conv_id", "turn"], "left")
    turns = turns.select("conv_id", F.col("turn").alias("at"), F.col("turn").cast("string").alias("timestamp"), F.col("text").alias("question"), "answer", F.lit(None).cast("string").alias("confidence"))
    return context.rendered_chat(turns, "conv_id")


@query("""
SELECT conv_id, string_agg('Q' || i || ': ' || coalesce(role, '') || chr(10) || 'A: ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY i) AS answer
FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS i FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)) GROUP BY conv_id
""")
def subanswer_combine(spark, sf):
    said = table(spark, sf, "conversations").select("conv_id", (-F.col("turn")).alias("idx"), F.coalesce("role", F.lit("")).alias("question"), F.coalesce("text", F.lit("")).alias("answer"))
    return context.combined(said, "conv_id")


_VERDICTS = """
g AS (SELECT l_orderkey, l_linenumber, l_orderkey * 7 + l_linenumber AS x FROM lineitem),
v AS (SELECT *, ['YES', 'NO', 'PARTIAL'][CAST(x % 3 + 1 AS BIGINT)] AS supported, ['HIGH', 'MEDIUM', 'LOW'][CAST(x // 3 % 3 + 1 AS BIGINT)] AS confidence, ['YES', 'NO'][CAST(x // 9 % 2 + 1 AS BIGINT)] AS relevant,
  ['COMPLETE', 'PARTIAL', 'INCOMPLETE'][CAST(x // 18 % 3 + 1 AS BIGINT)] AS completeness, CASE WHEN x // 54 % 2 = 1 THEN ['c' || x, 'd', 'e', 'f'] ELSE CAST([] AS VARCHAR[]) END AS claims,
  CASE WHEN x // 108 % 2 = 1 THEN ['k' || x] ELSE CAST([] AS VARCHAR[]) END AS contradictions, CASE WHEN x // 216 % 2 = 1 THEN 'more' ELSE '' END AS details FROM g),
p AS (SELECT *, list_filter([CASE supported WHEN 'NO' THEN 'Answer lacks sufficient support from documents.' WHEN 'PARTIAL' THEN 'Some parts are not well supported.' END,
  CASE WHEN len(claims) > 0 THEN 'Unsupported: ' || array_to_string(claims[1:3], '; ') END, CASE WHEN len(contradictions) > 0 THEN 'Contradictions: ' || array_to_string(contradictions[1:3], '; ') END,
  CASE WHEN completeness = 'INCOMPLETE' THEN 'Answer is incomplete.' END, CASE WHEN confidence = 'LOW' THEN 'Focus on directly verifiable claims.' END, CASE WHEN details <> '' THEN 'Additional Details: ' || details END], lambda y: y IS NOT NULL) AS parts FROM v),
f AS (SELECT *, CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' | ') END AS feedback FROM p)
"""


def _verdicts(spark, sf):
    """Every combination of verdicts, spread over the line items."""
    x = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (F.floor(x / by) % len(names) + 1).cast("int"))
    on = lambda by: F.floor(x / by) % 2 == 1
    none = F.array().cast("array<string>")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", pick(("YES", "NO", "PARTIAL"), 1).alias("supported"), pick(("HIGH", "MEDIUM", "LOW"), 3).alias("confidence"), pick(("YES", "NO"), 9).alias("relevant"), pick(("COMPLETE", "PARTIAL", "INCOMPLETE"), 18).alias("completeness"),
        F.when(on(54), F.array(F.concat(F.lit("c"), x.cast("string")), F.lit("d"), F.lit("e"), F.lit("f"))).otherwise(none).alias("claims"), F.when(on(108), F.array(F.concat(F.lit("k"), x.cast("string")))).otherwise(none).alias("contradictions"), F.when(on(216), "more").otherwise("").alias("details"),
    )


def _feedback():
    return V.feedback(*map(F.col, ("supported", "confidence", "claims", "contradictions", "completeness", "details")))


@query(f"WITH {_VERDICTS} SELECT l_orderkey, l_linenumber, feedback FROM f")
def feedback_text(spark, sf):
    return _verdicts(spark, sf).select("l_orderkey", "l_linenumber", _feedback().alias("feedback"))


@query(f"WITH {_VERDICTS} SELECT l_orderkey, l_linenumber, supported = 'NO' OR relevant = 'NO' OR coalesce(feedback ILIKE '%contradiction%' OR feedback ILIKE '%unsupported%', false) AS retry FROM f")
def retry_predicate(spark, sf):
    return _verdicts(spark, sf).select("l_orderkey", "l_linenumber", V.try_again(F.col("supported"), F.col("relevant"), _feedback()).alias("retry"))


@query(f"""WITH {_VERDICTS} SELECT l_orderkey, l_linenumber, '**Candidates Evaluated:** 2' || chr(10) || '**Selected Candidate:** ' || (l_linenumber % 2 + 1) || chr(10) || '**Selection Confidence:** ' || confidence || chr(10) || '**Selection Reasoning:** best' || chr(10) || chr(10)
  || '**Supported:** ' || supported || chr(10) || '**Confidence:** ' || confidence || chr(10) || '**Unsupported Claims:** ' || coalesce(nullif(array_to_string(claims, ', '), ''), 'None') || chr(10) || '**Contradictions:** ' || coalesce(nullif(array_to_string(contradictions, ', '), ''), 'None') || chr(10)
  || '**Relevant:** ' || relevant || chr(10) || '**Completeness:** ' || completeness || chr(10) || '**Additional Details:** ' || coalesce(nullif(details, ''), 'None') || chr(10) AS report FROM f""")
def verification_report(spark, sf):
    c = {x: F.col(x) for x in ("supported", "confidence", "claims", "contradictions", "relevant", "completeness", "details")}
    head = V.report_header(F.lit(2), F.col("l_linenumber") % 2, c["confidence"], F.lit("best"))
    return _verdicts(spark, sf).select("l_orderkey", "l_linenumber", F.concat(head, V.report(*c.values())).alias("report"))


@query(f"""WITH {_VERDICTS} SELECT l_orderkey, l_linenumber, CASE WHEN details = '' THEN 'PARTIAL' ELSE supported END AS supported, confidence, relevant, completeness FROM f""")
def verdict_parse(spark, sf):
    line = lambda key, value: F.concat(F.lit(key), value, F.lit("\n"))
    raw = F.concat(
        line("Supported: ", F.col("supported")), F.lit("no key here\n"), line("Confidence: ", F.lower("confidence")), line("Relevant : ", F.col("relevant")), line("Completeness: ", F.col("completeness")),
        F.lit("**Supported:** YES\n"), F.when(F.col("details") == "", "supported: partial").otherwise("COMPLETENESS: unclear"),
    )
    return _verdicts(spark, sf).select("l_orderkey", "l_linenumber", V.parsed(raw).alias("v")).select("l_orderkey", "l_linenumber", "v.*")


@query(f"""WITH {_VERDICTS} SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'NO' ELSE supported END AS supported,
  CASE l_linenumber WHEN 1 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE confidence END AS confidence,
  CASE WHEN l_linenumber IN (2, 3) THEN '' ELSE array_to_string(claims, ';') END AS claims, CASE WHEN l_linenumber = 3 THEN 'NO' ELSE relevant END AS relevant,
  CASE WHEN l_linenumber IN (2, 3) THEN 'INCOMPLETE' ELSE completeness END AS completeness, CASE WHEN l_linenumber IN (2, 3) THEN '' ELSE details END AS details FROM f""")
def verdict_structured(spark, sf):
    """Verdicts as JSON objects; of a first line item without a confidence, of a second as lines, of a third with a label that is none."""
    c = {x: F.col(x) for x in ("supported", "relevant", "completeness")}
    n = F.col("l_linenumber")
    whole = F.struct(F.when(n == 3, "MAYBE").otherwise(c["supported"]).alias("supported"), F.when(n != 1, F.col("confidence")).alias("confidence"), F.col("claims").alias("unsupported_claims"), "contradictions", c["relevant"].alias("relevant"), c["completeness"].alias("completeness"), F.col("details").alias("additional_details"))
    lines = F.concat(F.lit("Supported: "), c["supported"], F.lit("\nConfidence: "), F.col("confidence"), F.lit("\nRelevant: "), c["relevant"])
    rows = _verdicts(spark, sf).select("l_orderkey", "l_linenumber", F.when(n == 2, lines).otherwise(F.concat(F.lit("Verdict: "), F.to_json(whole))).alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", V.structured(F.col("raw")).alias("v")).select("l_orderkey", "l_linenumber", "v.supported", "v.confidence", F.array_join("v.claims", ";").alias("claims"), "v.relevant", "v.completeness", "v.details")


@query("""
SELECT doc_id, arg_max(label, rank) AS label FROM (
  SELECT doc_id, label, CASE label WHEN 'CAN_ANSWER' THEN 2 WHEN 'PARTIAL' THEN 1 ELSE 0 END AS rank FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'CAN_ANSWER' ELSE 'PARTIAL' END AS label FROM labels UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN 'NO_MATCH' ELSE 'PARTIAL' END FROM labels)
) GROUP BY doc_id
""")
def label_rank(spark, sf):
    labels = table(spark, sf, "labels")
    one = labels.select("doc_id", F.when(F.col("quality") == 1, "CAN_ANSWER").otherwise("PARTIAL").alias("label"))
    both = one.unionByName(labels.select("doc_id", F.when(F.col("toxic") == 1, "NO_MATCH").otherwise("PARTIAL").alias("label")))
    return both.groupBy("doc_id").agg(F.max_by("label", V.label_rank(F.col("label"))).alias("label"))


@query("""
SELECT conv_id, turn, label, label IN ('CAN_ANSWER', 'PARTIAL') AS passes FROM (
  SELECT conv_id, turn, CASE WHEN raw LIKE '%CAN_ANSWER%' THEN 'CAN_ANSWER' WHEN raw LIKE '%PARTIAL%' THEN 'PARTIAL' ELSE 'NO_MATCH' END AS label
  FROM (SELECT conv_id, turn, upper(coalesce(text, '') || ['can_answer', ' partial or no_match', '', ' partial, can_answer'][CAST(turn % 4 + 1 AS BIGINT)]) AS raw FROM conversations))
""")
def relevance_gate(spark, sf):
    raw = F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, ("can_answer", " partial or no_match", "", " partial, can_answer"))), (F.col("turn") % 4 + 1).cast("int")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", V.label_in(raw).alias("label"))
    return rows.withColumn("passes", F.col("label").isin("CAN_ANSWER", "PARTIAL"))


@query("SELECT o_orderkey, CASE WHEN n = 0 THEN -1 WHEN i >= 0 AND i < n THEN i ELSE 0 END AS selected, CASE WHEN n = 0 THEN NULL ELSE 'a' || (CASE WHEN i >= 0 AND i < n THEN i ELSE 0 END) END AS answer FROM (SELECT o_orderkey, CAST(o_orderkey % 5 - 1 AS INTEGER) AS i, CAST(o_orderkey % 4 AS INTEGER) AS n FROM orders)")
def selected_candidate(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 5 - 1).cast("int").alias("i"), F.slice(F.array(*[F.lit(f"a{i}") for i in range(4)]), 1, (F.col("o_orderkey") % 4).cast("int")).alias("answers"))
    rows = rows.withColumn("selected", V.selected_index(F.col("i"), F.size("answers")))
    return rows.select("o_orderkey", "selected", F.get("answers", F.col("selected")).alias("answer"))


@query("""
SELECT conv_id, turn, turn % 4 = 0 AS is_multi, CASE WHEN turn % 4 = 0 THEN [t, 'and ' || t] ELSE [t] END AS sub_queries FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g') AS t FROM conversations)
""")
def decompose_json(spark, sf):
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", "")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", t.alias("t"))
    good = F.concat(F.lit('Here: {"is_multi_query": true, "sub_queries": ["'), "t", F.lit('", "and '), "t", F.lit('"]} done'))
    kinds = F.when(F.col("turn") % 4 == 0, good).when(F.col("turn") % 4 == 1, '{"is_multi_query": true, "sub_queries": []}').when(F.col("turn") % 4 == 2, "no object").otherwise('{"is_multi_query": false')
    return rows.select("conv_id", "turn", X.decomposed(kinds, F.col("t")).alias("d")).select("conv_id", "turn", "d.*")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props)) AS n_keys FROM events WHERE props IS NOT NULL")
def props_json(spark, sf):
    return table(spark, sf, "events").filter("props IS NOT NULL").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


# --- charts and tables

_FEATURES = """
f AS (SELECT l_orderkey, l_linenumber, x, x % 23 AS lines, x // 3 % 5 AS diag, x // 5 % 8 AS circles, x // 7 % 14 AS rects, x // 11 % 16 AS horizontal, x // 13 % 16 AS vertical, CAST(x // 17 % 90 AS DOUBLE) AS angle_var, x // 19 % 3 = 0 AS bar_pattern,
  x // 23 % 5 AS large, x // 29 % 9 AS color_peaks, x // 31 % 2 = 0 AS text_region, x // 37 % 80 AS very_short, x // 41 % 150 AS small_scattered FROM (SELECT l_orderkey, l_linenumber, l_orderkey * 31 + l_linenumber * 977 + l_partkey AS x FROM lineitem)),
r AS (SELECT *, horizontal >= 1 OR vertical >= 1 AS axis, CASE WHEN text_region AND circles < 2 AND diag < 2 AND NOT bar_pattern AND (small_scattered > 100 OR very_short > 50) THEN 'text_slide'
  WHEN very_short > 50 AND circles < 2 AND diag < 3 AND lines < 10 THEN 'background' WHEN horizontal > 12 AND vertical > 12 AND circles = 0 AND diag < 2 AND (horizontal + vertical) / greatest(lines, 1) > 0.75 THEN 'table' END AS rejected FROM f),
t AS (SELECT *, (diag >= 2 AND angle_var > 40) OR (diag >= 1 AND axis) AS is_line FROM r),
c1 AS (SELECT *, CASE WHEN is_line THEN CASE WHEN axis THEN least(0.95::DOUBLE, least(0.88::DOUBLE, 0.6::DOUBLE + diag / 40) + 0.08::DOUBLE) ELSE least(0.88::DOUBLE, 0.6::DOUBLE + diag / 40) END ELSE 0.0::DOUBLE END AS c FROM t),
c2 AS (SELECT * REPLACE (CASE WHEN circles >= 5 THEN least(0.92::DOUBLE, 0.70::DOUBLE + least(circles, 20) * 0.01::DOUBLE) ELSE c END AS c) FROM c1),
c3 AS (SELECT * REPLACE (CASE WHEN circles >= 5 AND color_peaks > 5 THEN least(0.95::DOUBLE, c + 0.1::DOUBLE) ELSE c END AS c) FROM c2),
c4 AS (SELECT * REPLACE (CASE WHEN circles >= 5 AND large > 2 THEN least(0.97::DOUBLE, c + 0.05::DOUBLE) WHEN circles IN (3, 4) AND diag > 2 THEN greatest(c, 0.75::DOUBLE) ELSE c END AS c) FROM c3),
c5 AS (SELECT * REPLACE (CASE WHEN circles > 0 AND circles < 5 THEN greatest(c, 0.80::DOUBLE) ELSE c END AS c) FROM c4),
c6 AS (SELECT * REPLACE (CASE WHEN bar_pattern AND rects >= 6 THEN greatest(c, 0.75::DOUBLE + least(rects, 12) / 40) ELSE c END AS c) FROM c5),
c7 AS (SELECT * REPLACE (CASE WHEN circles >= 3 AND large >= 2 AND color_peaks > 5 THEN greatest(c, 0.85::DOUBLE) ELSE c END AS c) FROM c6),
c8 AS (SELECT * REPLACE (CASE WHEN (horizontal BETWEEN 1 AND 6 OR vertical BETWEEN 1 AND 6) AND (circles >= 3 OR diag >= 2 OR bar_pattern) AND c > 0.3 THEN least(0.90::DOUBLE, c + 0.10::DOUBLE) ELSE c END AS c) FROM c7),
k AS (SELECT *, list_sort(list_filter([CASE WHEN is_line THEN 'line_chart' END, CASE WHEN circles >= 5 THEN 'bubble_chart' END, CASE WHEN circles >= 5 AND large > 2 THEN 'zone_diagram' END, CASE WHEN circles IN (3, 4) AND diag > 2 THEN 'scatter_plot' END, CASE WHEN circles BETWEEN 1 AND 4 THEN 'pie_chart' END,
  CASE WHEN bar_pattern AND rects >= 6 THEN 'bar_chart' END, CASE WHEN circles >= 3 AND large >= 2 AND color_peaks > 5 THEN 'complex_visualization' END], lambda y: y IS NOT NULL)) AS types FROM c8),
z AS (SELECT l_orderkey, l_linenumber, rejected, CASE WHEN rejected IS NULL THEN round(c, 6) ELSE 0 END AS confidence, CASE WHEN rejected IS NULL THEN array_to_string(types, ',') ELSE '' END AS chart_types,
  rejected IS NULL AND len(types) > 0 AND c > 0.4 AND (is_line OR circles >= 5 OR (circles >= 3 AND large >= 2) OR bar_pattern OR (circles >= 3 AND color_peaks > 5)) AS has_chart FROM k)
"""


def _charts(spark, sf):
    x = F.col("l_orderkey") * 31 + F.col("l_linenumber") * 977 + F.col("l_partkey")
    part = lambda by, most: F.floor(x / by) % most
    made = dict(
        lines=part(1, 23), diag=part(3, 5), circles=part(5, 8), rects=part(7, 14), horizontal=part(11, 16), vertical=part(13, 16), angle_var=part(17, 90).cast("double"), bar_pattern=part(19, 3) == 0,
        large=part(23, 5), color_peaks=part(29, 9), text_region=part(31, 2) == 0, very_short=part(37, 80), small_scattered=part(41, 150),
    )
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in made.items()])
    return rows.withColumn("v", C.verdict()).select("l_orderkey", "l_linenumber", "v.*")


@query(f"WITH {_FEATURES} SELECT l_orderkey, l_linenumber, has_chart, confidence, chart_types, rejected FROM z")
def chart_rules(spark, sf):
    return _charts(spark, sf).select("l_orderkey", "l_linenumber", "has_chart", F.round("confidence", 6).alias("confidence"), F.array_join("chart_types", ",").alias("chart_types"), "rejected")


@query(f"""WITH {_FEATURES} SELECT l_linenumber, count(*) AS pages, CAST(count(*) FILTER (ok) AS BIGINT) AS charts, count(*) - CAST(count(*) FILTER (ok) AS BIGINT) AS saved_calls, round((count(*) - CAST(count(*) FILTER (ok) AS BIGINT)) * 0.0125, 4) AS cost_saved,
  CAST(ceil(CAST(count(*) FILTER (ok) AS BIGINT) / 4.0) AS BIGINT) AS batch_calls, round(CASE WHEN CAST(count(*) FILTER (ok) AS BIGINT) > 0 THEN ceil(CAST(count(*) FILTER (ok) AS BIGINT) / 4.0) * 0.0125 ELSE 0 END, 4) AS actual_cost, round(CASE WHEN CAST(count(*) FILTER (ok) AS BIGINT) > 0 THEN CAST(count(*) FILTER (ok) AS BIGINT) / ceil(CAST(count(*) FILTER (ok) AS BIGINT) / 4.0) ELSE 1.0 END, 4) AS efficiency
FROM (SELECT l_linenumber, has_chart AND confidence >= 0.4 AS ok FROM z) GROUP BY l_linenumber""")
def chart_cost(spark, sf):
    ok = F.col("has_chart") & (F.col("confidence") >= DEFAULTS.CHART_MIN_CONFIDENCE)
    rows = _charts(spark, sf).groupBy("l_linenumber").agg(F.count("*").alias("pages"), F.count_if(ok).alias("charts"))
    rows = rows.withColumn("saved_calls", F.col("pages") - F.col("charts")).withColumn("batch_calls", F.ceil(F.col("charts") / 4.0).cast("long"))
    cost = DEFAULTS.CHART_CALL_COST
    calls = F.when(F.col("batch_calls") > 0, F.col("batch_calls")).otherwise(F.col("charts"))
    return rows.select("l_linenumber", "pages", "charts", "saved_calls", F.round(F.col("saved_calls") * cost, 4).alias("cost_saved"), "batch_calls", F.round(calls * cost, 4).alias("actual_cost"), F.round(F.when(F.col("batch_calls") > 0, F.col("charts") / F.col("batch_calls")).otherwise(1.0), 4).alias("efficiency"))


@query(f"WITH {_FEATURES} SELECT l_orderkey, round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS std, count(*) >= 6 AND stddev_pop(confidence) < 0.3 * avg(confidence) AS bars, round(CASE WHEN count(*) > 2 THEN var_pop(confidence) ELSE 0 END, 12) AS variance FROM z GROUP BY l_orderkey")
def feature_reductions(spark, sf):
    c = F.col("confidence")
    rows = _charts(spark, sf).withColumn("confidence", F.round("confidence", 6)).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.avg(c).alias("m"), F.stddev_pop(c).alias("s"), F.var_pop(c).alias("v"))
    bars = C.bar_pattern(F.col("n"), F.col("m"), F.col("s"), F.lit(0.0), F.lit(1.0))
    return rows.select("l_orderkey", F.round("m", 6).alias("mean"), F.round("s", 6).alias("std"), bars.alias("bars"), F.round(F.when(F.col("n") > 2, F.col("v")).otherwise(0.0), 12).alias("variance"))


@query("""
SELECT p_partkey, kind, CAST(floor(w * r) AS BIGINT) AS width, CAST(floor(h * r) AS BIGINT) AS height FROM (
  SELECT p_partkey, CASE WHEN sqrt(dx * dx + dy * dy) < 50 THEN 'short' WHEN sqrt(dx * dx + dy * dy) < 80 THEN 'ignored' WHEN a < 10 OR a > 170 THEN 'horizontal' WHEN a > 80 AND a < 100 THEN 'vertical' ELSE 'diagonal' END AS kind, w, h, least(1.0::DOUBLE, 1000 / greatest(w, h)) AS r
  FROM (SELECT *, abs(degrees(atan2(dy, dx))) AS a FROM (SELECT p_partkey, CAST(p_partkey * 37 % 211 - 100 AS DOUBLE) AS dx, CAST(p_partkey * 53 % 197 - 90 AS DOUBLE) AS dy, p_partkey * 91 % 3000 + 1 AS w, p_partkey * 77 % 2500 + 1 AS h FROM part)))
""")
def line_geometry(spark, sf):
    p = F.col("p_partkey")
    dx, dy = (p * 37 % 211 - 100).cast("double"), (p * 53 % 197 - 90).cast("double")
    return table(spark, sf, "part").select("p_partkey", C.line_class(dx, dy).alias("kind"), C.scaled(p * 91 % 3000 + 1, p * 77 % 2500 + 1, 1000).alias("s")).select("p_partkey", "kind", "s.*")


_TITLES = "SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)', 1)), '') AS title FROM pages"


@query(f"SELECT min(page_id) AS page_id, title FROM ({_TITLES}) WHERE title IS NOT NULL GROUP BY title UNION ALL SELECT page_id, title FROM ({_TITLES}) WHERE title IS NULL")
def chart_title_dedup(spark, sf):
    found = F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)", 1)
    content = F.concat(F.lit("### Chart\n\n**Title**: "), F.regexp_replace(found, r"[\r\n]+", " "), F.lit("\n**Type**: bar"))
    rows = table(spark, sf, "pages").select("page_id", F.when(X.strip(found) == "", F.lit(None)).otherwise(X.title(content)).alias("title"))
    first = rows.filter("title IS NOT NULL").groupBy("title").agg(F.min("page_id").alias("page_id")).select("page_id", "title")
    return first.unionByName(rows.filter("title IS NULL"))


@query("""
SELECT page_id, CASE WHEN page_id % 4 < 3 THEN 'part ' || (page_id % 4) || ' of ' || (page_id // 4) ELSE 'Analysis unavailable (parsing error)' END AS analysis FROM pages
""")
def response_parse(spark, sf):
    """Four charts a response; of the fourth the model says nothing."""
    part = lambda i: F.concat(F.lit(f"---CHART {i + 1}---\n part {i} of "), F.col("b").cast("string"), F.lit(" \n"))
    rows = table(spark, sf, "pages").select("page_id", F.floor(F.col("page_id") / 4).alias("b"))
    response = F.concat(F.lit("Intro\n"), *[part(i) for i in range(3)])
    return rows.select("page_id", X.response_part(response, F.col("page_id") % 4).alias("analysis"))


@query("""
SELECT o_custkey, '### Table ' || o_custkey || ' (Page 1)' || chr(10) || '| key | status |  |' || chr(10) || '| --- | --- | --- |' || chr(10)
  || string_agg('| ' || o_orderkey || ' | ' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus || '\\|x' END || ' | ' || CASE WHEN o_orderkey % 3 = 0 THEN 'z' ELSE '' END || ' |', chr(10) ORDER BY o_orderkey) AS markdown
FROM (SELECT *, max(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS wide FROM orders) WHERE wide = 1 GROUP BY o_custkey
UNION ALL
SELECT o_custkey, '### Table ' || o_custkey || ' (Page 1)' || chr(10) || '| key | status |' || chr(10) || '| --- | --- |' || chr(10)
  || string_agg('| ' || o_orderkey || ' | ' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus || '\\|x' END || ' |', chr(10) ORDER BY o_orderkey)
FROM (SELECT *, max(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS wide FROM orders) WHERE wide = 0 GROUP BY o_custkey
""")
def table_markdown(spark, sf):
    """A ragged table of each customer's orders."""
    k = F.col("o_orderkey")
    cells = F.array(k.cast("string"), F.when(k % 4 != 0, F.concat(F.lit(" "), "o_orderstatus", F.lit("|x\n"))))
    rows = table(spark, sf, "orders").select("o_custkey", k, F.when(k % 3 == 0, F.concat(cells, F.array(F.lit("z")))).otherwise(cells).alias("cells"))
    tables = rows.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "cells"))), lambda x: x["cells"]).alias("body"))
    whole = F.concat(F.array(F.array(F.lit("key"), F.lit("status")), F.array(F.lit(""), F.lit(None).cast("string"))), F.col("body"))
    return tables.select("o_custkey", M.markdown(whole, F.col("o_custkey"), F.lit(1)).alias("markdown"))


@query("""
SELECT o_custkey, o_orderkey, CAST(sum(o_orderkey % 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS tables_count, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS table_index FROM orders
""")
def table_counter(spark, sf):
    """Orders as pages of a customer's document, each with a few tables; the count runs on."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.sum(F.col("o_orderkey") % 3).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("tables_count"), F.row_number().over(w).alias("table_index"))


@query("""
SELECT l_orderkey, body, min((l_linenumber % 4) * 100 + l_linenumber) AS first_seen FROM (SELECT l_orderkey, l_linenumber, '[["' || l_returnflag || '"],["' || l_linestatus || '"]]' AS body FROM lineitem WHERE l_linenumber <> 3) GROUP BY ALL
""")
def table_dedup(spark, sf):
    """Tables that several strategies find on a page (line items of an order) once each; one-row tables don't count."""
    cell = lambda c: F.array(F.col(c))
    body = F.when(F.col("l_linenumber") == 3, F.array(cell("l_returnflag"))).otherwise(F.array(cell("l_returnflag"), cell("l_linestatus")))
    rows = table(spark, sf, "lineitem").select("l_orderkey", body.alias("t"), ((F.col("l_linenumber") % 4) * 100 + F.col("l_linenumber")).alias("order")).filter(F.size("t") >= 2)
    return rows.groupBy("l_orderkey", F.to_json("t").alias("body")).agg(F.min("order").alias("first_seen"))


@query("""
SELECT 'text' AS type, doc_id AS id, coalesce(lang, 'none') AS kind, 1 AS page FROM documents UNION ALL SELECT 'chart', page_id, 'none', CAST(page_id % 5 AS INTEGER) FROM pages
""")
def document_union(spark, sf):
    texts = table(spark, sf, "documents").select(F.lit("text").alias("type"), F.col("doc_id").alias("id"), F.col("lang").alias("kind"))
    charts = table(spark, sf, "pages").select(F.lit("chart").alias("type"), F.col("page_id").alias("id"), (F.col("page_id") % 5).cast("int").alias("page"))
    return texts.unionByName(charts, allowMissingColumns=True).select("type", "id", F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("page", F.lit(1)).alias("page"))


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders),
c AS (SELECT *, sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM p)
SELECT o_custkey || '.pdf::h' AS source, CAST(page AS INTEGER) AS page, CAST(n AS BIGINT) AS tables_count, 'txt_h_' || page || '_0' AS chunk_id,
  '## Page ' || page || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || chr(10) || '### Table ' || n || ' (Page ' || page || ')' || chr(10) || '| a | ' || o_orderkey || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderstatus || ' |  |' ELSE '' END
  || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE chr(10) || chr(10) || 'order ' || o_orderkey END AS content
FROM c WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0
""")
def page_documents(spark, sf):
    """A customer as a file and each order as a page of it, as a reader gives them: tables found twice, tables of one row, empty texts."""
    k = F.col("o_orderkey").cast("string")
    one = F.array(F.array(F.lit("a"), k), F.array(F.col("o_orderstatus")))
    found = F.when(F.col("o_orderkey") % 2 == 0, F.array(one, F.array(F.array(F.lit("x"))), one))
    rows = table(spark, sf, "orders").withColumn("page", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    read = rows.select(F.concat(F.lit("in/"), F.col("o_custkey").cast("string"), F.lit(".pdf")).alias("path"), F.lit("h").alias("file_hash"), "page", F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit(" order "), k, F.lit("\n"))).alias("text"), found.alias("tables"))
    return pages.documents(read).select("source", "page", "tables_count", "chunk_id", "content")


# --- streams and workflow

_LIMIT = """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (
  SELECT event_id, user_id, i, CAST([t] AS BIGINT[]) AS log, true AS admitted FROM e WHERE i = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.i, CASE WHEN len(k) < CALLS THEN list_append(k, e.t) ELSE k END, len(k) < CALLS
  FROM (SELECT e.event_id, e.user_id, e.i, e.t, list_filter(s.log, lambda x: e.t - x <= CAST(WINDOW AS BIGINT) * 1000000) AS k FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1) e
)
SELECT event_id AS id, admitted FROM s
"""


def _calls(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"))


@query(_LIMIT.replace("CALLS", "5").replace("WINDOW", "3600"))
def rate_limit(spark, sf):
    return R.limited(_calls(spark, sf))


@query(_LIMIT.replace("CALLS", "2").replace("WINDOW", "86400"))
def rate_limit_day(spark, sf):
    return R.limited(_calls(spark, sf), 86400, 2)


def _chunk_rows(spark, sf):
    """Documents as files, cut into the chunks that are indexed: doc_id is the chunk's id, and ``number`` a number for it."""
    docs = _chunked(table(spark, sf, "documents").select("doc_id", "text", "source"))
    pages = docs.select(F.col("stable_source").alias("source"), F.lit(1).alias("page"), F.lit("text").alias("type"), "file_hash", F.coalesce("text", F.lit("")).alias("content"))
    return files.chunked(pages).dropDuplicates(["doc_id"])


def _embedded(rows: DataFrame, key: str, text: str) -> DataFrame:
    return embed.dense(embed.hashed(rows, key, text), key)


@query()
def answer_questions(spark, sf):
    """The whole workflow with offline providers: every question of ``benchmark``, part by part, against the chunks of all documents.

    Chunks are retrieved by words and by vectors, and the two lists fused.
    """
    texts = written(_chunk_rows(spark, sf).select(F.monotonically_increasing_id().alias("doc_id"), F.col("content").alias("text")), "chunks")
    vectors = written(embed.dense_rows(texts, "doc_id", "text").withColumnRenamed("doc_id", "id"), "vectors")
    at = f"{_shared(spark)}/words-{uuid.uuid4().hex}"
    postings.append(texts, at)
    index = postings.Index(spark, at)

    def retrieve(questions):
        asked = written(questions.withColumn("query", F.monotonically_increasing_id()), "asked")
        queries = embed.dense_rows(asked, "query", "text")
        by_vector = vector.diverse(vector.nearest(queries, vectors), queries, vectors)
        by_words = postings.search(index, asked.select(F.col("query").alias("question"), "text"), written)
        one = by_words.select(F.col("question").alias("query"), F.lit(0).alias("retriever"), "rank", F.lit(DEFAULTS.BM25_WEIGHT).alias("weight"), F.col("doc").alias("id"))
        fused = fusion.fuse(one.unionByName(by_vector.select("query", F.lit(1).alias("retriever"), "rank", F.lit(DEFAULTS.VECTOR_WEIGHT).alias("weight"), "id")))
        found = written(fused, "fused").join(texts.withColumnRenamed("doc_id", "id"), "id").select("query", "rank", F.col("text").alias("content"))
        return found.join(asked.select("query", "question"), "query").select("question", "rank", "content")

    return workflow.answer_parts(_questions(spark, sf), retrieve, save=written)


@query("""
WITH q AS (SELECT item_id AS question, text, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS asked FROM benchmark),
c AS (SELECT doc_id AS question, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS ws FROM documents),
s AS (SELECT question, CASE WHEN len(asked) = 0 THEN 0 ELSE len(list_intersect(asked, coalesce(ws, []))) / len(asked) END AS share FROM q LEFT JOIN c USING (question))
SELECT question, CASE WHEN share >= 0.3 THEN CASE WHEN share >= 0.6 THEN 'CAN_ANSWER' ELSE 'PARTIAL' END ELSE 'NO_MATCH' END AS classification FROM s
""")
def question_relevance(spark, sf):
    """The offline provider's classification of every question of ``benchmark`` by the document with its number."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("question"), F.col("text").alias("context"))
    return workflow.relevance(_questions(spark, sf), docs, workflow.Offline()).select("question", "classification")


@query("SELECT conv_id, turn FROM conversations WHERE regexp_matches(coalesce(text, ''), '[^\\s]') AND turn % 7 <> 1")
def non_empty(spark, sf):
    """The guard for empty inputs; every seventh turn is blanked first."""
    said = table(spark, sf, "conversations").withColumn("text", F.when(F.col("turn") % 7 == 1, " \n").otherwise(F.col("text")))
    return said.filter(X.said(F.col("text"))).select("conv_id", "turn")


@query("""
SELECT question, CAST(i - 1 AS INTEGER) AS idx, parts[CAST(i AS BIGINT)] AS text FROM (
  SELECT question, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT question, CASE WHEN length(text) - length(replace(text, '?', '')) > 1 THEN list_transform(list_filter(list_transform(string_split(text, '?'), lambda x: trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> ''), lambda x: x || '?') ELSE [text] END AS parts
    FROM (SELECT conv_id * 1000 + turn AS question, coalesce(text, '') || CASE WHEN turn % 3 = 0 THEN '? And why? ' ELSE '' END AS text FROM conversations WHERE role = 'user')))
""")
def question_parts(spark, sf):
    """What the users of ``conversations`` say, every third time as two questions, in parts."""
    said = table(spark, sf, "conversations").filter("role = 'user'")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, "? And why? ").otherwise(""))
    return workflow.decompose(said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question"), text.alias("text")), workflow.Offline())


@query("""
SELECT doc_id, count(DISTINCT CAST(('0x' || substr(md5(lower(word)), 1, 4)) AS INTEGER) % 64) AS n_places FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS word FROM documents) GROUP BY doc_id
""")
def vector_store(spark, sf):
    """A store that is opened, added to twice and read: the second time all documents come, and those that it has are left out."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows, path = saved(_embedded(docs, "doc_id", "text"), "vectors"), f"{_shared(spark)}/store-{uuid.uuid4().hex}"
    store.append(rows.filter("doc_id % 3 = 0"), path)
    store.append(rows, path)
    return store.opened(spark, path, rows.schema).select("doc_id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("n_places"))


@query(f"""
WITH {_FEATURES}, k2 AS (SELECT l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS page FROM z WHERE has_chart AND confidence >= 0.4),
b AS (SELECT *, (row_number() OVER (PARTITION BY file ORDER BY page) - 1) // 4 + 1 AS batch FROM k2)
SELECT file, min(page) AS page, arg_min(batch, page) AS batch, 'Chart ' || (page % 3) AS title FROM b GROUP BY file, page % 3
""")
def chart_flow_titles(spark, sf):
    """Line items of an order as pages of a file: rules, batches of four for a provider, one chart a title."""
    rows = _charts(spark, sf).select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("page"), "has_chart", "confidence")
    return chart_flow.one_a_title(chart_flow.analysed(rows)).select("file", "page", "batch", "title")


@query("""
WITH w AS (SELECT doc_id, CAST(('0x' || substr(md5(lower(word)), 1, 4)) AS INTEGER) % 64 AS at_place FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS word FROM documents)),
c AS (SELECT doc_id, at_place, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, at_place AS place, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c
""")
def hashed_embedding(spark, sf):
    return embed.hashed(table(spark, sf, "documents")).select("doc_id", F.col("at").alias("place"), F.round("weight", 6).alias("weight"))


@query("""
SELECT conv_id, turn, 'Can the context answer the question? Answer CAN_ANSWER, PARTIAL or NO_MATCH.' || CASE WHEN coalesce(text, '') = '' THEN '' ELSE chr(10) || chr(10) || 'Question:' || chr(10) || text END || CASE WHEN turn % 2 = 0 THEN '' ELSE chr(10) || chr(10) || 'Context:' || chr(10) || role END AS prompt FROM conversations
""")
def prompt_render(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", P.prompt("relevance", question=F.col("text"), context=F.when(F.col("turn") % 2 == 1, F.col("role"))).alias("prompt"))


_KINDS = tuple(P.ASKS)


@query(f"""
SELECT conv_id, turn, [{', '.join("'" + x.replace("'", "''") + "'" for x in P.ASKS.values())}][CAST(turn % {len(_KINDS)} + 1 AS BIGINT)] || CASE WHEN coalesce(text, '') = '' THEN '' ELSE chr(10) || chr(10) || 'Question:' || chr(10) || text END AS prompt FROM conversations
""")
def prompt_kinds(spark, sf):
    """Every kind of prompt in turn."""
    kinds = F.coalesce(*[F.when(F.col("turn") % len(_KINDS) == i, P.prompt(kind, question=F.col("text"))) for i, kind in enumerate(_KINDS)])
    return table(spark, sf, "conversations").select("conv_id", "turn", kinds.alias("prompt"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'again' WHEN doc_id % 5 = 0 THEN 'changed' ELSE coalesce(text, '') END AS text FROM documents
WHERE doc_id % 11 = 0 OR ((doc_id % 3 <> 1 OR doc_id % 5 = 0) AND doc_id % 7 <> 0)
""")
def versioned_store(spark, sf):
    """A table that documents are put into, changed, deleted from, compacted, and put into again; read at its last version."""
    docs, at = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), f"{_shared(spark)}/versions-{uuid.uuid4().hex}"
    versioned.write(docs.filter("doc_id % 3 <> 1"), at)
    versioned.write(docs.filter("doc_id % 5 = 0").withColumn("text", F.lit("changed")), at)
    versioned.delete(docs.filter("doc_id % 7 = 0").select("doc_id"), at)
    versioned.compact(spark, at, docs.schema)
    versioned.write(docs.filter("doc_id % 11 = 0").withColumn("text", F.lit("again")), at)
    return versioned.read(spark, at, docs.schema)


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def stream_index(spark, sf):
    """Documents read as a stream into a table with versions; a second stream over the same files repeats its epochs and adds nothing."""
    folder, source = f"{_shared(spark)}/stream-{uuid.uuid4().hex}", f"{sf}/documents.parquet*"
    schema = table(spark, sf, "documents").schema
    made = lambda df: df.dropDuplicates(["doc_id"]).select("doc_id", I.sha256(F.coalesce("text", F.lit(""))).alias("content_hash"))
    for turn in range(2):
        rows = spark.readStream.schema(schema).parquet(source)
        versioned.stream_into(rows, f"{folder}/table", f"{folder}/checkpoint-{turn}", "documents", made).awaitTermination()
    return versioned.read(spark, f"{folder}/table", "doc_id long, content_hash string")


@query("SELECT doc_id, replace(coalesce(text, ''), chr(12), ' ') AS text FROM documents")
def page_files(spark, sf):
    """Documents written as files of pages, a page a document, and read back by the page source in partitions of a file's pages."""
    docs, at = table(spark, sf, "documents"), f"{_shared(spark)}/pages-{uuid.uuid4().hex}"
    page = F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\f"), F.lit(" ")))
    docs.select(page.alias("value")).write.option("lineSep", "\f").text(at)
    page_format.register(spark)
    read = spark.read.format("corvine_pages").option("share", 4 << 20).load(at)
    return read.select(F.substring_index("text", "\n", 1).cast("long").alias("doc_id"), F.expr("substring(text, locate('\n', text) + 1)").alias("text"))


@query("""
SELECT doc_id AS id, 'gone' AS change FROM documents WHERE doc_id % 97 = 0
UNION ALL SELECT doc_id, 'changed' FROM documents WHERE doc_id % 89 = 0 AND doc_id % 97 <> 0
UNION ALL SELECT doc_id + 1000000000, 'new' FROM documents WHERE doc_id % 101 = 0
""")
def docset_difference(spark, sf):
    """What has changed between two kept sets of documents: some are left out of the second, some have another text, some are new."""
    docs, at = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), I.sha256(F.coalesce("text", F.lit(""))).alias("digest")), f"{_shared(spark)}/sets-{uuid.uuid4().hex}"
    changed = docs.filter("id % 97 <> 0").withColumn("digest", F.when(F.col("id") % 89 == 0, "other").otherwise(F.col("digest")))
    hash_tree.keep(docs, f"{at}/before")
    hash_tree.keep(changed.unionByName(docs.filter("id % 101 = 0").withColumn("id", F.col("id") + 1_000_000_000)), f"{at}/after")
    return hash_tree.difference(spark, f"{at}/before", f"{at}/after")


@query("SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN NULL ELSE length(p) || ':' || substr(p, 1, 12) END AS answer, CASE WHEN turn % 5 = 3 THEN 'ValueError: no answer' END AS error FROM (SELECT conv_id, turn, (turn % 5) || ' ' || coalesce(text, '') AS p FROM conversations)")
def remembered_answers(spark, sf):
    """Prompts from ``conversations`` for a provider, with a memory: first a third of them, then all; some prompts fail."""

    def complete(prompt: str) -> str:
        if prompt.startswith("3"):
            raise ValueError("no answer")
        return f"{len(prompt)}:{prompt[:12]}"

    memory = f"{_shared(spark)}/answers-{uuid.uuid4().hex}"
    said = table(spark, sf, "conversations")
    prompts = said.select("conv_id", "turn", F.concat((F.col("turn") % 5).cast("string"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("prompt"))
    answers.answered(prompts.filter("conv_id % 3 = 0"), memory, complete, written)
    return answers.answered(prompts, memory, complete, written).select("conv_id", "turn", "answer", "error")


_TURNS = ", ".join(f"({i}, {c}, {s})" for i, (c, s) in enumerate(line_voting.TURNS))


@query(f"""
WITH px AS (
  SELECT image, x0 + k * ([1, 0, 1, 2])[d] AS x, y0 + k * ([0, 1, 1, 1])[d] AS y, value FROM (
    SELECT l_orderkey AS image, l_partkey % 60 AS x0, l_suppkey % 60 AS y0, l_linenumber % 4 + 1 AS d, l_partkey % 256 AS value, unnest(range(0, CAST(l_quantity AS BIGINT) // 2)) AS k FROM lineitem)
), t(angle, c, s) AS (VALUES {_TURNS}), v AS (
  SELECT image, angle, CAST(floor((x * c + y * s + 512) / 1024.0::DOUBLE) AS BIGINT) AS distance, count(*) AS votes, min(y * c - x * s) AS low, max(y * c - x * s) AS high FROM px, t GROUP BY ALL HAVING count(*) >= {line_voting.LEAST}
), p AS (
  SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.image = v.image AND abs(o.angle - v.angle) <= 1 AND abs(o.distance - v.distance) <= 1
    AND (o.votes > v.votes OR (o.votes = v.votes AND (o.angle < v.angle OR (o.angle = v.angle AND o.distance < v.distance)))))
), l AS (
  SELECT image, (angle * {line_voting.STEP} + 90) % 180 AS direction, (high - low) / 1024.0::DOUBLE * {line_voting.SCALE} AS length, atan2(c / 1024.0::DOUBLE, -s / 1024.0::DOUBLE) * 180 / pi() AS a, c, s FROM p JOIN t USING (angle)
), k AS (
  SELECT *, CASE WHEN length * sqrt(c * c + s * s) / 1024.0::DOUBLE < 50 THEN 'short' WHEN length * sqrt(c * c + s * s) / 1024.0::DOUBLE < 80 THEN 'ignored' WHEN abs(a) < 10 OR abs(a) > 170 THEN 'horizontal' WHEN abs(a) > 80 AND abs(a) < 100 THEN 'vertical' ELSE 'diagonal' END AS kind FROM l
), n AS (SELECT image, CAST(value // 16 AS BIGINT) AS bin, count(*) AS n FROM px GROUP BY ALL),
h AS (SELECT image, count(*) FILTER (n > 0.05::DOUBLE * total) AS color_peaks FROM (SELECT *, sum(n) OVER (PARTITION BY image) AS total FROM n) GROUP BY image)
SELECT image, count(*) AS lines, count(*) FILTER (kind = 'horizontal') AS horizontal, count(*) FILTER (kind = 'vertical') AS vertical, count(*) FILTER (kind = 'diagonal') AS diag, count(*) FILTER (kind = 'short') AS very_short,
  round(CASE WHEN count(*) > 2 THEN var_pop(direction) ELSE 0 END, 6) AS angle_var, any_value(color_peaks) AS color_peaks
FROM k JOIN h USING (image) GROUP BY image
""")
def picture_features(spark, sf):
    """Orders as pictures, in which each line item draws a stroke: lines by voting, their classes and spread, and histogram peaks."""
    d = F.col("l_linenumber") % 4
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (d + 1).cast("int"))
    rows = table(spark, sf, "lineitem").filter("l_quantity >= 2")
    strokes = rows.select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 60).alias("x0"), (F.col("l_suppkey") % 60).alias("y0"), pick(1, 0, 1, 2).alias("dx"), pick(0, 1, 1, 1).alias("dy"), (F.col("l_partkey") % 256).alias("value"), F.expr("CAST(l_quantity AS BIGINT) DIV 2").alias("n"))
    # strokes are shuffled, not their pixels
    strokes = strokes.repartition("image").sortWithinPartitions("image").select("*", F.explode(F.expr("sequence(0L, n - 1)")).alias("k"))
    pixels = strokes.select("image", (F.col("x0") + F.col("k") * F.col("dx")).alias("x"), (F.col("y0") + F.col("k") * F.col("dy")).alias("y"), "value")
    return line_voting.picture_features(line_voting.pictures(pixels)).withColumn("angle_var", F.round("angle_var", 6))


@query()
def learned_embedding(spark, sf):
    """Vectors of all documents in the directions that most of the corpus lies in; held against a full decomposition in a test."""
    sparse = written(learned.rows(table(spark, sf, "documents").select("doc_id", "text"), written), "sparse")
    return learned.embedded(sparse, learned.fit(sparse))


@query("""
WITH c AS (SELECT doc_id, doc_id // 2 AS name, doc_id % 5 AS kind, coalesce(text, '') AS text FROM documents),
f AS (SELECT name, min(doc_id) AS number FROM c WHERE kind < 3 GROUP BY name)
SELECT w.doc_id AS wanted, coalesce(f.number, -1) AS number, CASE WHEN c.kind < 2 THEN sha256(c.text) WHEN c.kind = 2 THEN sha256('stored ' || c.doc_id) END AS file_hash
FROM (SELECT doc_id FROM documents) w LEFT JOIN f ON f.name = w.doc_id LEFT JOIN c ON c.doc_id = f.number
""")
def dataset_rows(spark, sf):
    """Documents as rows of a data set with cells of four kinds and null ones; the first row with each wanted file name."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    kind, path = F.col("doc_id") % 5, F.concat(F.lit("data/"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".pdf"))
    made = [F.struct(path.alias("path"), "bytes"), F.struct(F.struct(path.alias("name")).alias("stream"), "bytes"), path, F.col("bytes"), F.lit(None).cast("string")]
    parts = [files.cells(docs.filter(kind == i).select("doc_id", cell.alias("pdf")), "pdf", "doc_id") for i, cell in enumerate(made)]
    stored = docs.filter(kind == 2).groupBy(path.alias("path")).agg(F.min("doc_id").alias("n")).select("path", F.concat(F.lit("stored "), F.col("n").cast("string")).cast("binary").alias("content"))
    wanted = docs.select(F.concat(F.lit("/tmp/x/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("wanted"))
    found = files.extracted(wanted, parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4]), stored)
    return found.select(F.regexp_extract("wanted", r"(\d+)\.pdf", 1).cast("long").alias("wanted"), F.coalesce("number", F.lit(-1)).cast("long").alias("number"), F.sha2("content", 256).alias("file_hash"))
