"""BM25 (Okapi, with the floor for frequent terms) over a corpus, for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.config import DEFAULTS
from corvine.functions.text import words


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, term, tf): partial counts are made before the shuffle."""
    terms = docs.select(F.col(key).alias("doc"), F.explode(words(F.col(text))).alias("term"))
    return terms.groupBy("doc", "term").agg(F.count("*").alias("tf"))


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): a row's different words once each, so counts are summed up before the shuffle and no pair is shuffled."""
    return docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.coalesce(F.size(words(F.col(text))), F.lit(0)).cast("long").alias("dl"))


def corpus_stats(doc_lengths: DataFrame) -> DataFrame:
    return doc_lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_stats(df: DataFrame, stats: DataFrame, epsilon: float = DEFAULTS.BM25_EPSILON) -> DataFrame:
    """(term, df) -> (term, df, idf): a negative idf becomes ``epsilon`` times the mean over the vocabulary. ``stats`` has one row."""
    raw = df.crossJoin(F.broadcast(stats.select("n"))).withColumn("idf0", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("idf0").alias("mean_idf"))
    idf = F.when(F.col("idf0") >= 0, F.col("idf0")).otherwise(epsilon * F.col("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf"))


def filled(scored: DataFrame, questions: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(question, doc, score) -> the ``k`` best with ``rank``, filled up with the first documents where fewer score."""
    ranked = Window.partitionBy("question").orderBy(F.desc("score"), "doc")
    best = scored.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).drop("rank")
    first = docs.orderBy("doc").limit(2 * k)
    fill = questions.select("question").crossJoin(F.broadcast(first)).select("question", "doc", F.lit(0.0).alias("score"), F.lit(0).alias("scored"))
    every = best.withColumn("scored", F.lit(1)).unionByName(fill).groupBy("question", "doc").agg(F.max_by("score", "scored").alias("score"))
    return every.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def top_documents(questions: DataFrame, docs: DataFrame, k: int = DEFAULTS.BM25_SEARCH_K, k1: float = DEFAULTS.BM25_K1, b: float = DEFAULTS.BM25_B) -> DataFrame:
    """(question, text) x (doc_id, text) -> (question, doc, score, rank) of the ``k`` best, ties by doc.

    Only terms of questions are scored. Documents that share no term score 0: where fewer than ``k`` score, the first such
    documents fill up, so each question has ``k`` rows if the corpus has.
    """
    asked = questions.select("question", F.explode(words(F.col("text"))).alias("term")).groupBy("question", "term").agg(F.count("*").alias("qtf"))
    stats = corpus_stats(lengths(docs))
    terms = term_stats(document_counts(docs), stats).join(asked.select("term").distinct(), "term", "left_semi")
    # the length comes along, so postings meet nothing but the terms that are asked for, before they are shuffled
    every_word = docs.select(F.col("doc_id").alias("doc"), words(F.col("text")).alias("words"))
    wanted = every_word.select("doc", F.size("words").cast("long").alias("dl"), F.explode("words").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    wanted = wanted.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl")).join(terms, "term").crossJoin(F.broadcast(stats))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = wanted.select("term", "doc", weight.alias("weight")).join(asked, "term").groupBy("question", "doc").agg(F.round(F.sum(F.col("qtf") * F.col("weight")), 6).alias("score"))
    return filled(scored, questions, docs.select(F.col("doc_id").alias("doc")), k)
