"""Documents to training tokens in five stages, each one operator of ``corvine.llm`` over all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``, each with
its own values whatever an operator calls what it adds. Its result has to be written before the next stage begins, which
removes the tables behind it; other queries' tables stay.

Defined results: null and empty texts are rejected by the first stage; of repeated rows the near-duplicate stage keeps one;
a text of any length goes through whole; an empty table gives an empty one in each stage; further columns are kept, also
those that are called as columns of an operator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import bpe, jaccard, mix, ppm, repeats
from corvine.llm.common import cleaned, packed, read, removed, shared_dir, tables_in, written
from corvine.session import ship

#: A text in a learned language takes fewer bits for a byte than this (2.2 mostly); one in another script or of random signs takes more.
MOST_BITS = 6.0


def columns_of(docs: DataFrame, names: list[str], **new: Column) -> list[Column]:
    """The columns of ``docs`` again, of which ``names`` were packed; those in ``new`` anew."""
    return [new.get(c, F.col(f"rest.`{c}`") if c in names else F.col(f"`{c}`")).alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no learned language codes well, and those without a letter; the others get the predicted ``lang``."""
    model = ppm.fit(docs.filter(ppm.remainder(F.col("doc_id")) != 2))
    held, names = packed(docs, "text")
    known = (F.col("lang_pred") != ppm.UNDETERMINED) & (F.col("bits_per_byte") < MOST_BITS)
    return ppm.identify(held, model).filter(known).select(*columns_of(docs, names, lang=F.col("lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word shingles with a similarity of 0.8 or more link."""
    held, names = packed(docs, "text", "doc_id")
    return jaccard.with_text(jaccard.jaccard_join(held).filter("kept")).select(*columns_of(docs, names))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what a 200-byte string covers that is elsewhere too; a character stays if one of its bytes does."""
    held, names = packed(docs, "text")
    text = F.col("kept").cast("string")
    return repeats.repeats(held, characters=True).select(*columns_of(docs, names, text=text, n_chars=F.length(text).cast("long")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those that it doesn't take go."""
    held, names = packed(docs, "doc_id", "source", "text")
    held = written(held.withColumn("m_row", F.monotonically_increasing_id()), "pipeline-docs")
    plan = mix.mix(held.withColumn("size", mix.word_count(F.col("text"))), keep=("m_row",)).filter("repeats > 0").select("m_row", "repeats")
    times = F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))
    return held.join(plan, "m_row").withColumn("m_time", times).select(*columns_of(docs, names))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with digests of ids and of what they decode to."""
    import public_tokenizers

    docs = docs.select("doc_id", "lang", "source", "text")
    return bpe.encode_decode(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN, keep_ids=True)


def alone(stage):
    """A stage with a folder of its own for intermediate tables; it begins by removing that of the stage before."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        context = spark.sparkContext
        if before := getattr(context, "_corvine_stage", None):
            removed(spark, before)
        context._corvine_stage = f"{shared_dir(spark)}/corvine-stages/{uuid.uuid4().hex}"
        with tables_in(context._corvine_stage):
            return stage(spark, docs, sf_dir)

    return run_stage


_STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", mixture),
    ("byte_bpe", tokens),
]
STAGES = [(name, alone(stage)) for name, stage in _STAGES]
#: Four stages are beyond SQL; ``tests/llm/test_pipeline.py`` holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, in a folder of this run's own; what a stage leaves is removed when the next one is written."""
    ship(spark)
    docs, folder, before = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corvine-pipeline/{uuid.uuid4().hex}", None
    for name, stage in _STAGES[:-1]:
        with tables_in(f"{folder}/tables-{name}"), cleaned(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        for done in (f"{folder}/tables-{name}", before):
            if done:
                removed(spark, done)
        before = f"{folder}/{name}"
    return _STAGES[-1][1](spark, docs, sf_dir)
