"""Mixing sources to target weights by capped water-filling.

Every source has a size, a weight and a cap of ``max_epochs`` times its size. Weights share the requested total in
proportion; a source whose part is above its cap is clamped, and the excess goes to the others by weight until no part
is above its cap. The level is found in rounds over the table of sources: each round is one aggregation that returns
three numbers.

A source then gives ``floor(target / size)`` whole repetitions of each document, and one more of the documents that come
first in a seeded hash order until the rest of the target is met. The running sum is exact and distributed: the hash's
first 16 bits deal each source to 65,536 buckets, bucket totals are summed up in bucket order, and the sum within a
bucket is a window over (source, bucket). So a source that holds a third of all rows is no more than many small groups.

Defined results: a null text has size 0; null sources form one source, which comes last; documents of size 0 take 0 words;
rows that repeat a doc_id are separate documents (ties in hash order go by size); an empty table gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvine.llm.common import WORD, read, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE, MAX_EPOCHS, SEED = 1.5, 2.0, "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """Adds ``weight`` to one row per source: ``weights``, repeating, by source in code-point order, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))


def fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): the capped water-filling of ``total``."""
    cap = F.lit(max_epochs) * F.col("source_size")
    level, clamped = 0.0, -1
    free_weight = sources.agg(F.sum("weight")).first()[0] or 0.0
    clamped_size = 0.0
    while free_weight:
        level = (total - clamped_size) / free_weight
        above = F.lit(level) * F.col("weight") > cap
        found = sources.agg(
            F.count_if(above).alias("n"), F.sum(F.when(above, cap).otherwise(0.0)).alias("size"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight")
        ).first()
        if found["n"] == clamped:
            break
        clamped, clamped_size, free_weight = found["n"], found["size"], found["weight"]
    target = F.least(cap, F.lit(level) * F.col("weight")) if free_weight else cap
    return sources.withColumn("target", target.cast("double"))


def mix(docs: DataFrame, weigh=cyclic_weights, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED, keep: tuple = ()) -> DataFrame:
    """(doc_id, source, size) -> those, the columns ``keep``, source_size, target, repeats, taken.

    ``weigh`` adds a weight to one row per source; ``share`` of all sizes is what the mix holds; ``seed`` fixes the choice.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = written(docs.select("doc_id", "source", "size", *keep, key.alias("mix_key")).withColumn("mix_bucket", F.substring("mix_key", 1, 4)), "mix-docs")
    buckets = docs.groupBy("source", "mix_bucket").agg(F.sum("size").alias("bucket_size"))
    sources = written(weigh(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    targets = fill(sources, share * total, max_epochs)
    before = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = buckets.withColumn("bucket_start", F.coalesce(before, F.lit(0))).select(F.col("source").alias("b_source"), F.col("mix_bucket").alias("b_bucket"), "bucket_start")
    within = F.sum("size").over(Window.partitionBy("source", "mix_bucket").orderBy("mix_key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1))
    placed = docs.withColumn("within", F.coalesce(within, F.lit(0))).join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("mix_bucket") == F.col("b_bucket")))
    placed = placed.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    once_more = 2 * (F.col("bucket_start") + F.col("within")) + F.col("size") <= 2 * rest
    return (
        placed.withColumn("whole", whole)
        .withColumn("repeats", F.col("whole") + F.when(once_more & (F.col("size") > 0), 1).otherwise(0))
        .select("doc_id", "source", "size", *keep, "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))
    )


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS DOUBLE) AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS total
  FROM s
), o AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv, cap / weight AS ratio
  FROM w
), l AS (
  SELECT min(ratio) AS first_free FROM o WHERE lv * weight <= cap
), t AS (
  SELECT source, source_size,
         CASE WHEN (SELECT first_free FROM l) IS NULL THEN cap
              ELSE least(cap, weight * (SELECT min(lv) FROM o WHERE ratio = (SELECT first_free FROM l) AND lv * weight <= cap)) END AS target
  FROM o
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS BIGINT) AS whole,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""
