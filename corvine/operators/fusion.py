"""Weighted reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.config import DEFAULTS


def contribution(rank: Column, weight: Column, c: int = DEFAULTS.RRF_C) -> Column:
    """``rank`` counts from 1."""
    return weight / (rank + c)


def fuse(lists: DataFrame, k: int = DEFAULTS.VECTOR_SEARCH_K, c: int = DEFAULTS.RRF_C) -> DataFrame:
    """(query, retriever from 0, rank from 1, weight, id) -> (query, id, score, rank) of the ``k`` best.

    Ties go to what was seen first: the earlier retriever, then the better rank. An id that a list repeats counts twice.
    """
    seen = F.min(F.struct("retriever", "rank"))
    fused = lists.groupBy("query", "id").agg(F.round(F.sum(contribution(F.col("rank"), F.col("weight"), c)), 9).alias("score"), seen.alias("seen"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "seen", "id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "id", "score", "rank")


def pages(hits: DataFrame, *keys: str) -> DataFrame:
    """The sorted set of pages of each group; nulls are left out."""
    return hits.groupBy(*keys).agg(F.array_sort(F.collect_set("page")).alias("pages"))
