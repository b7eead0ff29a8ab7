"""Contexts, chats and combined answers, rendered for many questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions import text as X


def ordered(order: Column, value: Column) -> Column:
    """The values of a group in order. Groups here are the few best chunks of a question, or the turns of a chat."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])


def joined_context(ranked: DataFrame, k: int, most_chars: int) -> DataFrame:
    """(question, rank, content) -> (question, context): the first ``k`` contents, blank lines between, cut to a length."""
    return ranked.filter(F.col("rank") <= k).groupBy("question").agg(F.substring(F.array_join(ordered(F.col("rank"), F.col("content")), "\n\n"), 1, most_chars).alias("context"))


def rendered_context(ranked: DataFrame, shown: int = 5) -> DataFrame:
    """(question, text, rank, source, content) -> (question, context): chunks folded, shortened and highlighted, and a count of the others."""
    body = X.highlighted(X.truncated(F.col("content")), X.key_terms(F.col("text")))
    rows = ranked.withColumn("entry", F.when(F.col("rank") <= shown, X.context_entry(F.col("rank"), F.col("source"), body)))
    groups = rows.groupBy("question").agg(F.count("*").alias("n"), ordered(F.col("rank"), F.coalesce("entry", F.lit(""))).alias("entries"))
    head = F.concat(F.lit("### 📚 Retrieved Context ("), F.col("n").cast("string"), F.lit(" chunks)\n"))
    more = F.when(F.col("n") > shown, F.array(F.concat(F.lit("\n*... and "), (F.col("n") - shown).cast("string"), F.lit(" more chunks*")))).otherwise(F.array().cast("array<string>"))
    return groups.select("question", F.array_join(F.concat(F.array(head), F.slice("entries", 1, shown), more), "\n").alias("context"))


def combined(sub_results: DataFrame, key: str) -> DataFrame:
    """(key, idx, question, answer) -> (key, answer): numbered by place, whatever gaps idx has."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", "question", "answer"))), lambda x, i: F.concat(F.lit("Q"), (i + 1).cast("string"), F.lit(": "), x["question"], F.lit("\nA: "), x["answer"]))
    return sub_results.groupBy(key).agg(F.array_join(rows, "\n\n").alias("answer"))


def rendered_chat(turns: DataFrame, key: str) -> DataFrame:
    """(key, at, timestamp, question, answer, confidence) -> (key, chat)."""
    rows = F.array_sort(F.collect_list(F.struct("at", "timestamp", "question", "answer", "confidence")))
    entries = F.transform(rows, lambda x, i: X.chat_entry(i + 1, x["timestamp"], x["question"], x["answer"], x["confidence"]))
    return turns.groupBy(key).agg(F.array_join(entries, "\n").alias("chat"))
