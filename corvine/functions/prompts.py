"""Prompts for providers, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASKS = {
    "decompose": "Does this ask one thing or several? Answer as a JSON object with is_multi_query and sub_queries.",
    "relevance": "Can the context answer the question? Answer CAN_ANSWER, PARTIAL or NO_MATCH.",
    "rewrite": "Put the question so that a search finds more. Keep its meaning.",
    "answer": "Answer from the context alone. Say so where it has no answer.",
    "select": "Choose the answer that the context supports best. Give its number.",
    "combine": "Put the answers to the parts together as one answer.",
    "chart": "Describe the chart: title, type, axes, values and what it shows.",
    "charts": "Describe each chart behind a line of its own, ---CHART and its number---.",
    "verify": "Check the answer against the context. Give Supported, Confidence, Relevant and Completeness, one a line.",
}


def rendered(kind: str, **parts: str) -> str:
    """The same for one request, within a provider."""
    return "\n\n".join([ASKS[kind], *[f"{name.capitalize()}:\n{v}" for name, v in parts.items() if v]])


def prompt(kind: str, **parts: Column) -> Column:
    """The request of a kind and its named parts; a part that is null or empty is left out."""
    shown = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name.capitalize()}:\n"), v)) for name, v in parts.items()]
    return F.array_join(F.array_compact(F.array(F.lit(ASKS[kind]), *shown)), "\n\n")
