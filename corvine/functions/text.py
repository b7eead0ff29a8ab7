"""Text expressions: cleaning, rendering, scanning and estimates.

The headings, labels and the sentence for an analysis that is missing, in what is rendered here, are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are not highlighted (fixed values).
STOP_WORDS = "the a an is are was were in on at to for of and or what how why when where which".split()


def strip(x: Column) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def said(x: Column) -> Column:
    """Whether a text says anything: neither null nor white space alone."""
    return F.coalesce(F.regexp_like(x, F.lit(r"\S")), F.lit(False))


def words(x: Column) -> Column:
    """The pieces between ASCII white space, empty ones dropped."""
    return F.array_remove(F.split(x, r"[\x20\x09-\x0D]+"), "")


def latin1(x: Column) -> Column:
    """Characters that Latin-1 lacks become question marks."""
    return F.regexp_replace(x, r"[^\x{00}-\x{ff}]", "?")


def truncated(x: Column, n: int = 500) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def tokens(chars: Column, per_token: int = 4) -> Column:
    return F.floor(chars / per_token).cast("long")


def percent(x: Column) -> Column:
    """A share as whole percent, halves to even."""
    return F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("%"))


def key_terms(question: Column, n: int = 5) -> Column:
    """The first ``n`` words of a question that are worth highlighting, lower-cased."""
    lower = F.transform(words(question), F.lower)
    return F.slice(F.filter(lower, lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 2)), 1, n)


def highlighted(text: Column, terms: Column) -> Column:
    """Each term in turn put between double asterisks, whatever its case in the text."""
    literal = lambda t: F.concat(F.lit(r"(?iu)\Q"), t, F.lit(r"\E"))
    plain = lambda t: F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.aggregate(terms, text, lambda a, t: F.regexp_replace(a, literal(t), F.concat(F.lit("**"), plain(t), F.lit("**"))))


def title(content: Column) -> Column:
    """What stands behind a bold Title label; null if nothing does."""
    found = F.regexp_extract(content, r"\*\*Title\*\*:\s*(.+)", 1)
    return F.when(strip(found) != "", strip(found))


def response_part(response: Column, index: Column) -> Column:
    """The analysis of the ``index``-th chart (from 0) in a batched response."""
    part = F.try_element_at(F.split(response, "---CHART "), index.cast("int") + 2)
    lines = F.split(part, "\n")
    kept = F.when(F.contains(lines[0], F.lit("---")), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")).otherwise(part)
    return F.coalesce(strip(kept), F.lit("Analysis unavailable (parsing error)"))


def json_object(raw: Column) -> Column:
    """From the first opening to the last closing brace; empty if there is no such part."""
    return F.regexp_extract(raw, r"(?s)(\{.*\})", 1)


def decomposed(raw: Column, question: Column) -> Column:
    """(is_multi, sub_queries) from a model's answer; anything that is no such JSON object is a single question."""
    parsed = F.from_json(json_object(raw), "is_multi_query boolean, sub_queries array<string>")
    several = F.coalesce(parsed["is_multi_query"], F.lit(False)) & (F.coalesce(F.size(parsed["sub_queries"]), F.lit(0)) > 0)
    return F.struct(several.alias("is_multi"), F.when(several, parsed["sub_queries"]).otherwise(F.array(question)).alias("sub_queries"))


def chat_entry(i: Column, timestamp: Column, question: Column, answer: Column, confidence: Column) -> Column:
    """One entry of a rendered chat; absent parts are empty, an absent confidence is N/A."""
    part = lambda x: F.coalesce(x, F.lit(""))
    return F.concat(
        F.lit("\n---\n### 💬 Q"), i.cast("string"), F.lit(" ("), part(timestamp), F.lit(")\n**Question:** "), part(question),
        F.lit("\n\n**Answer:** "), part(answer), F.lit("\n\n*Confidence: "), F.coalesce(confidence, F.lit("N/A")), F.lit("*\n"),
    )


def context_entry(i: Column, source: Column, content: Column) -> Column:
    """One folded chunk of a rendered context."""
    return F.concat(F.lit("\n<details>\n<summary>📄 Chunk "), i.cast("string"), F.lit(" - "), F.element_at(F.split(source, "/"), -1), F.lit("</summary>\n\n"), content, F.lit("\n\n</details>\n"))
