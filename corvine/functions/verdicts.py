"""Verdicts on answers: parsing, reports, feedback and the decision to try again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvine.functions.text import json_object

LABELS = ("CAN_ANSWER", "PARTIAL", "NO_MATCH")


def or_none(x: Column) -> Column:
    return F.coalesce(F.when(x != "", x), F.lit("None"))


def parsed(raw: Column) -> Column:
    """(supported, confidence, relevant, completeness) of lines ``key: value``; the last line of a key that says something counts."""
    contains = lambda x, label: F.contains(x, F.lit(label))
    # one greedy pattern a key finds its last line; what it captures is the value
    last = lambda key, says="": F.upper(F.regexp_extract(raw, rf"(?s)^(?:.*\n)?[^\S\n]*(?i:{key})[^\S\n]*:{says}([^\n]*)", 1))
    s, c, r = map(last, ("supported", "confidence", "relevant"))
    m = last("completeness", r"(?=(?iu:[^\n]*PARTIAL|(?![^\n]*INCOMPLETE)[^\n]*COMPLETE))")
    return F.struct(
        F.when(contains(s, "YES"), "YES").when(contains(s, "PARTIAL"), "PARTIAL").otherwise("NO").alias("supported"),
        F.when(contains(c, "HIGH"), "HIGH").when(contains(c, "MEDIUM"), "MEDIUM").otherwise("LOW").alias("confidence"),
        F.when(contains(r, "YES"), "YES").otherwise("NO").alias("relevant"),
        F.when(contains(m, "COMPLETE") & ~contains(m, "INCOMPLETE"), "COMPLETE").when(contains(m, "PARTIAL"), "PARTIAL").otherwise("INCOMPLETE").alias("completeness"),
    )


#: The form of a structured verdict.
VERDICT = "supported string, confidence string, unsupported_claims array<string>, contradictions array<string>, relevant string, completeness string, additional_details string"


def structured(raw: Column) -> Column:
    """A verdict from a model's JSON object, or from its lines where it is no such object; all seven fields, never null.

    An object counts if its labels are those that are allowed; a confidence or completeness that it leaves out has a default.
    """
    j = F.from_json(json_object(raw), VERDICT)
    confidence, completeness = F.coalesce(j["confidence"], F.lit("MEDIUM")), F.coalesce(j["completeness"], F.lit("PARTIAL"))
    ok = j["supported"].isin("YES", "NO", "PARTIAL") & confidence.isin("HIGH", "MEDIUM", "LOW") & j["relevant"].isin("YES", "NO") & completeness.isin("COMPLETE", "PARTIAL", "INCOMPLETE")
    p, none = parsed(raw), F.array().cast("array<string>")
    of = lambda a, b: F.when(ok, a).otherwise(b)
    return F.struct(
        of(j["supported"], p["supported"]).alias("supported"), of(confidence, p["confidence"]).alias("confidence"), of(F.coalesce(j["unsupported_claims"], none), none).alias("claims"),
        of(F.coalesce(j["contradictions"], none), none).alias("contradictions"), of(j["relevant"], p["relevant"]).alias("relevant"), of(completeness, p["completeness"]).alias("completeness"),
        of(F.coalesce(j["additional_details"], F.lit("")), F.lit("")).alias("details"),
    )


def report(supported: Column, confidence: Column, claims: Column, contradictions: Column, relevant: Column, completeness: Column, details: Column) -> Column:
    parts = (
        ("Supported", supported), ("Confidence", confidence), ("Unsupported Claims", or_none(F.array_join(claims, ", "))), ("Contradictions", or_none(F.array_join(contradictions, ", "))),
        ("Relevant", relevant), ("Completeness", completeness), ("Additional Details", or_none(details)),
    )
    return F.concat(*[x for name, value in parts for x in (F.lit(f"**{name}:** "), value, F.lit("\n"))])


def report_header(candidates: Column, selected: Column, confidence: Column, reasoning: Column) -> Column:
    return F.concat(F.lit("**Candidates Evaluated:** "), candidates.cast("string"), F.lit("\n**Selected Candidate:** "), (selected + 1).cast("string"), F.lit("\n**Selection Confidence:** "), F.coalesce(confidence, F.lit("N/A")), F.lit("\n**Selection Reasoning:** "), reasoning, F.lit("\n\n"))


def feedback(supported: Column, confidence: Column, claims: Column, contradictions: Column, completeness: Column, details: Column) -> Column:
    """What the next attempt should mind, or null."""
    some = lambda label, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(xs, 1, 3), "; ")))
    parts = F.array_compact(F.array(
        F.when(supported == "NO", "Answer lacks sufficient support from documents.").when(supported == "PARTIAL", "Some parts are not well supported."),
        some("Unsupported", claims),
        some("Contradictions", contradictions),
        F.when(completeness == "INCOMPLETE", "Answer is incomplete."),
        F.when(confidence == "LOW", "Focus on directly verifiable claims."),
        F.when(details != "", F.concat(F.lit("Additional Details: "), details)),
    ))
    return F.when(F.size(parts) > 0, F.array_join(parts, " | "))


def try_again(supported: Column, relevant: Column, feedback_text: Column) -> Column:
    """The effective decision: every other clause of the rule puts one of these words into the feedback."""
    lower = F.lower(F.coalesce(feedback_text, F.lit("")))
    return (supported == "NO") | (relevant == "NO") | F.contains(lower, F.lit("contradiction")) | F.contains(lower, F.lit("unsupported"))


def label_in(text: Column) -> Column:
    """The first label, in a fixed order, that a free text mentions."""
    upper = F.upper(text)
    return F.when(F.contains(upper, F.lit(LABELS[0])), LABELS[0]).when(F.contains(upper, F.lit(LABELS[1])), LABELS[1]).otherwise(LABELS[2])


def label_rank(label: Column) -> Column:
    return F.when(label == LABELS[0], 2).when(label == LABELS[1], 1).otherwise(0)


def selected_index(index: Column, size: Column) -> Column:
    """No candidate: -1; an index out of range: 0."""
    return F.when(size == 0, -1).when((index >= 0) & (index < size), index).otherwise(0)
