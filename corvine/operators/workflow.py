"""Questions to verified answers, for a whole table of questions in each step.

Models are providers: objects with vectorised methods. ``Offline`` is deterministic and needs no network; a provider that
calls a service has the same methods and is passed in its place.
"""

from __future__ import annotations

import json
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.config import DEFAULTS
from corvine.functions import text as X
from corvine.functions import verdicts as V
from corvine.functions.prompts import rendered
from corvine.operators.context import combined, joined_context

#: Answers where nothing is asked of a provider, and why a candidate was taken (fixed values).
UNRELATED = "This question isn't related to the uploaded documents. Please ask another question."
SAYS_NOTHING = "Please enter a question."
NO_ANSWERS = "No answers were generated."
NO_CANDIDATES, ONE_CANDIDATE, SELECTION_FAILED = "No candidates available", "Only one candidate answer was provided", "Selection failed, using first candidate: "


class Offline:
    """Judges by shared words, answers with the sentences that share most, splits questions at question marks."""

    def decompose(self, question: str) -> list[str]:
        parts = [p.strip() + "?" for p in question.split("?") if p.strip()]
        return parts if question.count("?") > 1 else [question]

    def coverage(self, question: str, context: str) -> float:
        asked = set(question.lower().split())
        return len(asked & set(context.lower().split())) / len(asked) if asked else 0.0

    def relevance(self, question: str, context: str) -> str:
        share = self.coverage(question, context)
        return "CAN_ANSWER" if share >= 0.6 else "PARTIAL" if share >= 0.3 else "NO_MATCH"

    def rewrite(self, question: str) -> str:
        return " ".join(w for w in question.split() if w.lower() not in X.STOP_WORDS)

    def answer(self, question: str, context: str, candidate: int, feedback: str = "", previous: str = "") -> str:
        """``feedback`` says what was wrong with ``previous``; both are empty at first. What this provider says follows from the context alone."""
        sentences = [s for s in re.split(r"(?<=[.!?])\s+", context) if s]
        asked = set(question.lower().split())
        best = sorted(range(len(sentences)), key=lambda i: (-len(asked & set(sentences[i].lower().split())), i))[: 2 + candidate]
        return " ".join(sentences[i] for i in sorted(best))

    def select(self, question: str, answers: list[str]) -> dict:
        """index, confidence and reasoning; it is asked only where there is a choice."""
        shares = [self.coverage(question, a) for a in answers]
        best = shares.index(max(shares))
        return {"index": best, "confidence": "HIGH" if shares[best] >= 0.9 else "MEDIUM" if shares[best] >= 0.5 else "LOW", "reasoning": f"It has {round(100 * shares[best])}% of the question's words"}

    def verify(self, question: str, answer: str, context: str) -> str:
        """A report in lines, as a model would write it."""
        share = self.coverage(answer, context)
        supported = "YES" if share >= 0.9 else "PARTIAL" if share >= 0.5 else "NO"
        asked = self.coverage(question, answer)
        complete = "COMPLETE" if asked >= 0.5 else "PARTIAL" if asked >= 0.2 else "INCOMPLETE"
        return f"Supported: {supported}\nConfidence: {'HIGH' if share >= 0.9 else 'LOW'}\nRelevant: {'YES' if asked > 0 else 'NO'}\nCompleteness: {complete}"


class Prompted(Offline):
    """A provider that asks a service: ``complete`` maps a prompt to a text. Where that fails, the offline answer stands.

    A service takes time rather than processors, so some calls run at a time in each task.
    """

    AT_ONCE = 16

    def __init__(self, complete):
        self.complete = complete

    def _asked(self, kind: str, otherwise, **parts: str):
        try:
            return self.complete(rendered(kind, **parts))
        except Exception:  # whatever a service's client raises
            return otherwise

    def decompose(self, question: str) -> list[str]:
        said = self._asked("decompose", "", question=question)
        try:
            found = json.loads(said[said.index("{") : said.rindex("}") + 1])
            parts = [str(x) for x in found["sub_queries"]] if found["is_multi_query"] is True else []
        except (ValueError, KeyError, TypeError):
            parts = []
        return parts or [question]

    def relevance(self, question: str, context: str) -> str:
        said = self._asked("relevance", "", question=question, context=context).upper()
        return next((x for x in V.LABELS[:2] if x in said), V.LABELS[2]) if said else super().relevance(question, context)

    def rewrite(self, question: str) -> str:
        return self._asked("rewrite", question, question=question)

    def answer(self, question: str, context: str, candidate: int, feedback: str = "", previous: str = "") -> str:
        """Where the service fails this fails too, and the candidate is left out."""
        return self.complete(rendered("answer", question=question, context=context, previous=previous, feedback=feedback)).strip()

    def select(self, question: str, answers: list[str]) -> dict:
        said = self.complete(rendered("select", question=question, answers="\n".join(f"{i}: {a}" for i, a in enumerate(answers))))
        try:
            found = json.loads(said[said.index("{") : said.rindex("}") + 1])
            return {"index": int(found["index"]), "confidence": str(found.get("confidence", "MEDIUM")).upper(), "reasoning": str(found.get("reasoning", ""))}
        except (ValueError, KeyError, TypeError):
            number = re.search(r"-?\d+", said)
            return {"index": int(number[0]) if number else 0, "confidence": "MEDIUM", "reasoning": said.strip()}

    def verify(self, question: str, answer: str, context: str) -> str:
        return self._asked("verify", "", question=question, answer=answer, context=context)


def called(provider, method: str, returns: str, *columns: Column, failing=None) -> Column:
    """A provider's method over columns, in Arrow batches; not moved or repeated by the optimiser, as a call may cost money.

    Of a batch, as many rows are asked at a time as the provider's ``AT_ONCE`` says.
    ``failing`` maps an error to a value in its place; without it an error ends the job. A method that returns fields has
    them in ``returns`` and gives a dict.
    """
    from collections.abc import Iterator

    import pandas as pd

    fields, at_once = " " in returns, getattr(provider, "AT_ONCE", 1)

    def one(row: tuple):
        try:
            return getattr(provider, method)(*row)
        except Exception as e:  # whatever a service's client raises
            if failing is None:
                raise
            return failing(e)

    def run(batches):
        for parts in batches:
            parts = parts if isinstance(parts, tuple) else (parts,)
            rows = list(zip(*(p.tolist() for p in parts), strict=True))
            if at_once > 1 and len(rows) > 1:
                with ThreadPoolExecutor(at_once) as pool:
                    said = list(pool.map(one, rows))
            else:
                said = [one(row) for row in rows]
            yield pd.DataFrame(said, columns=[x.split()[0] for x in returns.split(", ")]) if fields else pd.Series(said, dtype=object if returns == "string" else None)

    found = Iterator[pd.DataFrame if fields else pd.Series]
    if len(columns) == 1:
        run.__annotations__ = {"batches": Iterator[pd.Series], "return": found}
    else:
        run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": found}
    return F.pandas_udf(run, returns).asNondeterministic()(*columns)


def decompose(questions: DataFrame, provider) -> DataFrame:
    """(question, text) -> (question, idx, text): its parts, or itself."""
    parts = questions.withColumn("parts", called(provider, "decompose", "array<string>", F.coalesce("text", F.lit(""))))
    return parts.select("question", F.posexplode("parts").alias("idx", "text"))


def relevance(questions: DataFrame, contexts: DataFrame, provider) -> DataFrame:
    """Adds ``classification`` to (question, text)."""
    joined = questions.join(contexts, "question", "left")
    return joined.withColumn("classification", called(provider, "relevance", "string", F.col("text"), F.coalesce("context", F.lit("")))).drop("context")


def better(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per question the classification with the higher rank; the first if both have the same."""
    rows = first.withColumn("turn", F.lit(0)).unionByName(second.withColumn("turn", F.lit(1)))
    key = F.struct(V.label_rank(F.col("classification")), -F.col("turn"))
    return rows.groupBy("question").agg(F.max_by(F.struct("text", "classification"), key).alias("best")).select("question", "best.*")


def chosen(rows: DataFrame, provider) -> DataFrame:
    """Adds ``selected``, ``selection_confidence`` and ``selection_reasoning`` to (text, drafts).

    The provider is asked where there are several drafts. Where it fails, or names none of them, the first is taken.
    """
    several, size = F.size("drafts") > 1, F.size("drafts")
    fields = "index int, confidence string, reasoning string"
    asked = called(provider, "select", fields, F.col("text"), F.col("drafts"), failing=lambda e: {"index": 0, "confidence": "LOW", "reasoning": f"{SELECTION_FAILED}{e}"})
    chosen_of = rows.filter(several).withColumn("choice", asked)
    alone = F.struct(F.lit(0).alias("index"), F.when(size == 1, "MEDIUM").otherwise("LOW").alias("confidence"), F.when(size == 1, ONE_CANDIDATE).otherwise(NO_CANDIDATES).alias("reasoning"))
    every = chosen_of.unionByName(rows.filter(~several).withColumn("choice", alone))
    return every.select(*rows.columns, V.selected_index(F.col("choice.index"), size).alias("selected"), F.col("choice.confidence").alias("selection_confidence"), F.col("choice.reasoning").alias("selection_reasoning"))


def attempt(rows: DataFrame, provider, n_candidates: int, report_of=V.report) -> DataFrame:
    """(question, text, context, feedback, previous) -> answer, report, retry, feedback: candidates, the best of them, its verdict.

    Every candidate is told what was wrong with the answer before; one that fails is left out.
    """
    candidates = rows.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1))))
    told = (F.coalesce("feedback", F.lit("")), F.when(F.col("feedback").isNotNull(), F.col("previous")).otherwise(""))
    candidates = candidates.withColumn("draft", called(provider, "answer", "string", F.col("text"), F.col("context"), F.col("candidate"), *told, failing=lambda e: None))
    said = F.filter(F.array_sort(F.collect_list(F.struct("candidate", "draft"))), lambda x: x["draft"].isNotNull())
    drafts = candidates.groupBy("question").agg(F.transform(said, lambda x: x["draft"]).alias("drafts"))
    picked = chosen(rows.select("question", "text", "context").join(drafts, "question"), provider).withColumn("answer", F.coalesce(F.get("drafts", F.col("selected")), F.lit(NO_ANSWERS)))
    verdict = picked.withColumn("verdict", called(provider, "verify", "string", F.col("text"), F.col("answer"), F.col("context"))).withColumn("verdict", V.structured(F.col("verdict")))
    v = {x: F.col(f"verdict.{x}") for x in ("supported", "confidence", "claims", "contradictions", "relevant", "completeness", "details")}
    feedback = V.feedback(v["supported"], v["confidence"], v["claims"], v["contradictions"], v["completeness"], v["details"])
    report = F.concat(V.report_header(F.size("drafts"), F.col("selected"), F.col("selection_confidence"), F.col("selection_reasoning")), report_of(*v.values()))
    return verdict.withColumn("feedback", feedback).withColumn("report", report).withColumn("retry", V.try_again(v["supported"], v["relevant"], F.col("feedback"))).select("question", "answer", "report", "retry", "feedback")


def answer(questions: DataFrame, retrieve, provider=None, settings=DEFAULTS, save=lambda df, name: df.checkpoint()) -> DataFrame:
    """(question, text) -> (question, answer, report, attempts): a row for every question.

    ``retrieve`` maps (question, text) to (question, rank, content). Each round tries only what failed before, and tells the
    provider why; ``save`` cuts the lineage, by a checkpoint or a written table in a shared folder. A question that says
    nothing has a fixed answer, and nothing is retrieved for it.
    """
    provider = provider or Offline()
    says = F.coalesce(X.said(F.col("text")), F.lit(False))
    silent = questions.filter(~says).select("question", F.lit(SAYS_NOTHING).alias("answer"), F.lit("").alias("report"), F.lit(0).alias("attempts"))
    questions = questions.filter(says)
    found = save(retrieve(questions), "retrieved")
    contexts = joined_context(found, settings.RELEVANCE_CHECK_K, 1 << 30)
    first = save(relevance(questions, contexts, provider), "relevance")
    poor = first.filter("classification <> 'CAN_ANSWER'").select("question", F.col("text").alias("asked"))
    rewritten = poor.select("question", called(provider, "rewrite", "string", F.col("asked")).alias("text"), "asked").filter("text <> asked").drop("asked")
    rewritten = save(rewritten, "rewritten")
    found_again = found.limit(0) if rewritten.isEmpty() else save(retrieve(rewritten), "retrieved-again")
    second = relevance(rewritten, joined_context(found_again, settings.RELEVANCE_CHECK_K, 1 << 30), provider)
    judged = save(better(first.select("question", "text", "classification"), second.select("question", "text", "classification")), "judged")
    # a question whose rewritten form won has its context from the second search
    mine = judged.join(rewritten.select("question", F.col("text").alias("new_text")), "question", "left").select("question", (F.col("text") == F.col("new_text")).alias("again"))
    hits = found.join(mine, "question").filter("again IS NULL OR NOT again").unionByName(found_again.join(mine, "question").filter("again")).select("question", "rank", "content")
    left = judged.filter("classification <> 'NO_MATCH'").join(joined_context(hits, settings.RESEARCH_TOP_K, 1 << 30), "question").select("question", "text", "context")
    done = judged.filter("classification = 'NO_MATCH'").select("question", F.lit(UNRELATED).alias("answer"), F.lit("").alias("report"), F.lit(0).alias("attempts")).unionByName(silent)
    left = save(left.withColumns({"feedback": F.lit(None).cast("string"), "previous": F.lit(None).cast("string")}), "open")
    for n in range(1, settings.MAX_RESEARCH_ATTEMPTS + 1):
        tried = save(attempt(left, provider, settings.NUM_RESEARCH_CANDIDATES + n - 1), f"attempt-{n}")
        ended = tried if n == settings.MAX_RESEARCH_ATTEMPTS else tried.filter("NOT retry")
        done = done.unionByName(ended.select("question", "answer", "report", F.lit(n).alias("attempts")))
        failed = tried.filter("retry").select("question", "feedback", F.col("answer").alias("previous"))
        left = left.drop("feedback", "previous").join(failed, "question")
        if n < settings.MAX_RESEARCH_ATTEMPTS and left.isEmpty():
            break
    return done


def answer_parts(questions: DataFrame, retrieve, provider=None, settings=DEFAULTS, save=lambda df, name: df.checkpoint()) -> DataFrame:
    """As ``answer``, of each part of a question by itself: (question, answer, report, attempts, parts).

    A question of one part has its answer; the answers of several are numbered and joined, with the report of the first.
    Every question has a row, also one that says nothing.
    """
    provider = provider or Offline()
    parts = save(decompose(questions, provider).withColumn("part", F.concat_ws("#", F.col("question").cast("string"), F.col("idx").cast("string"))), "parts")
    asked = parts.select(F.col("part").alias("question"), "text")
    done = answer(asked, retrieve, provider, settings, save).withColumnRenamed("question", "part").join(parts, "part")
    several = combined(done.select(F.col("question").alias("key"), "idx", F.col("text").alias("question"), "answer"), "key").withColumnsRenamed({"key": "question", "answer": "all_answers"})
    first = done.groupBy("question").agg(F.min_by("answer", "idx").alias("answer"), F.min_by("report", "idx").alias("report"), F.max("attempts").alias("attempts"), F.count("*").alias("parts"))
    return first.join(several, "question").select("question", F.when(F.col("parts") > 1, F.col("all_answers")).otherwise(F.col("answer")).alias("answer"), "report", "attempts", "parts")


def batches(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Adds ``batch`` (from 1): runs of ``size`` rows of each key in order."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("batch", (F.floor(at / size) + 1).cast("long"))
