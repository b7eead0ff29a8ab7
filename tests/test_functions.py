"""Expressions and operators on hand-made rows, against plain Python."""

from __future__ import annotations

import datetime
import hashlib
import io
import itertools
import math
import random
import zipfile
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine.config import Settings, usable_key
from corvine.functions import charts, identity, tables, text, verdicts
from corvine.operators import bm25, context, fusion, manifest, splitter, vector, workflow
from corvine.sources import files
from corvine.streaming import rate_limit


def one(spark, **columns):
    """A row of Python values as columns."""
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in columns.items()])


def value(frame, column):
    return frame.select(column.alias("v")).first()["v"]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def test_identity(spark):
    row = one(spark, path="a/b/c.PDF", body="hello")
    assert value(row, identity.stable_source(F.col("path"), F.lit("h"))) == "c.PDF::h"
    assert value(row, identity.extension(F.col("path"))) == ".pdf" and value(row, identity.extension(F.lit("none"))) == ""
    got = value(row, identity.doc_key(F.lit("s"), F.lit(None).cast("int"), F.lit("c"), F.col("body")))
    assert got == sha(f"s::::c::{sha('hello')[:16]}")


def test_set_hash_depends_on_order_only(spark):
    rows = [(i, sha(str(i))) for i in (5, 1, 2400, 17)]
    of = lambda r: identity.set_hash(spark.createDataFrame(r, "i long, h string"), "i", "h").first()[0]
    assert of(rows) == of(rows[::-1]) != of([(i, h) for i, (_, h) in enumerate(rows)])


@pytest.mark.parametrize(("size", "overlap"), [(20, 5), (50, 0), (7, 3)])
def test_splitter(spark, size, overlap):
    r = random.Random(size)
    for _ in range(60):
        t = "".join(r.choice(["word ", "a", "\n", "\n\n", "longerword", " ", "é"]) for _ in range(r.randint(1, 60)))
        got = list(splitter.split(t, size, overlap))
        assert all(c and len(c) <= size and c == c.strip() and c in t for c in got)
        left = 0
        for c in got:
            left = t.index(c, max(0, left - overlap - size))
        assert set("".join(got)) >= set(t) - set(" \n")
    table = spark.createDataFrame([(1, "x " * 30), (2, None), (3, ""), (4, "   ")], "doc_id long, text string")
    assert {r.doc_id for r in splitter.chunks(table, size=size, overlap=overlap).collect()} == {1}


def test_text(spark):
    row = one(spark, t="Costs $5 (a\\b) $5", q="What is the $5 of (a\\b) and costs?")
    assert value(row, text.key_terms(F.col("q"))) == ["(a\\b)", "costs?"]
    assert value(row, text.highlighted(F.col("t"), F.array(F.lit("$5"), F.lit("(a\\b)"), F.lit("costs")))) == "**costs** **$5** **(a\\b)** **$5**"
    assert [value(row, text.percent(F.lit(x))) for x in (0.005, 0.015, 0.5, 1.0)] == ["0%", "2%", "50%", "100%"]
    assert value(row, text.latin1(F.lit("é日🙂"))) == "é??" and value(row, text.strip(F.lit("\n a \t"))) == "a"
    assert value(row, text.truncated(F.lit("abcdef"), 3)) == "abc..." and value(row, text.truncated(F.lit("abc"), 3)) == "abc"
    assert value(row, text.title(F.lit("**Title**: \n Sales \n x"))) == "Sales" and value(row, text.title(F.lit("no"))) is None
    response = "intro---CHART 1---\n one \n---CHART 2\ntwo"
    assert [value(row, text.response_part(F.lit(response), F.lit(i))) for i in range(3)] == ["one", "2\ntwo", "Analysis unavailable (parsing error)"]


@pytest.mark.parametrize(("raw", "want"), [('x {"is_multi_query": true, "sub_queries": ["a", "b"]} y', (True, ["a", "b"])), ('{"is_multi_query": true, "sub_queries": []}', (False, ["q"])), ("{broken", (False, ["q"])), ("", (False, ["q"]))])
def test_decomposed(spark, raw, want):
    assert tuple(value(one(spark, r=raw), text.decomposed(F.col("r"), F.lit("q")))) == want


def test_markdown(spark):
    schema = "t array<array<string>>"
    cases = [[["a", None], ["b|c\n", "d", "e"], ["", None], []], [["", " "]], [], None, [["x"]]]
    got = [r.m for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, {schema}").select("i", tables.markdown(F.col("t"), F.lit(3), F.lit(2)).alias("m")).orderBy("i").collect()]
    assert got == ["### Table 3 (Page 2)\n| a |  |  |\n| --- | --- | --- |\n| b\\|c | d | e |", "", "", "", "### Table 3 (Page 2)\n| x |\n| --- |"]


def chart(**f):
    """The same rules step by step."""
    axis = f["horizontal"] >= 1 or f["vertical"] >= 1
    if f["text_region"] and f["circles"] < 2 and f["diag"] < 2 and not f["bar_pattern"] and (f["small_scattered"] > 100 or f["very_short"] > 50):
        return False, 0.0, []
    if f["very_short"] > 50 and f["circles"] < 2 and f["diag"] < 3 and f["lines"] < 10:
        return False, 0.0, []
    if f["horizontal"] > 12 and f["vertical"] > 12 and f["circles"] == 0 and f["diag"] < 2 and (f["horizontal"] + f["vertical"]) / max(f["lines"], 1) > 0.75:
        return False, 0.0, []
    found, c = [], 0.0
    line = (f["diag"] >= 2 and f["angle_var"] > 40) or (f["diag"] >= 1 and axis)
    if line:
        found.append("line_chart")
        c = min(0.88, 0.6 + f["diag"] / 40)
        c = min(0.95, c + 0.08) if axis else c
    if f["circles"] >= 5:
        found.append("bubble_chart")
        c = min(0.92, 0.7 + min(f["circles"], 20) * 0.01)
        c = min(0.95, c + 0.1) if f["color_peaks"] > 5 else c
        if f["large"] > 2:
            c, _ = min(0.97, c + 0.05), found.append("zone_diagram")
    elif f["circles"] >= 3 and f["diag"] > 2:
        c, _ = max(c, 0.75), found.append("scatter_plot")
    if 0 < f["circles"] < 5:
        c, _ = max(c, 0.8), found.append("pie_chart")
    if f["bar_pattern"] and f["rects"] >= 6:
        c, _ = max(c, 0.75 + min(f["rects"], 12) / 40), found.append("bar_chart")
    if f["circles"] >= 3 and f["large"] >= 2 and f["color_peaks"] > 5:
        c, _ = max(c, 0.85), found.append("complex_visualization")
    if (1 <= f["horizontal"] <= 6 or 1 <= f["vertical"] <= 6) and (f["circles"] >= 3 or f["diag"] >= 2 or f["bar_pattern"]) and c > 0.3:
        c = min(0.9, c + 0.1)
    strong = line or f["circles"] >= 5 or (f["circles"] >= 3 and (f["large"] >= 2 or f["color_peaks"] > 5)) or f["bar_pattern"]
    return bool(found and c > 0.4 and strong), c, sorted(found)


def test_chart_rules_at_thresholds(spark):
    values = dict(lines=(9, 10, 40), diag=(0, 1, 2, 3), circles=(0, 1, 2, 3, 5, 20), rects=(5, 6, 12), horizontal=(0, 1, 7, 13), vertical=(0, 6, 13), angle_var=(40.0, 41.0), bar_pattern=(False, True), large=(1, 2, 3), color_peaks=(5, 6), text_region=(False, True), very_short=(50, 51), small_scattered=(100, 101))
    r = random.Random(1)
    cases = [{k: r.choice(v) for k, v in values.items()} for _ in range(1500)]
    schema = ", ".join(f"{k} {'boolean' if isinstance(v[0], bool) else 'double' if isinstance(v[0], float) else 'int'}" for k, v in values.items())
    got = spark.createDataFrame([(i, *c.values()) for i, c in enumerate(cases)], f"i int, {schema}").select("i", charts.verdict().alias("v")).orderBy("i").collect()
    for c, row in zip(cases, got, strict=True):
        has, confidence, types = chart(**c)
        assert (row.v.has_chart, row.v.chart_types) == (has, types) and math.isclose(row.v.confidence, confidence, abs_tol=1e-12), c


def test_verdicts(spark):
    grid = list(itertools.product(("YES", "NO", "PARTIAL"), ("HIGH", "MEDIUM", "LOW"), ("YES", "NO"), ("COMPLETE", "PARTIAL", "INCOMPLETE"), ([], ["c1", "c2", "c3", "c4"]), ([], ["k"]), ("", "more", "is unsupported")))
    schema = "i int, s string, c string, r string, m string, claims array<string>, against array<string>, d string"
    table = spark.createDataFrame([(i, *g) for i, g in enumerate(grid)], schema)
    told = verdicts.feedback(F.col("s"), F.col("c"), F.col("claims"), F.col("against"), F.col("m"), F.col("d"))
    rows = table.select("*", told.alias("told"), verdicts.try_again(F.col("s"), F.col("r"), told).alias("again")).orderBy("i").collect()
    for r in rows:
        parts = [{"NO": "Answer lacks sufficient support from documents.", "PARTIAL": "Some parts are not well supported."}.get(r.s), "Unsupported: " + "; ".join(r.claims[:3]) if r.claims else None, "Contradictions: k" if r.against else None]
        parts += ["Answer is incomplete." if r.m == "INCOMPLETE" else None, "Focus on directly verifiable claims." if r.c == "LOW" else None, f"Additional Details: {r.d}" if r.d else None]
        assert r.told == (" | ".join(p for p in parts if p) or None)
        every = r.s == "NO" or r.r == "NO" or (r.c == "LOW" and (r.claims or r.against)) or (r.s == "PARTIAL" and r.against) or r.claims or r.against or "unsupported" in r.d
        assert r.again == bool(every)


@pytest.mark.parametrize(("raw", "want"), [("Supported: yes\nsupported: Partial", ("PARTIAL", "LOW", "NO", "INCOMPLETE")), ("Completeness: COMPLETE\nCompleteness: unclear\nRelevant: YES", ("NO", "LOW", "YES", "COMPLETE")), ("Completeness: incomplete\nConfidence: medium: high", ("NO", "HIGH", "NO", "INCOMPLETE")), ("**Supported:** YES", ("NO", "LOW", "NO", "INCOMPLETE")), ("", ("NO", "LOW", "NO", "INCOMPLETE"))])
def test_parsed(spark, raw, want):
    assert tuple(value(one(spark, r=raw), verdicts.parsed(F.col("r")))) == want


def test_selection_and_labels(spark):
    row = one(spark, x=1)
    assert [value(row, verdicts.selected_index(F.lit(i), F.lit(n))) for i, n in ((0, 0), (1, 2), (2, 2), (-1, 3))] == [-1, 1, 0, 0]
    assert [value(row, verdicts.label_in(F.lit(t))) for t in ("can_answer or partial", "it is Partial", "none", "no_match")] == ["CAN_ANSWER", "PARTIAL", "NO_MATCH", "NO_MATCH"]


def test_bm25_fills_up(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "red", None, "", "blue fox fox", "green"] + ["filler"] * 20)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "fox fox unknown"), (2, ""), (3, None)], "question long, text string")
    got = bm25.top_documents(asked, docs, k=8).collect()
    assert {q: [r.doc for r in sorted(got, key=lambda r: r.rank) if r.question == q] for q in (1, 2, 3)} == {1: [4, 0, 1, 2, 3, 5, 6, 7], 2: list(range(8)), 3: list(range(8))}


def test_vectors(spark):
    r = np.random.default_rng(1)
    points = r.standard_normal((60, 8))
    points[7] = points[3]
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(99, None)], "id long, embedding array<double>")
    queries = vectors.filter("id % 10 = 0").withColumnRenamed("id", "query")
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    found = vector.nearest(queries, vectors, k=12, query_block=2, vector_block=9)
    got: dict = {}
    for x in sorted(found.collect(), key=lambda x: x.rank):
        got.setdefault(x["query"], []).append(x.id)
    for q, ids in got.items():
        similar = np.round(unit @ unit[q], 9)
        assert ids == sorted(range(60), key=lambda i: (-similar[i], i))[:12]
    ranked: dict = {}
    for x in sorted(vector.diverse(found, queries, vectors, k=5).collect(), key=lambda x: x.rank):
        ranked.setdefault(x["query"], []).append(x.id)
    for q, ids in ranked.items():
        taken: list = []
        for _ in range(5):
            score = lambda i, q=q, taken=taken: 0.7 * unit[i] @ unit[q] - 0.3 * max((unit[i] @ unit[j] for j in taken), default=0) if taken else unit[i] @ unit[q]
            taken.append(max((i for i in got[q] if i not in taken), key=lambda i: (round(score(i), 9), -got[q].index(i))))
        assert ids == taken


def test_fusion(spark):
    lists = [(1, 0, 1, 0.4, 10), (1, 0, 2, 0.4, 11), (1, 1, 1, 0.6, 11), (1, 1, 2, 0.6, 12), (1, 0, 3, 0.4, 10), (2, 1, 1, 0.4, 5), (2, 0, 1, 0.4, 6)]
    got = fusion.fuse(spark.createDataFrame(lists, "query int, retriever int, rank int, weight double, id int"), k=2).orderBy("query", "rank").collect()
    assert [(r["query"], r.id) for r in got] == [(1, 11), (1, 10), (2, 6), (2, 5)]
    assert math.isclose(got[1].score, round(0.4 / 61 + 0.4 / 63, 9))


def test_manifest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c")], "doc_id long, content_hash string")
    known = spark.createDataFrame([(1, "a"), (2, "old")], "doc_id long, content_hash string")
    assert {r.doc_id for r in manifest.new_rows(docs, known, "doc_id").collect()} == {3}
    assert [r.doc_id for r in manifest.changed_rows(docs, known, "doc_id").collect()] == [2]
    path = str(tmp_path / "m")
    for _ in range(2):
        manifest.append(docs, path, "doc_id")
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    lines = manifest.to_json(known, "doc_id").unionByName(spark.createDataFrame([("{broken",), ("[]",)], "value string"))
    assert {tuple(r) for r in manifest.from_json(lines).collect()} == {("1", "a"), ("2", "old")}


def test_context(spark):
    ranked = spark.createDataFrame([(1, "the fox", i, f"d/{i}.txt", "Fox " + "x" * (600 if i == 2 else 3)) for i in range(1, 8)], "question int, text string, rank int, source string, content string")
    got = context.rendered_context(ranked).first().context
    assert got.count("<details>") == 5 and "2.txt" in got and "..." in got and got.endswith("*... and 2 more chunks*") and "**fox** xxx" in got
    subs = spark.createDataFrame([(1, 7, "b", "B"), (1, 2, "a", "A")], "k int, idx int, question string, answer string")
    assert context.combined(subs, "k").first().answer == "Q1: a\nA: A\n\nQ2: b\nA: B"


def test_rate_limit(spark):
    r = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    calls = [(r.choice([1, 1, 1, 2, None]), start + datetime.timedelta(seconds=r.randint(0, 5) * 1800), i) for i in range(200)]
    got = {x.id: x.admitted for x in rate_limit.limited(spark.createDataFrame(calls, "key long, at timestamp, id long")).collect()}
    log: dict = {}
    for k, at, i in sorted((c for c in calls if c[0] is not None), key=lambda c: (c[0], c[1], c[2])):
        q = log.setdefault(k, deque())
        while q and (at - q[0]).total_seconds() > 3600:
            q.popleft()
        assert got[i] == (len(q) < 5)
        if got[i]:
            q.append(at)
    assert not any(got[i] for k, _, i in calls if k is None)


def test_rate_limit_stream_is_the_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    calls = spark.createDataFrame([(i % 3, start + datetime.timedelta(minutes=7 * i), i) for i in range(90)], "key long, at timestamp, id long")
    calls.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    run = rate_limit.limited_stream(stream).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.table("limited").collect()} == {tuple(r) for r in rate_limit.limited(calls).collect()}


def test_index_stream(spark, tmp_path):
    from corvine.streaming.incremental import index_stream

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "doc_id long, content_hash string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    for n in range(2):
        index_stream(stream, str(tmp_path / "m"), str(tmp_path / f"c{n}")).awaitTermination(120)
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [1, 2]


def test_files(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.TXT").write_text("plain é")
    (folder / "b.md").write_text("# head")
    (folder / "c.exe").write_text("no")
    (folder / "bad.docx").write_text("no zip")
    with zipfile.ZipFile(io.FileIO(folder / "d.docx", "w"), "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:document>')
    found = files.files(spark, str(folder))
    assert {r.content for r in files.documents(found).collect()} == {"plain é", "# head", "one\ntwo"}
    limits = spark.createDataFrame([(50 * 1024 * 1024 + d,) for d in (-1, 0, 1)], "length long").select(files.size_ok(F.col("length")).alias("ok"))
    assert [r.ok for r in limits.collect()] == [True, True, False]
    chunks = spark.createDataFrame([("h1", "x", datetime.datetime(2024, 1, 1)), ("h2", "y", datetime.datetime(2024, 1, 9))], "file_hash string, content string, cached_at timestamp")
    files.write_cache(chunks, str(tmp_path / "cache"))
    now = F.lit(datetime.datetime(2024, 1, 9)).cast("timestamp")
    assert [r.content for r in files.read_cache(spark, str(tmp_path / "cache"), now).collect()] == ["y"]


def test_settings(monkeypatch):
    monkeypatch.setenv("CHUNK_SIZE", "500")
    assert Settings.load().CHUNK_SIZE == 500
    monkeypatch.setenv("CHUNK_OVERLAP", "900")
    with pytest.raises(ValueError):
        Settings.load()
    assert usable_key("abc") and usable_key("your-key") and not usable_key(" ") and not usable_key("your_key") and not usable_key("YOUR_API_KEY_HERE")


def test_workflow(spark):
    # a class of this function: workers get it by value
    class Stubborn(workflow.Offline):
        def verify(self, question, answer, context):
            return "Supported: NO" if "hard" in question else "Supported: YES\nRelevant: YES\nCompleteness: COMPLETE\nConfidence: HIGH"

    asked = spark.createDataFrame([(1, "where is the red fox"), (2, "hard question of the red fox"), (3, "zzz qqq vvv")], "question long, text string")
    corpus = spark.createDataFrame([(i, f"The red fox is in house {i}. It was a hard question.") for i in range(5)], "doc_id long, text string")

    def retrieve(questions):
        return bm25.top_documents(questions, corpus).join(corpus.select(F.col("doc_id").alias("doc"), F.col("text").alias("content")), "doc").select("question", "rank", "content")

    got = {r.question: r for r in workflow.answer(asked, retrieve, Stubborn()).collect()}
    assert got[1].attempts == 1 and "fox" in got[1].answer and "**Candidates Evaluated:** 2" in got[1].report
    assert got[2].attempts == 5 and got[3].attempts == 0 and got[3].answer == workflow.UNRELATED
    parts = workflow.decompose(spark.createDataFrame([(1, "one? two?"), (2, "just one")], "question long, text string"), workflow.Offline()).collect()
    assert sorted((r.question, r.idx, r.text) for r in parts) == [(1, 0, "one?"), (1, 1, "two?"), (2, 0, "just one")]




def test_workflow_learns_from_feedback(spark):
    """A provider that answers well only when it is told what was wrong; candidates and selections that fail; nulls."""

    class Learning(workflow.Offline):
        def answer(self, question, context, candidate, feedback="", previous=""):
            if "fails" in question or ("half" in question and candidate == 0):
                raise OSError("no answer")
            return f"good: {feedback} / {previous}" if feedback else f"bad {candidate}"

        def select(self, question, answers):
            if "odd" in question:
                raise OSError("no choice")
            return {"index": 9 if "range" in question else 1, "confidence": "HIGH", "reasoning": "it is second"}

        def relevance(self, question, context):
            return "CAN_ANSWER"

        def verify(self, question, answer, context):
            return "Supported: YES\nRelevant: YES\nCompleteness: COMPLETE\nConfidence: HIGH" if answer.startswith("good") else "Supported: NO\nRelevant: YES\nConfidence: HIGH\nCompleteness: COMPLETE"

    asked = spark.createDataFrame([(1, "plain"), (2, "odd"), (3, "fails"), (4, "half"), (5, None), (6, " \n"), (7, "range")], "question long, text string")
    corpus = spark.createDataFrame([("the context",)], "content string")
    retrieve = lambda questions: questions.crossJoin(corpus).select("question", F.lit(1).alias("rank"), "content")
    got = {r.question: r for r in workflow.answer(asked, retrieve, Learning()).collect()}
    why = "Answer lacks sufficient support from documents."
    assert got[1].answer == f"good: {why} / bad 1" and got[1].attempts == 2
    assert "**Selected Candidate:** 2\n**Selection Confidence:** HIGH\n**Selection Reasoning:** it is second\n" in got[1].report
    assert got[2].answer == f"good: {why} / bad 0" and "**Selection Confidence:** LOW\n**Selection Reasoning:** Selection failed, using first candidate: no choice" in got[2].report
    assert got[3].answer == workflow.NO_ANSWERS and got[3].attempts == 5 and "**Candidates Evaluated:** 0\n**Selected Candidate:** 0\n**Selection Confidence:** LOW\n**Selection Reasoning:** No candidates available" in got[3].report
    assert got[4].answer == f"good: {why} / bad 1" and got[7].answer == f"good: {why} / bad 0"
    assert got[5].answer == got[6].answer == workflow.SAYS_NOTHING and got[5].attempts == 0
    first = workflow.attempt(asked.filter("question = 4").selectExpr("question", "text", "'c' AS context", "CAST(null AS string) AS feedback", "CAST(null AS string) AS previous"), Learning(), 2).first()
    assert first.answer == "bad 1" and "**Selection Confidence:** MEDIUM\n**Selection Reasoning:** Only one candidate answer was provided" in first.report


def test_numbered(spark):
    from corvine.operators.numbering import numbered

    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.choice([r.randint(0, 50), r.randint(0, 1 << 62), None]), i) for i in range(300)]
    table = spark.createDataFrame(rows, "k string, o long, i long")
    for parts in (1, 7, 65_536):
        got = {x.i: x.at for x in numbered(table, "k", "o", ("i",), parts=parts).collect()}
        for k in ("a", "b", None):
            mine = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
            assert [got[x[2]] for x in mine] == list(range(len(mine)))
    whole = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
    assert [x.i for x in sorted(numbered(table, None, "o", ("i",)).collect(), key=lambda x: x.at)] == [x[2] for x in whole]
    assert numbered(table.limit(0), "k", "o").count() == 0


def test_set_hash_is_a_tree(spark):
    rows = [(i * 977, sha(str(i))) for i in range(25)]
    level = [h for _, h in rows]
    while len(level) > 1:
        level = [sha("".join(level[i : i + 4])) for i in range(0, len(level), 4)]
    assert identity.set_hash(spark.createDataFrame(rows, "i long, h string"), "i", "h", fan=4).first()[0] == level[0]


def brute_split(text, size, overlap):
    """Recursive splitting as its rule says, on lists of pieces and with no running sums."""

    def merge(pieces):
        window = []
        for p in pieces:
            if window and sum(map(len, window)) + len(p) > size:
                yield "".join(window).strip()
                while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(p) > size):
                    window = window[1:]
            window = [*window, p]
        yield "".join(window).strip()

    def cut(t, seps):
        while seps[0] and seps[0] not in t:
            seps = seps[1:]
        sep, rest = seps[0], seps[1:]
        parts = list(t) if not sep else [x for x in [t.split(sep)[0], *(sep + x for x in t.split(sep)[1:])] if x]
        short = []
        for p in parts:
            if len(p) < size:
                short.append(p)
            else:
                yield from merge(short)
                short = []
                yield from cut(p, rest) if rest else [p]
        yield from merge(short)

    return [c for c in cut(text, ("\n\n", "\n", " ", "")) if c]


def test_chunk_queries_against_brute_force(spark, tmp_path):
    from corvine.plans.queries import QUERIES

    r = random.Random(6)
    texts = [None, "", "  \n ", "x" * 4500, "\n\n".join("word " * r.randint(1, 700) for _ in range(4))] + ["".join(r.choice(["some words here ", "\n", "\n\n", "é" * 50, "longer" * 40]) for _ in range(r.randint(1, 200))) for _ in range(12)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {(i, j): c for i, t in enumerate(texts) for j, c in enumerate(brute_split(t, 2000, 100) if t else [])}
    got = {(x.doc_id, x.seq): (x.n_chars, x.content_hash) for x in QUERIES["chunk_documents"](spark, str(tmp_path)).collect()}
    assert got == {k: (len(c), sha(c)) for k, c in want.items()}
    stats = QUERIES["chunk_stats"](spark, str(tmp_path)).first()
    assert (stats.n_chunks, stats.longest, stats.n_chars, stats.n_docs) == (len(want), max(map(len, want.values())), sum(map(len, want.values())), len({i for i, _ in want}))


def test_manifest_replaced_at_once(spark, tmp_path):
    path = str(tmp_path / "manifest")
    assert manifest.current(spark, path) is None
    for n in (3, 5):
        manifest.replace(spark.range(n).withColumnRenamed("id", "doc_id"), path)
        assert manifest.current(spark, path).count() == n
    (tmp_path / "manifest" / "_CURRENT").write_text("version-lost")
    assert manifest.current(spark, path) is None


def test_store(spark, tmp_path):
    from corvine.operators import store

    path, schema = str(tmp_path / "store"), "doc_id long, content string, embedding array<float>"
    assert store.opened(spark, path, schema).count() == 0

    class Sizes:
        def embed_all(self, texts):
            assert len(texts) <= store.BATCH
            return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, "x" * i) for i in range(250)] + [(3, "again")], "doc_id long, content string").repartition(2)
    vectors = store.embedded(rows.dropDuplicates(["doc_id"]), Sizes()).select("doc_id", "content", "embedding")
    store.append(vectors.filter("doc_id < 100"), path)
    store.append(vectors, path)
    store.append(vectors, path)
    got = store.opened(spark, path, schema)
    assert got.count() == 250 and {x.embedding[0] for x in got.filter("doc_id > 240").collect()} == {float(i) for i in range(241, 250)}
    assert store.without(got, spark.range(10).withColumnRenamed("id", "doc_id")).count() == 240


def test_chunks_have_metadata(spark):
    docs = spark.createDataFrame([("f.txt::h", 1, "text", "h", "word " * 900), ("g.md::i", 1, "text", "i", "short"), ("e.md::j", 1, "text", "j", " ")], "source string, page int, type string, file_hash string, content string")
    got = files.chunked(docs).orderBy("chunk_id").collect()
    assert [x.chunk_id for x in got] == ["txt_h_1_0", "txt_h_1_1", "txt_h_1_2", "txt_i_1_0"]
    assert got[3].doc_id == sha(f"g.md::i::1::txt_i_1_0::{sha('short')[:16]}") and {x.type for x in got} == {"text"}


def test_cache_that_is_not_there(spark, tmp_path):
    assert files.read_cache(spark, str(tmp_path / "none"), F.current_timestamp()).count() == 0


def test_metadata(spark):
    row = spark.createDataFrame([({"b": "2", "a": "1", "c": None}, "text")], "m map<string,string>, t string")
    assert value(row, identity.document_digest(F.col("t"), F.col("m"))) == sha("texta1b2c")
    assert value(row, identity.meta(F.col("m"), "b")) == "2" and value(row, identity.meta(F.col("m"), "c")) == "" and value(row, identity.meta(F.col("m"), "z", "?")) == "?"


def test_prompted_provider():
    seen = []

    def complete(prompt):
        seen.append(prompt)
        if "several" in prompt:
            return 'Well: {"is_multi_query": true, "sub_queries": ["one", "two"]}'
        if "search finds" in prompt:
            raise OSError
        return "I think 1, so CAN_ANSWER"

    p = workflow.Prompted(complete)
    assert p.decompose("q") == ["one", "two"] and p.relevance("q", "c") == "CAN_ANSWER" and p.rewrite("q") == "q"
    assert p.select("q", ["a", "b"]) == {"index": 1, "confidence": "MEDIUM", "reasoning": "I think 1, so CAN_ANSWER"}
    assert workflow.Prompted(lambda _: 'So: {"selected_index": 2, "index": 1, "confidence": "high", "reasoning": "r"}').select("q", ["a", "b"]) == {"index": 1, "confidence": "HIGH", "reasoning": "r"}
    assert seen[1].endswith("Question:\nq\n\nContext:\nc")


def test_questions_in_parts(spark):
    asked = spark.createDataFrame([(1, "Where is the fox? Who is lazy?"), (2, "Where is the fox?"), (3, " ")], "question long, text string")
    corpus = spark.createDataFrame([("1", "the fox is where the river is. who is lazy is the dog.")], "k string, content string")

    def retrieve(questions):
        return questions.crossJoin(corpus).select("question", F.lit(1).alias("rank"), "content")

    got = {x.question: x for x in workflow.answer_parts(asked, retrieve, save=lambda df, name: df).collect()}
    assert set(got) == {1, 2, 3} and got[1].parts == 2 and got[2].parts == 1
    assert (got[3].answer, got[3].report, got[3].attempts, got[3].parts) == (workflow.SAYS_NOTHING, "", 0, 1)
    assert got[1].answer.startswith("Q1: Where is the fox?\nA: ") and "\n\nQ2: Who is lazy?\nA: " in got[1].answer


def reader():
    class Reader:
        def pages(self, content):
            if content == b"broken":
                raise ValueError
            grid = [["h", "k"], ["1", None]]
            return [("first", [grid, grid, [["one"]]]), (None, []), (" ", [[["", ""], [None, ""]]]), ("last ", [[["a"], ["b"]]])]

        def render(self, content, first, last):
            return [f"{content.decode()}{i}".encode() for i in range(first, last + 1)]

        def features(self, image):
            import json

            from corvine.functions.charts import FEATURES

            return json.dumps({x: x in ("bar_pattern",) and image.endswith(b"3") if x in ("bar_pattern", "text_region") else 9 if x == "rects" else 0 for x in FEATURES})

    return Reader()  # of a class that is sent along


def test_pages_of_providers(spark):
    from corvine.sources import pages

    rows = spark.createDataFrame([("in/f.pdf", bytearray(b"ok")), ("in/g.pdf", bytearray(b"broken"))], "path string, content binary")
    got = pages.documents(pages.read_pages(rows, reader())).orderBy("page").collect()
    h = hashlib.sha256(b"ok").hexdigest()
    assert [(x.source, x.page, x.tables_count, x.chunk_id) for x in got] == [(f"f.pdf::{h}", 1, 1, f"txt_{h}_1_0"), (f"f.pdf::{h}", 4, 3, f"txt_{h}_4_0")]
    assert got[0].content == "## Page 1\n\n### Table 1 (Page 1)\n| h | k |\n| --- | --- |\n| 1 |  |\n\nfirst" and got[1].content.startswith("## Page 4\n\n### Table 3 (Page 4)")
    parts = pages.ranges(rows.filter("path = 'in/f.pdf'").withColumn("n_pages", F.lit(45)))
    assert [(x.first, x.last) for x in parts.orderBy("first").collect()] == [(1, 20), (21, 40), (41, 45)]
    seen = pages.charts(pages.images(parts, reader()), reader()).orderBy("page").collect()
    assert [x.page for x in seen] == list(range(1, 46)) and bytes(seen[20].image) == b"ok21"
    assert [x.page for x in seen if x.has_chart] == [3, 13, 23, 33, 43] and seen[2].chart_types == ["bar_chart"]


def test_settings_file(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# none\nCHUNK_SIZE=700\nexport MMR_K = '9'\n\nALLOWED_TYPES=.txt,.md\n")
    got = Settings.load(str(tmp_path / ".env"))
    assert (got.CHUNK_SIZE, got.MMR_K, got.ALLOWED_TYPES) == (700, 9, (".txt", ".md"))
    monkeypatch.setenv("CHUNK_SIZE", "800")
    assert Settings.load(str(tmp_path / ".env")).CHUNK_SIZE == 800 and Settings.load(str(tmp_path / "none")).MMR_K == 15


def test_existing_and_corrupt(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert files.remove_corrupt(spark, path) == 0 and files.existing(spark, [path, str(tmp_path)]) == [str(tmp_path)]
    rows = spark.createDataFrame([("h1", "x", datetime.datetime(2024, 1, 1))], "file_hash string, content string, cached_at timestamp")
    files.write_cache(rows, path)
    (tmp_path / "cache" / "file_hash=h2").mkdir()
    (tmp_path / "cache" / "file_hash=h2" / "part-0.parquet").write_bytes(b"PAR1 broken off")
    now = F.lit(datetime.datetime(2024, 1, 2))
    assert files.read_cache(spark, path, now).count() == 1 and files.remove_corrupt(spark, path) == 1
    assert not (tmp_path / "cache" / "file_hash=h2" / "part-0.parquet").exists() and files.read_cache(spark, path, now).count() == 1
