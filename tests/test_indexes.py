"""Indexes that last: words, vectors, stores with versions, sources and streams that feed them."""

from __future__ import annotations

import datetime
import hashlib
import os
import random
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine.operators import answers, bm25, embed, hash_tree, ivf, learned, line_voting, postings, vector, versioned
from corvine.sources import page_format
from corvine.streaming import rate_limit


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


@pytest.fixture
def save(folder):
    def write(df, name):
        at = f"{folder}/tables/{name}-{uuid.uuid4().hex}"
        df.write.parquet(at)
        return df.sparkSession.read.schema(df.schema).parquet(at)

    return write


def rows_of(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=str)


def test_stored_words(spark, folder, save):
    """Three appends, one that fails between write and commit, nulls, empty and repeated texts: as one pass over all texts."""
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(200)]
    texts = [" ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(200)], k=r.randint(1, 60))) for _ in range(240)] + [None, "", " \n", "w199 w199", "w199 w199"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    questions = spark.createDataFrame([(1, "w150 w151 w3"), (2, "w1 w1 w180"), (3, "unheard"), (4, None), (5, texts[7]), (6, "w199")], "question long, text string")
    for part in range(3):
        postings.append(docs.filter(F.col("doc_id") % 3 == part), folder, zone=8)
    failing = docs.withColumn("text", F.when(F.col("doc_id") == 239, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        postings.append(failing, folder, zone=8)
    index = postings.Index(spark, folder)
    assert index.stats().first().n == len(texts)
    looked_at = {}

    def counting(df, name):
        out = save(df, name)
        looked_at[name] = out.count()
        return out

    got = postings.search(index, questions, counting, k=8)
    assert rows_of(got, "question", "doc", "score", "rank") == rows_of(bm25.top_documents(questions, docs, k=8), "question", "doc", "score", "rank")
    assert looked_at["left"] + 4 * 4 < looked_at["zones"]  # zones that no search has read
    postings.append(docs.limit(0), folder)
    assert postings.Index(spark, folder).stats().first().n == len(texts)


def shuffled(spark) -> int:
    """Bytes that all stages of the session have shuffled until now."""
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    stages = context._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_search_shuffles_postings(spark, folder, save):
    """Common words in all documents: what is shuffled are lists of postings, not a row for each question and document (F5, F8, F9)."""
    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(r.choices("a b c d e f g h".split(), k=r.randint(2, 60)))) for i in range(6000)], "doc_id long, text string").coalesce(4)
    questions = spark.createDataFrame([(i, "a b c d"[: 1 + 2 * (i % 4)]) for i in range(40)], "question long, text string")
    postings.append(docs, folder)
    index = postings.Index(spark, folder)
    assert {"docs", "dls"} & set(index.postings.columns) == set()
    before = shuffled(spark)
    got = rows_of(postings.search(index, questions, save, k=8), "question", "doc", "score", "rank")
    assert shuffled(spark) - before < 1_000_000
    assert got == rows_of(bm25.top_documents(questions, docs, k=8), "question", "doc", "score", "rank")


@pytest.mark.parametrize("name", ["rrf_fusion", "rrf_pages"])
def test_fusion_shuffles_little(spark, tmp_path, name):
    """Of common words in all documents, and some vectors: the registered queries shuffle no row for each question and document (F8, F9)."""
    from corvine.plans import queries as plans

    r = random.Random(2)
    spark.createDataFrame([(i, " ".join(r.choices("a b c d e f g h".split(), k=r.randint(2, 60)))) for i in range(6000)], "doc_id long, text string").coalesce(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, "a b c d") for i in range(40)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(200)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    before = shuffled(spark)
    assert {x[0] for x in plans.QUERIES[name](spark, str(tmp_path)).collect()} == set(range(40))
    assert shuffled(spark) - before < 1_500_000


@pytest.mark.parametrize("clusters", [30, 0])
def test_vector_index(spark, folder, save, clusters):
    """Recall of all queries against the exact search, of vectors with and without clusters; null vectors; later additions."""
    r = np.random.default_rng(2)
    x = r.standard_normal((4000, 32))
    if clusters:
        x = 0.4 * x + r.standard_normal((clusters, 32))[r.integers(0, clusters, 4000)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(np.float32).tolist())] + [(5000, None)], "id long, embedding array<float>").repartition(4)
    ivf.build(rows.filter("id % 4 <> 3"), folder, k=20)
    ivf.add(rows.filter("id % 4 = 3"), folder)
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("query"), "embedding")
    found = ivf.search(asked, folder, save, k=20, block=300)
    got, want = {(a.query, a.id): a for a in found.collect()}, {(a.query, a.id): a for a in vector.nearest(asked, rows, 20).collect()}
    assert len(got) == len(want) == 80 * 20
    assert len(got.keys() & want.keys()) / len(want) >= 0.9
    assert all(abs(got[k].similarity - want[k].similarity) < 1e-8 for k in got.keys() & want.keys())
    assert ivf.model_at(spark, folder).probes < len(ivf.model_at(spark, folder).centres)
    assert spark.read.parquet(f"{folder}/entries").count() == 4000


def test_vector_index_of_given_vectors(spark):
    from corvine.plans import queries

    at = "/root/testdata/sf0.01"
    got, want = ({(a["query"], a["id"]) for a in queries.QUERIES[name](spark, at).collect()} for name in ("knn_indexed", "knn_topk"))
    assert len(got & want) / len(want) >= 0.9


def test_empty_vector_index(spark, folder, save):
    rows = spark.createDataFrame([], "id long, embedding array<float>")
    ivf.build(rows, folder)
    assert ivf.search(rows.withColumnRenamed("id", "query"), folder, save).count() == 0


def contents(spark, at, **more):
    return {r.doc_id: r.text for r in versioned.read(spark, at, "doc_id long, text string", **more).collect()}


def test_versions(spark, folder):
    put = lambda *rows: versioned.write(spark.createDataFrame(list(rows), "doc_id long, text string"), folder)
    assert contents(spark, folder) == {} and versioned.compact(spark, folder, "doc_id long, text string") is None
    assert put((1, "a"), (2, "b"), (None, "n")) == 1 and put((2, "c"), (3, None)) == 2
    assert versioned.delete(spark.createDataFrame([(1,), (9,)], "doc_id long"), folder) == 3
    assert contents(spark, folder) == {2: "c", 3: None, None: "n"} and contents(spark, folder, version=1) == {1: "a", 2: "b", None: "n"}
    assert versioned.compact(spark, folder, "doc_id long, text string") == 4 and put((1, "back")) == 5
    assert contents(spark, folder) == {1: "back", 2: "c", 3: None, None: "n"} and contents(spark, folder, version=2) == {1: "a", 2: "c", 3: None, None: "n"}
    # a version that came while a compaction worked stays on top of it
    merged = versioned.read
    try:
        versioned.read = lambda *a, **k: (put((2, "between")), merged(*a, **k))[1]
        versioned.compact(spark, folder, "doc_id long, text string")
    finally:
        versioned.read = merged
    assert contents(spark, folder)[2] == "between"


def test_versions_of_many_writers(spark, folder):
    """Writers at once, each with rows of its own and one row that all of them write: nothing is lost, one of them is the last."""
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda i: versioned.write(spark.createDataFrame([(i, f"w{i}"), (100, f"w{i}")], "doc_id long, text string"), folder), range(6)))
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    found = contents(spark, folder)
    assert {i: found[i] for i in range(6)} == {i: f"w{i}" for i in range(6)} and found[100] == f"w{got.index(6)}"
    # two that carry the same epoch: one commit
    with ThreadPoolExecutor(4) as pool:
        again = list(pool.map(lambda i: versioned.write(spark.createDataFrame([(200 + i, "e")], "doc_id long, text string"), folder, ("stream", 7)), range(4)))
    assert sorted(x is None for x in again) == [False, True, True, True] and len(contents(spark, folder)) == 8


def test_stream_that_fails_between_write_and_commit(spark, folder, monkeypatch):
    for i in range(3):
        spark.createDataFrame([(i, f"t{i}"), (10 + i, f"u{i}")], "doc_id long, text string").write.parquet(f"{folder}/in/{i}")
    start = lambda checkpoint: versioned.stream_into(
        spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*"), f"{folder}/table", f"{folder}/{checkpoint}", "docs"
    )
    commit = versioned._committed
    calls = []

    def failing(*a):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("lost before the commit")
        out = commit(*a)
        if len(calls) == 4:
            raise OSError("lost behind the commit")
        return out

    monkeypatch.setattr(versioned, "_committed", failing)
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            start("checkpoint").awaitTermination()
    monkeypatch.setattr(versioned, "_committed", commit)
    start("checkpoint").awaitTermination()
    versions = versioned.log(spark, f"{folder}/table")
    assert len(versions) == len({r.epoch for r in versions}) >= 3
    assert contents(spark, f"{folder}/table") == {k + i: f"{c}{i}" for i in range(3) for k, c in ((0, "t"), (10, "u"))}
    start("another").awaitTermination()  # without the checkpoint: the same epochs once more
    assert len(versioned.log(spark, f"{folder}/table")) == len(versions)


def test_page_source(spark, tmp_path):
    page_format.register(spark)
    at = tmp_path / "pages"
    (at / "deep").mkdir(parents=True)
    (at / "a.txt").write_bytes(b"one\ftwo \xff\fthree\f")
    (at / "deep" / "b.txt").write_bytes("ü\f\fx".encode())
    (at / "empty.txt").write_bytes(b"")
    (at / "_hidden.txt").write_bytes(b"no")
    read = lambda **o: spark.read.format("corvine_pages").options(**o).load(str(at))
    want = [("a.txt", 1, 3, "one"), ("a.txt", 2, 3, "two �"), ("a.txt", 3, 3, "three"), ("b.txt", 1, 3, "ü"), ("b.txt", 2, 3, ""), ("b.txt", 3, 3, "x")]
    for share in ("2", "1000"):
        got = read(share=share).select(F.substring_index("path", "/", -1), "page", "n_pages", "text")
        assert sorted(map(tuple, got.collect())) == want
    assert read(share="2").rdd.getNumPartitions() > 6
    one = read().filter(F.col("path") == str(at / "a.txt")).filter("page >= 2")
    assert one.rdd.getNumPartitions() == 1 and sorted(r.text for r in one.collect()) == ["three", "two �"]
    assert {r.file_hash for r in one.collect()} == {hashlib.sha256(b"one\ftwo \xff\fthree\f").hexdigest()}
    (tmp_path / "none").mkdir()
    assert spark.read.format("corvine_pages").load(str(tmp_path / "none")).count() == 0


def test_page_stream(spark, tmp_path):
    """Files that arrive, a restart between them, and no file twice."""
    page_format.register(spark)
    at = tmp_path / "pages"
    at.mkdir()

    def run():
        rows = spark.readStream.format("corvine_pages").load(str(at))
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for i, text in enumerate((b"a\fb", b"c", b"d\f")):
        (at / f"{9 - i}.txt").write_bytes(text)
        os.utime(at / f"{9 - i}.txt", (1000 + i, 1000 + i))
        if i == 1:
            assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c", "d"] and run() == ["a", "b", "c", "d"]


def test_limiter_with_list_state(spark, tmp_path):
    """Micro-batches with a restart in between, equal to the batch; the state of keys goes with the watermark."""
    start = datetime.datetime(2024, 1, 1)
    calls = [(i % 3, start + datetime.timedelta(minutes=7 * i), i) for i in range(90)] + [(9, start + datetime.timedelta(days=3), 1000)]
    frame = spark.createDataFrame(calls, "key long, at timestamp, id long")
    (tmp_path / "in").mkdir()

    def run(first, last, turn):
        frame.filter(F.col("id").between(first, last)).coalesce(1).write.parquet(str(tmp_path / "in" / str(turn)))
        stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = rate_limit.limited_keys(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        out.awaitTermination(120)
        return out.lastProgress

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        run(0, 40, 0)
        assert run(41, 89, 1)["stateOperators"][0]["numRowsTotal"] > 0
        run(1000, 1000, 2)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(got, "id", "admitted") == rows_of(rate_limit.limited(frame), "id", "admitted")
    state = spark.read.format("statestore").option("stateVarName", "times").load(str(tmp_path / "c"))
    assert {r.key[0] for r in state.select("key").collect()} == {9}


@pytest.mark.parametrize("more", [0, 3000])
def test_difference_by_hash_tree(spark, folder, more):
    """As the full comparison; few leaves are read; trees of different depth; empty sets, nulls and repeated ids."""
    rows = [(i, f"d{i}") for i in range(2000)] + [(None, "n"), (7, "twice"), (8, None)]
    other = [r for r in rows if r[0] not in (3, 500)] + [(i, "more") for i in range(9000, 9000 + more)]
    other[20] = (other[20][0], "changed")
    keep = lambda some, name, **o: hash_tree.keep(spark.createDataFrame(some, "id long, digest string").repartition(3), f"{folder}/{name}", **o)
    keep(rows, "a", leaf=10)
    keep(other, "b", leaf=10)
    keep(list(reversed(rows)), "c", leaf=10)
    keep([], "none")
    keep(rows, "deep", leaf=1)
    found = lambda x, y: sorted(map(tuple, hash_tree.difference(spark, f"{folder}/{x}", f"{folder}/{y}").collect()), key=str)
    want = [(3, "gone"), (500, "gone"), (other[20][0], "changed")] + [(i, "new") for i in range(9000, 9000 + more)]
    assert found("a", "b") == sorted(want, key=str) and found("deep", "b") == sorted(want, key=str)
    assert hash_tree.root(spark, f"{folder}/a") == hash_tree.root(spark, f"{folder}/c") != hash_tree.root(spark, f"{folder}/b") and found("a", "c") == []
    if not more:
        assert hash_tree.changed_leaves(spark, f"{folder}/a", f"{folder}/b")[1].count() <= 3
    assert len(found("none", "a")) == len(found("a", "none")) == 2001 and {c for _, c in found("none", "a")} == {"new"}


def test_memory_of_answers(spark, tmp_path, save):
    """Every prompt is asked once in all, over repeated rows, two runs and a task that is lost; failures have a reason and another turn."""
    calls, memory, broken = tmp_path / "calls.txt", str(tmp_path / "memory"), tmp_path / "broken"

    def complete(prompt):
        with open(calls, "a") as f:
            f.write(prompt + "\n")
        if prompt == "bad" and broken.exists():
            raise ValueError("out of order")
        return prompt.upper()

    def lost(prompt):
        if prompt == "p30" and broken.exists():
            broken.unlink()
            os._exit(1)  # the worker, with all that it holds
        return complete(prompt)

    prompts = [f"p{i}" for i in range(40)] + ["bad"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(prompts * 2)] + [(99, None)], "id long, prompt string").repartition(3)
    broken.touch()
    first = {r.id: r for r in answers.answered(rows.filter("id < 20 OR id = 40"), memory, complete, save, at_a_time=3).collect()}
    assert first[3].answer == "P3" and first[3].error is None and first[40].answer is None and first[40].error == "ValueError: out of order"
    with pytest.raises(Exception, match="(?i)worker|exit"):
        answers.answered(rows, memory, lost, save, at_a_time=1).collect()
    again = {r.id: r for r in answers.answered(rows, memory, complete, save, at_a_time=1).collect()}
    assert len(again) == 83 and all(r.answer == (r.prompt and r.prompt.upper()) and r.error is None for r in again.values())
    asked = calls.read_text().split()
    assert sorted(x for x in asked if x != "bad") == sorted(prompts[:40]) and 2 <= asked.count("bad") <= 3


def test_line_voting(spark):
    """A square, a diagonal and noise: votes and peaks as by plain loops; nothing of an empty picture."""
    r = random.Random(3)
    drawn = {1: [(x, 5) for x in range(30)] + [(5, y) for y in range(25)], 2: [(i, i) for i in range(20)], 3: [(r.randint(0, 40), r.randint(0, 40)) for _ in range(60)], 4: [(1, 1), (None, 2)]}
    pixels = spark.createDataFrame([(i, x, y) for i, some in drawn.items() for x, y in some], "image int, x int, y int")
    want = {}
    for i, some in drawn.items():
        cells: dict = {}
        for x, y in some:
            for a, (c, s) in enumerate(line_voting.TURNS):
                if x is not None:
                    cells.setdefault((a, (x * c + y * s + 512) // 1024), []).append(y * c - x * s)
        cells = {k: v for k, v in cells.items() if len(v) >= line_voting.LEAST}
        for (a, d), v in cells.items():
            near = [(-len(cells[k]), k) for k in ((a + p, d + q) for p in (-1, 0, 1) for q in (-1, 0, 1)) if k in cells]
            if min(near)[1] == (a, d):
                want[i, a, d] = (len(v), min(v), max(v))
    found = line_voting.peaks(line_voting.votes(pixels.filter("x IS NOT NULL")))
    assert {(x.image, x.angle, x.distance): (x.votes, x.low, x.high) for x in found.collect()} == want
    kinds = sorted((x.image, x.kind) for x in line_voting.lines(found).filter("votes >= 20 AND image < 3").collect())
    assert (1, "horizontal") in kinds and (1, "vertical") in kinds and (2, "diagonal") in kinds
    assert line_voting.features(line_voting.lines(found)).filter("image = 4").count() == 0
    boxes = spark.createDataFrame([(1, 10.0, 20.0)] * 6 + [(2, 100.0, 60.0)], "image int, width double, height double")
    assert sorted((x.image, x.rects, x.large, x.mean_w, x.std_h) for x in line_voting.rectangles(boxes).collect()) == [(1, 6, 0, 10.0, 0.0), (2, 1, 1, 100.0, 0.0)]


def test_pictures_in_blocks(spark, monkeypatch):
    """Pictures that lie together, a few pixels at a time: what votes, peaks and histograms say, and no shuffle of cells (F1)."""
    from corvine.plans import queries as plans

    r = random.Random(4)
    drawn = {1: [(x, 5) for x in range(30)], 2: [(i, i + 10**9) for i in range(20)], 3: [(r.randint(0, 15), r.randint(0, 15)) for _ in range(200)], 4: [(1, 1)], 5: [(-x, 3 * x) for x in range(12)] * 2}
    rows = [(i, x, y, r.choice([0, 17, 40, 255, None]) if i < 5 else 3) for i, some in drawn.items() for x, y in some]
    pixels = spark.createDataFrame(rows, "image long, x int, y int, value int")
    want = {(x.image, x.angle, x.distance): (x.votes, x.low, x.high) for x in line_voting.peaks(line_voting.votes(pixels)).collect()}
    colours = {x.image: x.color_peaks for x in line_voting.colour_peaks(pixels).collect()}
    features = line_voting.features(line_voting.lines(line_voting.peaks(line_voting.votes(pixels)))).join(line_voting.colour_peaks(pixels), "image")
    plain = lambda df: sorted((x.image, x.lines, x.horizontal, x.vertical, x.diag, x.very_short, round(x.angle_var, 9), x.color_peaks) for x in df.collect())
    together = pixels.repartition(2, "image").sortWithinPartitions("image")
    for size in (7, 1 << 15):
        monkeypatch.setattr(line_voting, "PIXELS", size)
        found = line_voting.pictures(together).collect()
        assert {(x.image, p.angle, p.distance): (p.votes, p.low, p.high) for x in found for p in x.peaks} == want and not next(x for x in found if x.image == 4).peaks
        assert {x.image: x.color_peaks for x in found} == colours
        assert plain(line_voting.picture_features(line_voting.pictures(together))) == plain(features)
    # as the SQL groups them: pixels without a place have a line for each angle
    nowhere = line_voting.pictures(spark.createDataFrame([(1, None, 2, 0)] * 6, "image long, x int, y int, value int").coalesce(1)).first()
    assert [(p.angle, p.distance, p.votes, p.low) for p in nowhere.peaks] == [(a, None, 6, None) for a in range(line_voting.ANGLES)] and nowhere.color_peaks == 1
    # strokes alone are shuffled
    plan = plans.QUERIES["picture_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_vectors_of_rows(spark):
    """Vectors of texts row by row are those of counts by word, with texts without words left out, and nothing is shuffled (F3)."""
    texts = ["a b a C c", None, "", "b \t b", " \n", "ä Ä ä x", " ".join(f"w{i % 97}" for i in range(5000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(2)
    rows = embed.dense_rows(docs, "id", "text")
    want = {x.id: x.embedding for x in embed.dense(embed.hashed(docs, "id", "text"), "id").collect()}
    assert {x.id: x.embedding for x in rows.collect()} == want and sorted(want) == [0, 3, 5, 6]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_learned_vectors(spark, save):
    """The directions of the given documents against a full decomposition; texts without terms; similar texts lie together."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, " ")], "doc_id long, text string"))
    sparse = save(learned.rows(docs, save, features=1024), "sparse")
    held = {r.doc_id: r for r in sparse.collect()}
    matrix = np.zeros((len(held), 1024))
    for i, r in enumerate(held.values()):
        matrix[i, r.places] = r.weights
    lengths = np.sqrt((matrix**2).sum(axis=1))
    assert ((abs(lengths - 1) < 1e-9) | (lengths == 0)).all() and not held[-1].places and not held[-2].places
    basis = learned.fit(sparse, size=8, more=12, rounds=12, features=1024)
    assert np.allclose(basis.T @ basis, np.eye(8), atol=1e-9)
    _, strengths, directions = np.linalg.svd(matrix, full_matrices=False)
    # what the best eight directions hold, and the angles between the two subspaces as far as they are told apart
    assert ((matrix @ basis) ** 2).sum() >= 0.999 * (strengths[:8] ** 2).sum()
    clear = next(k for k in range(8, 0, -1) if strengths[k - 1] > 1.03 * strengths[k])
    assert np.linalg.svd(basis.T @ directions[:clear].T, compute_uv=False)[:clear].min() > 0.99
    got = {r.doc_id: np.array(r.embedding) for r in learned.embedded(sparse, basis).collect()}
    assert len(got) == len(held) and not got[-1].any()
    want = matrix @ basis
    for i, k in enumerate(held):
        if want[i].any():
            assert np.allclose(got[k], want[i] / np.linalg.norm(want[i]), atol=1e-5)


def test_learned_sums_are_quick(spark):
    """Sums over entries as by plain products, of none too; and one product a key, not an addition for each entry (F4)."""
    import time

    r = np.random.default_rng(5)
    assert not learned.times(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), 3, np.ones((8, 2))).any()
    n, entries = 1_000, 200_000
    row, at, weight, basis = np.sort(r.integers(0, n, entries)), r.integers(0, 8_192, entries).astype(np.int32), r.random(entries), r.standard_normal((8_192, 80))
    some = slice(0, 20_000)
    want = np.zeros((n, 80))
    np.add.at(want, row[some], basis[at[some]] * weight[some, None])
    assert np.allclose(learned.times(row[some], at[some], weight[some], n, basis), want, atol=1e-9)
    began = time.process_time()
    np.add.at(np.zeros((n, 80)), row, basis[at] * weight[:, None])
    plain, began = time.process_time() - began, time.process_time()
    learned.times(row, at, weight, n, basis)
    assert time.process_time() - began < plain / 2


def test_learned_rows_in_batches(spark, save):
    """Weights of terms as by plain counts, in batches of any size, with texts without terms between others (F4)."""
    texts = ["a b a c", None, "", "b b b", " \n", "c d e f g a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    places = {w: spark.range(1).select(learned.place(F.lit(w), 1 << 15)).first()[0] for w in "abcdefg"}
    df = {w: sum(w in (t or "").split() for t in texts) for w in places}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = {x.doc_id: dict(zip(x.places, x.weights, strict=True)) for x in learned.rows(docs, save).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, t in enumerate(texts):
        counts = {w: (t or "").split().count(w) for w in set((t or "").split())}
        raw = {places[w]: (1 + np.log(c)) * np.log((1 + len(texts)) / (1 + df[w])) for w, c in counts.items()}
        length = np.sqrt(sum(v * v for v in raw.values())) or 1.0
        assert found[i].keys() == raw.keys() and all(abs(found[i][k] - v / length) < 1e-12 for k, v in raw.items())
