"""Periodic runs, lexical search and nearest vectors against brute force, with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from corvine.llm import partitions, runs, signatures

DOCS = "doc_id long, text string, lang string, runs string, n_words int, rest string, collapsed string, item_id int, score string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def documents() -> list[tuple]:
    r = random.Random(4)
    texts = [None, "", " \n\t", "one", "a a a a a a", "a a a a a", "a b a b a b a b", "x a b a b a b a b a y", "one two three " * 9, "ha " * 5000, "日本 é " * 8]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(5, 90))) for _ in range(30)]
    texts += ["\n".join(["some line of the page stays here again now"] * r.randint(1, 9)) + " tail" for _ in range(5)]
    texts += [" ".join(f"{r.choice('stuvw')}{r.randint(0, 300)}" for _ in range(20_000))]
    out = [(i, t, "en" if i % 2 else None, "x", 1, "y", "z", 3, "s") for i, t in enumerate(texts)]
    return out + [out[4], (None, "b b b b b b b", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search") / "documents.parquet")
    spark.createDataFrame(documents(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


# --- 12


def runs_by_comparison(w: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q) and not any(w[i : i + length - d] == w[i + d : i + length] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_of_random_words():
    r = random.Random(7)
    for _ in range(600):
        k = r.randint(1, 4)
        w = [r.randint(1, k) for _ in range(r.randint(0, 60))]
        root = [r.randint(1, k) for _ in range(r.randint(1, 14))]
        at = r.randint(0, len(w))
        w = w[:at] + (root * 7)[: r.randint(0, 90)] + w[at:]
        want = runs_by_comparison(w)
        assert [tuple(x) for x in runs.runs_of(np.array(w, dtype=np.int64)).tolist()] == want
        found = list(runs.document_runs([b"", " ".join(map(str, w)).encode(), b"1 2"]))
        assert [tuple(x) for x in found[1][1].tolist()] == want
        gone = {i for s, length, q in want for i in range(s + q, s + length)}
        assert found[1][2].decode() == " ".join(str(x) for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 800 + "a" * 700, "abaababaabaab" * 90])
def test_suffix_tree(text):
    """Ranks under both orders and common prefixes, of words that repeat themselves throughout."""
    s = [ord(c) - 96 for c in text[:400]] + [0]
    tree = runs.SuffixTree(s)
    order = sorted(range(len(s)), key=lambda i: s[i:])
    assert tree.ranks()[0][order].tolist() == list(range(len(s)))
    order = sorted(range(len(s)), key=lambda i: [-x for x in s[i:-1]] + [-99])
    assert tree.ranks()[1][order].tolist() == list(range(len(s)))
    i = np.repeat(np.arange(400), 400)
    j = np.tile(np.arange(400), 400)
    i, j = i[i != j], j[i != j]
    same = lambda a, b: next(k for k in range(len(s)) if s[a + k] != s[b + k])
    some = random.Random(1).sample(range(len(i)), 2000)
    assert tree.common(i[some], j[some]).tolist() == [same(a, b) for a, b in zip(i[some].tolist(), j[some].tolist(), strict=True)]
    whole = [ord(c) for c in text]
    assert [tuple(x) for x in runs.runs_of(np.array(whole)).tolist()] == runs_by_comparison(whole)


def planted(doc_id, text) -> list[str]:
    w = words(text)
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs(spark, docs, tmp_path):
    more = spark.createDataFrame([(1000 + i, t) for i in range(40) for t in ("", "one two three four five six seven eight nine ten " * 4 + f"end{i}")], "doc_id long, text string")
    path = str(tmp_path / "documents.parquet")
    docs.select("doc_id", "text").unionByName(more).write.parquet(path)
    got = sorted((r.asDict() for r in runs.op12_runs(spark, str(tmp_path)).collect()), key=lambda r: str(sorted(r.items(), key=lambda x: x[0])))
    want = []
    for r in spark.read.parquet(path).collect():
        w = planted(r.doc_id, r.text)
        found = runs_by_comparison(w)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append({
            "doc_id": r.doc_id, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2] if found else None,
            "runs_sha256": sha("".join("%d,%d,%d\n" % x for x in found)), "collapsed_sha256": sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
        })
    assert sum(r["n_runs"] > 0 for r in want) > 20
    assert got == sorted(want, key=lambda r: str(sorted(r.items(), key=lambda x: x[0])))


def test_runs_keep_columns(docs):
    found = runs.periodic_runs(docs)
    assert sorted(found.columns) == sorted(c for c in docs.columns if c != "text")
    rows = found.filter("doc_id = 6").collect()
    assert [(r.runs[0].asDict(), r.n_words, r.collapsed, r.rest, r.score) for r in rows] == [({"start": 0, "length": 8, "period": 2}, 8, "a b", "y", "s")]
    assert runs.periodic_runs(docs.limit(0)).count() == 0


# --- 13


def nearest_by_comparison(rows: list, asked, k: int) -> dict:
    fine = list({(v, tuple(e)): (v, np.array(e, dtype=np.float64)) for v, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)}.values())
    out = {}
    for v, e in fine:
        if v is not None and asked(v):
            near = [(-float((e * x).sum()), w is None, w or 0) for w, x in fine if w != v and len(x) == len(e)]
            out.setdefault(v, []).append([(None if none else w, -s) for s, none, w in sorted(near)[:k]])
    return out


def found_by_query(frame) -> dict:
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_nearest_small(spark):
    """So few vectors that one part holds them: exact, with ties, copies, odd vectors and clashing names."""
    r = np.random.default_rng(3)
    rows = [(i, r.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]
    rows += [(60 + i, [1.0, 2.0, 0.0, -1.0]) for i in range(40)] + [rows[3], (None, [2.0, 2.0, 2.0, 2.0]), (200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]), (260, [float("nan"), 1.0, 0.0, 0.0]), (280, [float("inf"), 0.0, 0.0, 0.0]), (300, [5.0, 1.0]), (301, [1.0, 1.0])]
    frame = spark.createDataFrame([(v, e, 1, "x", 2) for v, e in rows], "vec_id long, embedding array<float>, rank int, score string, part int").repartition(3)
    for k in (20, 5):
        got = found_by_query(partitions.nearest(frame, partitions.F.col("vec_id") % 20 == 0, k))
        want = {v: some[0] for v, some in nearest_by_comparison(rows, lambda v: v % 20 == 0, k).items() if some[0]}
        assert got == want
    assert partitions.nearest(frame.limit(0), partitions.F.lit(True)).count() == 0
    assert partitions.nearest(frame.filter("vec_id = 7"), partitions.F.lit(True)).count() == 0


@pytest.mark.parametrize("clusters", [40, 0])
def test_nearest_recall(spark, monkeypatch, clusters):
    """Recall over all queries against brute force, of vectors in clusters and of vectors without any structure."""
    r = np.random.default_rng(5)
    n, size = 3000, 32
    x = r.standard_normal((n, size))
    if clusters:
        x = 0.5 * x + 2 * r.standard_normal((clusters, size))[r.integers(0, clusters, n)]
    x = x.astype(np.float32)
    x[50] *= 4
    x[100:300] = x[50]  # a group of copies
    monkeypatch.setattr(partitions, "BLOCK", 128)
    frame = spark.createDataFrame([(i, e) for i, e in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)
    got = found_by_query(partitions.nearest(frame, partitions.F.col("vec_id") % 20 == 0))
    want = nearest_by_comparison([(i, e) for i, e in enumerate(x.tolist())], lambda v: v % 20 == 0, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    exact = {(q, v): s for q, some in want.items() for v, s in some[0]}
    assert sum((q, v) in exact for q, some in got.items() for v, _ in some) / len(exact) >= 0.9
    assert all(s == exact[q, v] for q, some in got.items() for v, s in some if (q, v) in exact)
    assert [v for v, _ in got[100]] == [50, *range(101, 120)]


def test_learned_partitions():
    """Parts of one size that cut few links, and few parts for a query where vectors have clusters."""
    r = np.random.default_rng(6)
    centres = 3 * r.standard_normal((64, 24))
    x = r.standard_normal((4096, 24)) + centres[r.integers(0, 64, 4096)]
    links = partitions.neighbours(x, x, 10, same=True)
    part = partitions.bisected(links, 16)
    assert np.bincount(part).tolist() == [256] * 16
    assert (part[:, None] == part[links]).mean() > 0.8
    model = partitions.fitted(x, 16)
    assert model.probes <= 8  # a held-out query has 16 of its own cluster, so the 20 nearest are in more than one
    again = partitions.Classifier.unpacked(model.packed())
    assert again.probes == model.probes and np.allclose(again.scores(partitions.unit(x)), model.scores(partitions.unit(x)), atol=1e-3)


# --- 11


def ranking_by_reading(docs: list, items: list, k: int) -> list[tuple]:
    found = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda x: x[0].lower(), t or ""))
    known = [(doc_id, found(t)) for doc_id, t in docs]
    known = [(d, ts) for d, ts in known if ts]
    n, length = len(known), sum(len(ts) for _, ts in known)
    df = {}
    for _, ts in known:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item_id, text in items:
        some = []
        for doc_id, ts in known:
            m = 75 + 25 * len(ts) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * ts.count(t) // (1000 * ts.count(t) + 12 * m)) for t in found(text) if t in ts)
            if score > 0:
                some.append((-score, doc_id is None, doc_id))
        out += [(item_id, rank + 1, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(some, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "portion"), [(1024, 20_000), (8, 30)])
def test_search(spark, docs, monkeypatch, block, portion):
    """Nulls, repeats, ties, long texts, items that hold nothing or what no document holds; in small blocks and portions too."""
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "ÉTÉ", "it's", "a-b", "日本", "K"]
    texts = [" ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=int(2 ** r.uniform(0, 9)))) for _ in range(300)]
    texts += [texts[7]] * 30 + ["rare word", "\x00rare\x7f", "...", "W3 w3 W3", "k K K"]
    more = spark.createDataFrame([(500 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table = docs.unionByName(more, allowMissingColumns=True).repartition(3)
    items = [(1, "w1 w2 w40 w40 rare"), (2, None), (3, "!?"), (4, "unheardof"), (5, "Rare"), (6, texts[7]), (7, "W3 straße éTÉ ÉTÉ"), (None, "w50 w51"), (1, "w55"), (8, "日本 one two a a"), (9, " ".join(vocabulary) * 3)]
    frame = spark.createDataFrame([(i, t, 5, 6) for i, t in items], "item_id long, text string, rank int, doc long")
    monkeypatch.setattr(signatures, "BLOCK", block)
    monkeypatch.setattr(signatures, "PORTION", portion)
    found = signatures.search(table, frame, k=20)
    got = sorted((tuple(x) for x in found.select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == ranking_by_reading([(x.doc_id, x.text) for x in table.select("doc_id", "text").collect()], items, 20)
    assert signatures.search(table.limit(0), frame).count() == 0
    assert signatures.search(table, frame.limit(0)).count() == 0


def test_signatures_only_overestimate():
    """No bound is below a score, and few documents reach more than they score."""
    r = random.Random(12)
    docs = [[f"t{min(r.randint(0, 400), r.randint(0, 400))}".encode() for _ in range(r.randint(1, 300))] for _ in range(400)]
    df = signatures.Counter(t for d in docs for t in set(d))
    rows = [{"item": i, "term": t, "times": c, "df": df[t]} for i in range(20) for t, c in signatures.Counter(r.choices(sorted(df), k=15)).items()]
    portion = signatures.Portion(rows, len(docs), sum(map(len, docs)), 20)
    blocks, done = signatures.Blocks(), []
    for i, d in enumerate(docs):
        counts = signatures.Counter(d)
        keys = [(h, level) for t, c in counts.items() for h in signatures.hashed([t]).tolist() for level in range(sum(c >= x for x in signatures.LEVELS))]
        rows_, full = signatures.rows_of(len(keys))
        hashes, levels = np.array([h for h, _ in keys], dtype=np.uint64), np.array([x for _, x in keys])
        done += list(blocks.add(rows_, full, i, len(d), signatures.places(hashes, levels, rows_).reshape(-1)))
    done += [blocks.closed(x) for x in list(blocks.open)]
    above, by_chance = 0, 0.0
    for n_rows, names, ns, slices in done:
        bounds = portion.bounds(n_rows, ns, slices)
        # a term that a document lacks is there by chance if all its places are set
        density = np.unpackbits(np.frombuffer(slices, np.uint8).reshape(n_rows, -1), axis=1, bitorder="little")[:, : len(names)].mean()
        assert density < 0.35
        by_chance += 20 * len(names) * (1 - (1 - density**signatures.HASHES) ** 15)
        for at, i in enumerate(names):
            for item in range(20):
                score = portion.score(item, len(docs[i]), signatures.Counter(docs[i]))
                assert bounds[item, at] >= score
                above += bounds[item, at] > 1.2 * score + 1
    assert above < by_chance < 0.2 * 20 * len(docs)
