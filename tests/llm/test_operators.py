"""Every operator on nulls, empty and long texts, ties, repeats, empty tables and clashing names, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvine.llm import bpe, embeddings, html, jaccard, licenses, mix, ppm, quality, repeats, tokenbin

tokenizer_files = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, r_id long, j_id long, kept string, n_words int, rest string, node int"
WORDS = "the of and house river stone green quick brown fox jumps over lazy dog near by far away under bridge water light".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randint(0, 99)) if r.random() < 0.5 else "") for _ in range(n))


def rows() -> list[tuple]:
    base, shared = prose(1, 120), prose(2, 90)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [base, base, near, None, "", "   \n ", "one two three", "one two three", "é" * 150 + shared, "x\n" + shared + " tail", "a" * 5000, "日本語 テキスト 🙂 " * 30, prose(3, 20_000), "!!! ### 123", "<|endoftext|> hi  there \n\n", "aé" * 300]
    langs = ["en", "en", "en", None, None, "en", "en", "en", "fr", "en", None, "ja", "en", None, "en", "fr"]
    out = [(i, t, lang, "s1" if i % 3 else None, 0, 7, 7, "x", 1, "rest", 2) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    return out + [out[1], (None, "lost id", None, "s2", 0, 0, 0, "", 0, "", 0)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def by_text(frame, *columns):
    return {(r["doc_id"], r["text"]): tuple(r[c] for c in columns) for r in frame.collect()}


# --- 1


def test_mix(spark, docs, empty):
    sized = docs.withColumn("size", mix.word_count(F.col("text")))
    got = mix.mix(sized).collect()
    assert len(got) == len(rows())
    size = Counter()
    for r in rows():
        size[r[3]] += len(words(r[1]))
    total = 1.5 * sum(size.values())
    weight = dict(zip(sorted((s for s in size if s), key=str.encode) + [None], itertools.cycle((5.0, 2.0, 1.0)), strict=False))
    capped: set = set()
    while True:
        free = [s for s in size if s not in capped]
        level = (total - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if level * weight[s] > 2 * size[s]}
        if not more:
            break
        capped |= more
    taken, largest = Counter(), Counter()
    for r in got:
        want = 2.0 * size[r.source] if r.source in capped else level * weight[r.source]
        assert math.isclose(r.target, want) and r.source_size == size[r.source] and r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        want = 2.0 * size[s] if s in capped else level * weight[s]
        assert abs(taken[s] - want) <= largest[s] / 2 + 1
    assert sorted(map(str, got)) == sorted(map(str, mix.mix(sized.repartition(7)).collect()))
    assert mix.mix(empty.withColumn("size", mix.word_count(F.col("text")))).count() == 0


# --- 2


def test_licenses(spark, docs, empty):
    known = licenses.known_digests(spark)
    mit = next(t for k, kind, t in licenses.KNOWN if (k, kind) == ("MIT", "text"))
    cases = [(1, mit.upper().replace("LICENSE", "LICENCE")), (2, "Copyright (c) 2020 Someone\n" + mit.replace("\n", "\n\n")), (3, mit + " more"), (4, "Text.\nLicensed under CC-BY NC 4.0!\nEnd"), (5, None), (6, "licence licence"), (6, "licence licence")]
    # rows of one doc_id, and of none, are scanned one by one, whatever their lines
    cases += [(7, "x\nLicensed under CC BY 4.0."), (7, "x Licensed under\nCC BY 4.0."), (None, "Licensed under CC BY 4.0.\nLicensed under the MIT License."), (None, "")]
    found = licenses.scan(spark.createDataFrame(cases, "doc_id long, text string"), known).collect()
    got = {r.doc_id: r for r in found}
    assert sorted((str(r.doc_id), r.notices, r.n_notices) for r in found if r.doc_id in (6, 7, None)) == [("6", "", 0), ("6", "", 0), ("7", "", 0), ("7", "CC-BY-4.0", 1), ("None", "", 0), ("None", "CC-BY-4.0,MIT", 2)]
    assert [got[i].license for i in (1, 2, 3, 4, 5)] == ["MIT", "MIT", None, None, None]
    assert got[4].notices == "CC-BY-NC-4.0" and got[4].n_notices == 1 and got[5].digest is None
    assert licenses.scan(docs, known).count() == len(rows()) and licenses.scan(empty, known).count() == 0


def test_licenses_wrapped(spark):
    import textwrap

    known = licenses.known_digests(spark)
    texts = [(k, t) for k, kind, t in licenses.KNOWN if kind == "text"]
    stated = ["Copyright (c) 2020 Some One", "Copyright 2020-2024 Some One", "(C) 2019 Some One", "© Some One", "Copyright The House Authors", "copyright: 2001 some one", ""]
    cases = {}
    for k, t in texts:
        for width in range(20, 100, 3):
            for upper in (False, True):
                wrapped = "\n\n".join("\n".join(textwrap.wrap(x, width)) for x in t.split("\n"))
                cases[len(cases)] = (k, stated[len(cases) % 7] + "\n" + (wrapped.upper() if upper else wrapped))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in cases.items()], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan(docs, known).collect()} == {i: k for i, (k, _) in cases.items()}


def test_licenses_further(spark):
    from pathlib import Path

    known = licenses.known_digests(spark)
    lines = [("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), (" * SPDX-License-Identifier: MIT", "MIT"), ('# Licensed under the Apache License, Version 2.0 (the "License");', "Apache-2.0")]
    got = {r.doc_id: r.notices for r in licenses.scan(spark.createDataFrame([(i, f"code\n{x}\ncode") for i, (x, _) in enumerate(lines)], "doc_id long, text string"), known).collect()}
    assert got == {i: k for i, (_, k) in enumerate(lines)}
    mit = next(t for k, kind, t in licenses.KNOWN if (k, kind) == ("MIT", "text")).split("\n", 2)[2]
    cases = [("MIT", mit), ("MIT", "The MIT License (MIT)\n\n" + mit)]
    files = [(k, Path("/usr/share/common-licenses") / f) for k, f in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"))]
    cases += [(k, f.read_text()) for k, f in files if f.exists()]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.scan(docs, known).collect()} == {i: k for i, (k, _) in enumerate(cases)}


def test_licenses_by_sql(spark, tmp_path):
    """The SQL over planted texts: every known text and header, with copyright lines of many kinds, wrapped lines and other spellings."""
    import duckdb

    stated = ["Copyright (c) 2024 A. Person", "copyright notice and this permission notice", "(c) Copyright Jane", "COPYRIGHT HOLDERS AND CONTRIBUTORS", "All rights reserved.", "Copyright by The Authors", "  * © 2001", "Copyright: Acme", "copyright holders be liable", "Copyright the author", "Copyright [yyyy] [name]", "Copyright"]
    texts = [f"{stated[i % len(stated)]}\n{t}" for i, (_, _, t) in enumerate(licenses.KNOWN + licenses.HEADERS)]
    texts += ["\n".join([x, "plain words", y]) for x in stated for y in stated[:3]] + [licenses.KNOWN[0][2].replace("license", "licence").upper(), None, "", "// SPDX-License-Identifier: MIT", "licence v2"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in licenses.op2_licenses(spark, str(tmp_path)).collect()}
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = set(base.execute(f"SELECT doc_id, digest, license, notices, n_notices FROM ({licenses.ORACLE})").fetchall())
    assert got == want and len({r[2] for r in want}) > 3 and len({r[3] for r in want}) > 30


# --- 3


def test_vectors(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((40, 16))
    found = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    found += [(100 + i, (base[i] + 0.03 * r.standard_normal(16)).tolist(), int(i % 3)) for i in range(30)]
    found += [(200, found[0][1], 0), (200, found[0][1], 0), (201, None, 0), (202, [0.0] * 16, 0), (203, [float("nan")] + [1.0] * 15, 0), (204, found[0][1], None), (205, [1.0, 2.0], 0), (206, [None] + [1.0] * 15, 1), (207, [2 * x for x in found[1][1]], 1)]
    found += [(1000 + i, (base[39] + 0.01 * r.standard_normal(16)).tolist(), 0) for i in range(60)]
    table = spark.createDataFrame(found, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    got = embeddings.near_vectors(table).collect()
    fine = [x is not None and len(x) > 0 and all(y is not None and math.isfinite(y) for y in x) and any(x) and k is not None for _, x, k in found]
    near = np.zeros((len(found), len(found)), dtype=bool)
    for i, j in itertools.combinations(range(len(found)), 2):
        (_, a, k), (_, b, m) = found[i], found[j]
        if fine[i] and fine[j] and k == m and len(a) == len(b):
            a, b = np.array(a), np.array(b)
            near[i, j] = near[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98
    label = [x[0] for x in found]
    while (new := [min([label[i], *(label[j] for j in np.flatnonzero(near[i]))]) for i in range(len(found))]) != label:
        label = new
    want = Counter((v, int(near[i].sum()), label[i], v == label[i]) for i, (v, _, _) in enumerate(found))
    assert Counter((x.vec_id, x.n_links, x.component_id, x.kept) for x in got) == want
    assert embeddings.near_vectors(table.limit(0)).count() == 0


def test_vector_recall_parameters():
    k, tables = embeddings.shape(5000)
    assert 1 <= k <= 12 and tables < 32
    assert embeddings.shape(10**9)[0] > k and embeddings.shape(10**9)[1] < 128 and 48 <= embeddings.least_count() < embeddings.LINES


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors_recall(spark, monkeypatch, block):
    """Many pairs close to the threshold, in a label large enough to be parted: at least 0.9 of them, in fact all but a few in ten thousand."""
    monkeypatch.setattr(embeddings, "MATES", 2)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    r = np.random.default_rng(8)
    base = r.standard_normal((1500, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turned = r.standard_normal(base.shape)
    turned -= (turned * base).sum(axis=1, keepdims=True) * base
    turned /= np.linalg.norm(turned, axis=1, keepdims=True)
    cosines = r.uniform(0.97, 0.99, (len(base), 1))
    other = cosines * base + np.sqrt(1 - cosines**2) * turned
    points = np.concatenate([base, other])
    table = spark.createDataFrame([(i, (1e200 * v if i % 7 == 0 else v).tolist(), "x") for i, v in enumerate(points)] + [(None, base[0].tolist(), "x"), (None, None, "x")], "vec_id long, embedding array<double>, label string")
    near = points @ points.T >= 0.98
    want = int(near.sum()) - len(points)
    got = embeddings.near_vectors(table).collect()
    assert sum(x.n_links for x in got if x.vec_id is not None and x.vec_id % 1500) >= 0.999 * (want - 2 * near[0].sum())
    assert len(got) == len(points) + 2 and max(x.n_links for x in got) <= 3


# --- 4


def brute_code_length(counts: dict, text: bytes, order: int) -> float:
    total = 0.0
    data = ppm.BEFORE + text
    for i in range(len(ppm.BEFORE), len(data)):
        bits, k = 0.0, order
        while True:
            seen = counts.get(data[i - k : i]) if k >= 0 else None
            if k < 0:
                bits += 8.0
                break
            if seen:
                n = sum(seen.values()) + len(seen)
                if data[i] in seen:
                    bits -= math.log2(seen[data[i]] / n)
                    break
                bits -= math.log2(len(seen) / n)
            k -= 1
        total += bits
    return total


def test_ppm_code_lengths(spark):
    texts = [("a", prose(4, 60)), ("a", "the stone"), ("b", "le château est près de la rivière. " * 9), ("b", "é" * 40)]
    model = ppm.fit(spark.createDataFrame(texts, "lang string, text string"), min_count=0, max_nodes=10**6)
    for j, lang in enumerate(model.langs):
        counts: dict = {}
        for at, t in texts:
            if at == lang:
                data = ppm.BEFORE + t.encode()
                for i in range(len(ppm.BEFORE), len(data)):
                    for k in range(ppm.ORDER + 1):
                        counts.setdefault(data[i - k : i], Counter())[data[i]] += 1
        for t in ("the stone bridge", "rivière", "zzz 日本", "q" * 300):
            got = model.code_lengths([t.encode(), b"", b"x"])[0, j]
            assert math.isclose(got, brute_code_length(counts, t.encode(), ppm.ORDER), rel_tol=1e-4)


def test_ppm_sample(spark):
    # a language of one long text, one of copies, one of many texts, one that fits
    made = [("long", "la rivière " * 2000)] + [("copies", prose(5, 900))] * 40 + [("many", prose(100 + i, 30)) for i in range(300)] + [("few", prose(6, 20))] * 2
    got: dict = {}
    for r in ppm.sample(spark.createDataFrame(made, "lang string, text string"), 3000).collect():
        got.setdefault(r.lang, []).append(r.text)
    size = {lang: sum(len(t.encode()) for t in texts) for lang, texts in got.items()}
    assert all(2990 <= size[lang] <= 3010 for lang in ("long", "copies", "many")) and got["few"] == [prose(6, 20)]
    assert len(got["long"]) == len(got["copies"]) == 1 and len(set(got["many"])) == len(got["many"])


def test_ppm_segments(spark, monkeypatch):
    model = ppm.fit(spark.createDataFrame([("a", prose(4, 400))], "lang string, text string"), min_count=2)
    text = prose(9, 500).encode()
    whole = model.code_lengths([text])
    monkeypatch.setattr(ppm, "SEGMENT", 97)
    assert np.allclose(model.code_lengths([text, b"hi"])[0], whole[0])


@pytest.mark.parametrize("n_langs", [3, 23])
def test_ppm_many_languages(spark, n_langs):
    """Invented languages, told apart by which syllables they use; very long texts; the same code lengths in any company."""
    r = random.Random(17)
    syllables = ["".join(x) for x in itertools.product("bdfgklmnprstvz", "aeiouäé", ("", "n", "s"))]
    own = {f"l{i:02}": r.sample(syllables, 30) for i in range(n_langs)}
    say = lambda lang, n: " ".join("".join(r.choices(own[lang], k=r.randint(1, 3))) for _ in range(n))
    model = ppm.fit(spark.createDataFrame([(lang, say(lang, 150)) for lang in own for _ in range(8)], "lang string, text string"))
    assert len(model.groups) == -(-n_langs // ppm.GROUP) and model.langs == sorted(own)
    held_out = [(lang, say(lang, 12)) for lang in own for _ in range(5)] + [("l01", say("l01", 120_000))]
    got = ppm.identify(spark.createDataFrame(held_out, "want string, text string"), model).collect()
    assert len(got) == len(held_out) and sum(x.want == x.lang_pred for x in got) >= 0.98 * len(got)
    assert all(x.score > 0.9 for x in got if len(x.text) > 1000)
    sizes = [sum(len({(k, key >> 8) for k, key in zip(g[1].tolist(), g[2].tolist(), strict=True)}) for g in [group]) for group in model.groups]
    assert all(n <= ppm.NODES * len(g[0]) for n, g in zip(sizes, model.groups, strict=True)) and min(sizes) > 500


def test_ppm_identify(docs, empty):
    model = ppm.fit(docs)
    got = ppm.identify(docs, model)
    assert got.columns == [*["text", *[c for c in docs.columns if c != "text"]], "lang_pred", "score", "bits_per_byte"]
    for r in got.collect():
        has = bool(re.search(r"[^\W\d_]", r.text or ""))
        assert (r.lang_pred == "und") == (not has) and 0 <= r.score <= 1
    assert ppm.identify(empty, model).count() == 0
    assert {r.lang_pred for r in ppm.identify(docs, ppm.fit(empty)).collect()} == {"und"}


# --- 5, 7

ODD = ["", None, " ", "  a", "a  b", "a \nb", "\n\n", "it's we'll", "x" * 3000, "ab" * 2000, "é🙂日本", "\x1c a", "<|endoftext|> a<|endoftext|>", " lead", "trail ", "a b", "12345 67"]


def test_bpe(spark, docs, empty):
    import tiktoken

    path = tokenizer_files.path(bpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=tokenizer_files.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    table = docs.select("doc_id", "text", "rest", F.lit(1).alias("n_tokens")).unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    got = bpe.encode_decode(table.withColumn("copy", F.col("text")), path, tokenizer_files.PATTERN, keep_ids=True).collect()
    assert len(got) == len(rows()) + len(ODD)
    for r in got:
        ids = library.encode_ordinary(r["copy"] or "")
        assert r.ids == ids and r.n_tokens == len(ids) and r.round_trip
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((r["copy"] or "").encode()).hexdigest()
    assert bpe.encode_decode(empty, path, tokenizer_files.PATTERN).count() == 0


def test_bpe_bounded_memory():
    ranks = bpe.load_ranks(tokenizer_files.path(bpe.VOCABULARY))
    small, large = bpe.Transducer(ranks, limit=50), bpe.Transducer(ranks)
    for i in range(300):
        match = prose(i, 2).replace(" ", "").encode()
        assert small.encode(match) == large.encode(match)
    assert small.last.n < large.last.n


def test_bpe_in_step_and_alone():
    import tiktoken

    path = tokenizer_files.path(bpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=tokenizer_files.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    codec, r = bpe.Codec(path, tokenizer_files.PATTERN), random.Random(7)
    # made-up words, many of each length and a few very long ones; pieces are forgotten on the way
    codec.pieces.limit, codec.transducer.limit = 500, 400
    word = lambda n: "".join(r.choice("aeiounrstéß日") for _ in range(n))
    texts = [" ".join(word(r.randint(1, 30)) + r.choice(("", ",", ".\n")) for _ in range(60)).replace(".\n ", ".\n") for _ in range(40)] + [word(20_000), "", " a  b" * 50]
    for _ in range(2):
        ids, counts = codec.pieces.of(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode_ordinary(t) for t in texts]
        for size in (7, 1 << 18):
            back = [b""] * len(texts)
            for i, data in bpe.portions(codec.bytes_of, ids, counts, size):
                back[i] += data
            assert [b.decode() for b in back] == texts


def test_pieces():
    """Texts with white space of all kinds in all places, short enough to meet each rule."""
    import tiktoken
    from tokenizers import Tokenizer

    path, other = tokenizer_files.path(bpe.VOCABULARY), tokenizer_files.path(tokenbin.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=tokenizer_files.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    r = random.Random(12)
    texts = ["".join(r.choices("ab1,'\n \t\r\u3000\0é.", (5, 5, 2, 4, 1, 8, 8, 1, 1, 1, 1, 2, 2), k=r.randint(0, 9))) for _ in range(4000)]
    ids, counts = bpe.Codec(path, tokenizer_files.PATTERN).pieces.of(pa.array(texts), 100)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode_ordinary(t) for t in texts]
    want = [e.ids for e in Tokenizer.from_file(other).encode_batch(texts, add_special_tokens=False)]
    ids, counts = tokenbin.Encoder(other).pieces.of(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_added_tokens():
    """An added token, whole and in part, beside punctuation, letters and line ends in all places."""
    from tokenizers import Tokenizer

    path = tokenizer_files.path(tokenbin.VOCABULARY)
    library, own = Tokenizer.from_file(path), tokenbin.Encoder(path)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    assert added
    r = random.Random(13)
    parts = [*added, *added, added[0][:-1], added[0][1:], "a", "Word", " ", "\n", "\n\n", ".", "|>", "<|", "é", "'s", "12"]
    texts = ["".join(r.choices(parts, k=r.randint(1, 9))) for _ in range(6000)]
    ids, counts = own.pieces.of(pa.array(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_table():
    r = np.random.default_rng(4)
    keys = np.unique(r.integers(0, 1 << 40, 20_000))
    table = bpe.Table()
    for some in np.array_split(r.permutation(keys), 7):
        table.put(some, some % 1000)
    assert (table.get(keys) == keys % 1000).all() and (table.get(keys + (1 << 41)) == -1).all()
    assert table.one(int(keys[5])) == keys[5] % 1000 and table.one(1 << 50) == -1


def test_stream_decoder():
    data = "aé🙂日本".encode()
    stream = bpe.StreamDecoder({i: bytes([i]) for i in range(256)})
    assert "".join(stream.feed_ids([b]) for b in data) + stream.close() == data.decode()


def test_tokenbin(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_files.path(tokenbin.VOCABULARY)
    library = Tokenizer.from_file(path)
    table = docs.select("doc_id", "text", "rest").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    tokenbin.write_tokens(table, str(tmp_path / "t"), path, shard_ids=700)
    got = sorted(tokenbin.read_tokens(spark, str(tmp_path / "t"), keep_ids=True).collect(), key=lambda r: r.start)
    want = sorted(((r.doc_id, r.text) for r in table.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    start = 0
    for r, (doc_id, text) in zip(got, want, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc_id, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    tokenbin.write_tokens(empty, str(tmp_path / "e"), path)
    assert tokenbin.read_tokens(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 70_000])
def test_pack(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 50_000, n), r.integers(0, 1 << 32, n), np.where(r.random(n) < 0.01, 1 << 31, 7), np.full(n, 9)):
        shard = tokenbin.pack(ids.astype(np.uint32))
        assert (tokenbin.unpack(shard) == ids).all() and (tokenbin.unpack(shard, 1, 3) == ids[1024:3072]).all()


@pytest.mark.parametrize("n, block", [(3, 64), (1000, 64), (1025, 1024), (300, 100)])
def test_pack_format(n, block):
    """Each byte of a shard as the format says, made with whole numbers of any length."""
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 50_000, n), np.where(r.random(n) < 0.01, (1 << 32) - 1, r.integers(5, 90, n)), np.full(n, 9)):
        shard = tokenbin.pack(ids.astype(np.uint32), block)
        bodies, starts = b"", [0]
        for some in (ids[i : i + block].tolist() for i in range(0, n, block)):
            base = min(some)
            over = sorted(x - base for x in some + some[-1:] * (block - len(some)))
            width = over[int(block * tokenbin.PERCENTILE / 100) - 1].bit_length()
            low = sum((x - base) % (1 << width) << width * i for i, x in enumerate(some)).to_bytes(-(-len(some) * width // 8), "little")
            high = [(i, (x - base) >> width) for i, x in enumerate(some) if (x - base) >> width]
            head = base.to_bytes(4, "little") + bytes((width, 0)) + len(high).to_bytes(2, "little")
            bodies += head + low + b"".join(i.to_bytes(2, "little") for i, _ in high) + b"".join(x.to_bytes(4, "little") for _, x in high)
            starts.append(len(bodies))
        numbers = [n, block, len(starts) - 1, *starts]
        assert shard == tokenbin.MAGIC + b"".join(x.to_bytes(4, "little") for x in numbers) + bodies
        assert (tokenbin.unpack(shard) == ids).all()


def test_pack_is_no_work_by_bits():
    """Writing and reading a shard takes about as long as laying out the bits of its ids one by one; by bits it took three times that."""
    ids = np.random.default_rng(8).integers(0, 50_000, 1 << 18).astype(np.uint32)
    bits = np.arange(16, dtype=np.uint32)

    def took(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    by_bits = lambda: [np.packbits(((some[:, None] >> bits) & np.uint32(1)).astype(np.uint8), bitorder="little") for some in ids.reshape(-1, 1024)]
    assert min(took(lambda: tokenbin.unpack(tokenbin.pack(ids))) for _ in range(7)) < 1.6 * min(took(by_bits) for _ in range(7))


# --- 6


def jaccard_links(pairs):
    sets = []
    for _, t in pairs:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return [(i, j) for i, j in itertools.combinations(range(len(pairs)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]


@pytest.mark.parametrize("blocks", [None, (8, 5, 16)])
def test_jaccard(spark, docs, empty, monkeypatch, blocks):
    if blocks:  # small leaves and blocks: every path to split them runs
        for name, value in zip(("SMALL", "DIFF_BLOCK", "VOCABULARY_BLOCK"), blocks, strict=True):
            monkeypatch.setattr(jaccard, name, value)
        monkeypatch.setattr(jaccard, "LEAF_BLOCK", 6)
    found = [(r[0], r[1]) for r in rows() if r[0] is not None]
    base = prose(11, 200).split()
    for i in range(40):
        w = list(base)
        for j in random.Random(i).sample(range(200), 2):
            w[j] = f"w{i}"
        found.append((1000 + i, " ".join(w)))
    table = spark.createDataFrame([(*x, "k", 1) for x in found], "doc_id long, text string, kept string, j_id int")
    got = Counter((r.doc_id, r.n_links, r.component_id) for r in jaccard.jaccard_join(table).collect())
    links = jaccard_links(found)
    label = [d for d, _ in found]
    while True:
        old = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if label == old:
            break
    degree = Counter(x for link in links for x in link)
    assert got == Counter((d, degree[i], label[i]) for i, (d, _) in enumerate(found))
    kept = [r.component_id for r in jaccard.jaccard_join(table).filter("kept").collect()]
    assert len(kept) == len(set(kept)) + sum(1 for c, n in Counter(kept).items() for _ in range(n - 1))
    assert jaccard.with_text(jaccard.jaccard_join(docs)).count() == len(rows()) and jaccard.jaccard_join(empty).count() == 0


# --- 8


def page(i: int, body: str) -> str:
    return f"<html><head><title>t</title></head><body><div>Home Products</div><div>{body}</div><div>Call us</div><script>var a='<p>no</p>'</script></body></html>"


def test_html(spark):
    same = "<p>Same long text of a copy that is here twice</p>"
    pages = [(i, f"http://h.example/a/{i}?q=1", page(i, f"<p>Story {i} &amp; its <b>own</b> words<p>Second {i}<br>line")) for i in range(9)]
    pages += [(20, None, None), (21, "http://x.example", ""), (22, "http://c.example/1", page(22, same)), (23, "http://c.example/2", page(23, same)), (23, "http://c.example/2", page(23, same))]
    pages += [(30, "http://m.example/1", "<nav>menu</nav><article><header><h1>T</h1></header><p>A &lt; B<div class='ad-slot'>Buy</div><p>C<form>f</form></article><footer>f"), (31, "http://m.example/2", "<p>broken <b>tag <!-- open")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, h_id int")).collect()}
    for i in range(9):
        assert got[i] == f"Story {i} & its own words\n\nSecond {i} line"
    assert got[20] == got[21] == "" and got[22] == got[23] == "Home Products\n\nSame long text of a copy that is here twice\n\nCall us"
    assert got[30] == "T\n\nA < B\n\nC" and got[31] == "broken tag"
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_keeps_what_holds_the_text():
    body = "<article><h1>T</h1><p>The whole story of the day.</p></article>"
    for name in ("layout has-sidebar", "no-sidebar", "with-comments", "post-share-enabled", "sidebar", "related"):
        assert html.page_lines(f"<body><div class='{name}'><div>{body}</div></div><div class='site-footer'>f</div></body>")[1] == ["T", "The whole story of the day."]
    assert html.page_lines(f"<body><form id=f>{body}</form></body>")[1] == ["T", "The whole story of the day."]
    marked, lines = html.page_lines("<div class='overlay'><div>" + "<p>Plain words of a page.</p>" * 9 + "<div class='share-buttons'>Share</div></div></div><div class='ad-slot'>Buy</div>")
    assert not marked and lines == ["Plain words of a page."] * 9
    teasers = "<article>One teaser</article><article>Another</article>"
    got = html.page_lines(f"<main><div>The body is in plain elements, and it is the larger part.</div>{teasers}</main><div class='related'>{teasers}</div>")[1]
    assert got == ["The body is in plain elements, and it is the larger part.", "One teaser", "Another"]
    assert html.page_lines(f"<body>{body}<div class='related'>{teasers * 9}</div><div class='comments'><article>c</article></div></body>")[1] == ["T", "The whole story of the day."]
    assert html.page_lines("<article><p>One <span class='share'>Share</span>two</p><div class='related-posts'>r</div></article>")[1] == ["One two"]


def texts_of(spark, pages):
    return {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_html_templates(spark, monkeypatch):
    notice = "<div>A notice of the house that stands on each page and is longer than all else on it</div>"
    story = lambda i: f"<p>Short story {i}, in some own words</p>"
    copy = page(0, "<p>Long text of a copy in a run</p><p>and more of it</p>")
    # a run of copies between other pages of the host, and short pages with a long template
    pages = [(i, f"http://r.example/{i:02}", copy if 3 <= i < 17 else page(i, story(i))) for i in range(20)]
    pages += [(100 + i, f"http://s.example/{i:02}", page(i, notice + story(i))) for i in range(20)]
    # near copies: each has one changed line
    lines = [f"Paragraph {k} of a text that was copied" for k in range(9)]
    changed = ["".join(f"<p>{x}{' edited' if k == i else ''}</p>" for k, x in enumerate(lines)) for i in range(9)]
    pages += [(200 + i, f"http://n.example/{i}", page(i, changed[i])) for i in range(9)]
    monkeypatch.setattr(html, "BLOCK", 7)
    got = texts_of(spark, pages)
    assert all(got[i] == ("Long text of a copy in a run\n\nand more of it" if 3 <= i < 17 else f"Short story {i}, in some own words") for i in range(20))
    assert all(got[100 + i] == f"Short story {i}, in some own words" for i in range(20))
    assert all(all(x in got[200 + i] for x in lines) for i in range(9))


def test_html_templates_in_articles(spark):
    article = lambda *lines: "<nav>menu</nav><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article>"
    story = lambda i: f"Story {i} of the day, which is told in {i} words"
    pages = [(i, f"http://h.example/{i}", article(story(i), "Subscribe to our letter", f"End {i}")) for i in range(9)]
    pages += [(20 + i, f"http://two.example/{i}", article(story(i), "A line that two have")) for i in range(2)]
    pages += [(30 + i, f"http://copies.example/{i}", article(*[story(k) + "!" * (k == i) for k in range(9)])) for i in range(9)]
    got = texts_of(spark, pages)
    assert all(got[i] == f"{story(i)}\n\nEnd {i}" for i in range(9))
    assert all(got[20 + i] == f"{story(i)}\n\nA line that two have" for i in range(2))
    assert all(got[30 + i] == "\n\n".join(story(k) + "!" * (k == i) for k in range(9)) for i in range(9))


@pytest.mark.parametrize("bits", [1 << 27, 10])
def test_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(html, "AT_ONCE_BITS", bits)
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        found = sorted(html.common_subsequence(a, b))
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in rest for i in found)  # in order in b too


def test_common_subsequence_of_many_lines():
    """Repeated lines of long pages: time that grows with the product of lengths, but 64 pairs of lines at a time."""
    a, b = [1, *[7, 8] * 4000, 2], [3, *[7, 7, 8] * 3000, 4]
    assert len(html.common_subsequence(a, b)) == 7000  # of 3000 triples 1000 take two pairs of lines, and the others one
    assert len(html.common_subsequence([7] * 100_000, [7] * 90_000)) == 90_000


def longest_common(a: tuple, b: tuple) -> set:
    """Places in ``a`` of the longest common subsequence: heads and tails first, and of equal ones the last places."""
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    tail = 0
    while tail < min(len(a), len(b)) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, j in itertools.product(range(len(x)), range(len(y))):
        table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
    found, i, j = {*range(head), *range(len(a) - tail, len(a))}, len(x), len(y)
    while i and j:
        if table[i][j] == table[i][j - 1]:
            j -= 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.add(head + i)
    return found


def lines_of_templates(marked: bool, lines: tuple, others: list) -> set:
    shares = [longest_common(lines, x) for x in others]
    length = lambda places: sum(len(lines[i]) for i in places)
    near = [s for s in shares if 2 * length(s) > length(range(len(lines)))]
    far = [(s, x) for s, x in zip(shares, others, strict=True) if 2 * length(s) <= length(range(len(lines)))]
    votes = {i: [x for s, x in far if i in s] for i in range(len(lines))}
    if marked:
        often = {i for i, by in votes.items() if len(by) >= 4 and len(by) >= 0.75 * len(far)}
        out = set()
        for i in often:
            texts: list = []
            for x in votes[i]:
                rest = set(x) - {lines[k] for k in often}
                if all(2 * len(rest & t) <= min(len(rest), len(t)) for t in texts):
                    texts.append(rest)
            if len(texts) >= 4:
                out.add(i)
        return out
    if any(votes.values()):
        return {i for i, by in votes.items() if len(by) >= min(2, len(far))}
    if len(near) > 1:
        common, some = set.intersection(*near), set.union(*near)
        own = length(range(len(lines))) - length(some)
        if 10 * own >= length(range(len(lines))) and 2 * length(some - common) <= own:
            return common
    return set()


def test_html_of_many_tags():
    """Pages of very many tags that close nothing, that are never closed, or that close each other, in time in proportion to them."""
    n = 60_000
    for page_html in ("<b>" * n + "</i>" * n, "<b>" * n + "<p>x</p>" * n, "<li><div>" + "<b>" * n + "<li>x</li>" * n, "<div class=ad>x" * n, "<table><tr><td>" * n, "<a <a " * n + '"', "<ul>" + "<li>a" * n):
        began = time.process_time()
        html.page_lines(page_html + "<p>The end")
        assert time.process_time() - began < 15
    assert html.page_lines("<ul><li>a<li>b<p>c<p>d</ul>e <i>f</b> g</i>")[1] == ["a", "b", "c", "d", "e f g"]


def test_html_against_brute_force(spark, monkeypatch):
    """The whole operator: hosts, copies and neighbours found by plain loops over all pages."""
    r = random.Random(21)
    notes = [f"A line {k} that the house puts on some of its pages" for k in range(6)] + ["On nearly all pages"]
    pages = []
    for i in range(160):
        host = r.choice(("a.example", "b.example", "B.example"))
        lines = [x for x in notes if r.random() < (0.95 if x is notes[6] else 0.5)] + [f"Story {i if r.random() < 0.8 else 0}, part {k}, told in its own words" for k in range(r.randint(1, 4))] + [x for x in notes[:2] if r.random() < 0.3]
        if r.random() < 0.2 and pages:
            lines = r.choice(pages)[3]
        body = "".join(f"<p>{x}</p>" for x in lines)
        pages.append((i, f"http://{host}/{r.randint(0, 9)}/{i:03}?q={i}", f"<body><nav>menu</nav>{f'<article>{body}</article>' if i % 3 else body}</body>", lines))
    monkeypatch.setattr(html, "BLOCK", 9)
    groups: dict = {}
    for i, url, _, lines in pages:  # an article, or blocks of a page without one
        host, path = url.split("?")[0].removeprefix("http://").split("/", 1)
        groups.setdefault((host.lower(), bool(i % 3), tuple(lines)), []).append(("/" + path, i))
    order = sorted((host, min(of), marked, lines) for (host, marked, lines), of in groups.items())
    want, decided = {}, Counter()
    for at, (host, _, marked, lines) in enumerate(order):
        others = [x[3] for k, x in enumerate(order) if k != at and abs(k - at) <= html.NEAR and x[0] == host]
        gone = lines_of_templates(marked, lines, others)
        decided[marked] += len(gone)
        for _, i in groups[host, marked, lines]:
            want[i] = "\n\n".join(x for k, x in enumerate(lines) if k not in gone)
    got = texts_of(spark, [p[:3] for p in pages])
    assert got == want and decided[True] > 20 and decided[False] > 20


# --- 9


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, g in zip(t, mask, strict=True) if not g)
        out.append((len(t), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("many", [5000, 1])
def test_repeats(spark, docs, empty, many):
    found = [(r[0], r[1]) for r in rows() if r[0] != 12]
    shared = prose(20, 70)
    found += [(300 + i, prose(30 + i, 15) + shared[: 150 + 10 * i] + prose(60 + i, 15)) for i in range(20)]
    found += [(400, "ab" * 400), (401, "abc" * 300 + prose(5, 40)), (402, shared[:199]), (403, shared[:200]), (404, shared[:200] * 2)]
    table = spark.createDataFrame([(*x, "r", "k") for x in found], "doc_id long, text string, r_text string, kept string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeats(table, many=many).collect())
    want = Counter((d, *w) for (d, _), w in zip(found, brute_repeats([(t or "").encode() for _, t in found], 200), strict=True))
    assert got == want
    whole = repeats.repeats(docs, characters=True).collect()
    assert len(whole) == len(rows()) and all(bytes(r.kept).decode() is not None for r in whole)
    assert repeats.repeats(empty).count() == 0


def test_anchors_of_long_texts(monkeypatch):
    text = prose(8, 4000).encode()
    places, hashes = repeats.anchors([text])[0]
    monkeypatch.setattr(repeats, "PORTION", 1000)
    short_places, short_hashes = repeats.anchors([b"x" * 500, text])[1]
    assert (places == short_places).all() and (hashes == short_hashes).all()


# --- 10


def test_quality(docs, empty):
    got = quality.quality(docs)
    assert len(set(got.columns)) == len(got.columns)
    for r in got.collect():
        w = words(r.text)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {p for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(repeated))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality(empty).count() == 0


def test_quality_with_equal_hashes(spark, monkeypatch):
    """Windows that differ and have equal hashes are no repeats: with a hash that tells nothing the counts are the same."""
    texts = [prose(i, 150) for i in range(6)] + ["a b c d a b c", "a a a a", "x y z", "a b c x a b d"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.n_repeat_words for r in quality.quality(table).collect()}
    monkeypatch.setattr(quality.F, "xxhash64", lambda *_: F.lit(5).cast("long"))
    assert {r.doc_id: r.n_repeat_words for r in quality.quality(table).collect()} == want


# --- components


def test_components(spark):
    from corvine.llm.components import components

    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200) if i % 50 != 49] + [(r.randint(300, 400), r.randint(300, 400)) for _ in range(80)] + [(500, 500 + i) for i in range(1, 90)]
    label = {x: x for e in edges for x in e}
    while True:
        old = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            break
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: label[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
