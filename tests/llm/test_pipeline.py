"""The stages of the pipeline, each held against brute force on its own input, and what a run leaves behind."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline as pipeline  # noqa: E402
from corvine.llm import bpe, mix, ppm  # noqa: E402
from corvine.llm.common import CLEANUP  # noqa: E402

from test_operators import brute_code_length, jaccard_links, prose, rows, words  # noqa: E402

#: The columns of ``documents``, and others called as what operators add.
EXTRA = "lang_pred string, score string, bits_per_byte string, kept string, j_text string, j_id string, n_links string, component_id string, spans string, m_row string, m_time string, size string, repeats string, rest string, p_rest string"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
OTHERS = tuple(f"own {x.split()[0]}" for x in EXTRA.split(", "))


def given() -> list[tuple]:
    french = "le château est près de la rivière et la maison du roi est là "
    made = [(r[0], r[1], r[2], r[3], len(r[1] or ""), *OTHERS) for r in rows()]
    made += [(500 + i, prose(500 + i, 80), "en", f"s{i % 4}", 0, *OTHERS) for i in range(40)]
    made += [(600 + i, french * (3 + i % 4) + str(i), "fr", "s2", 0, *OTHERS) for i in range(12)]
    made += [(700 + i, "".join(chr(random.Random(i).randint(0x4E00, 0x9FFF)) for _ in range(300)), None, None, 0, *OTHERS) for i in range(3)]
    return made


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline") / "documents.parquet")
    spark.createDataFrame(given(), COLUMNS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def result(spark, stage: int, docs):
    out = pipeline.STAGES[stage][1](spark, docs, "")
    assert stage == 4 or out.columns == docs.columns
    return out.collect()


def own_values(found) -> bool:
    return all(tuple(r[5:]) == OTHERS for r in found)


def test_language(spark, docs):
    learned = [(r[1], r[2]) for r in given() if r[1] is not None and r[2] and zlib_fold(r[0]) != 2]
    counts: dict[str, dict] = {}
    total: Counter = Counter()
    for text, lang in dict.fromkeys(learned):
        data = ppm.BEFORE + text.encode()
        for i in range(len(ppm.BEFORE), len(data)):
            for k in range(ppm.ORDER + 1):
                counts.setdefault(lang, {}).setdefault(data[i - k : i], Counter())[data[i]] += 1
                total[data[i - k : i]] += 1
    counts = {lang: {c: n for c, n in own.items() if not c or total[c] >= ppm.MIN_COUNT} for lang, own in counts.items()}
    want = Counter()
    for r in given():
        if re.search(r"[^\W\d_]", r[1] or ""):
            bits = {lang: brute_code_length(own, r[1].encode()[:20_000], ppm.ORDER) for lang, own in counts.items()}
            best = min(sorted(bits), key=bits.__getitem__)
            if bits[best] / len(r[1].encode()[:20_000]) < pipeline.MOST_BITS:
                want[r[0], r[1], best] += 1
    found = result(spark, 0, docs)
    assert Counter((r.doc_id, r.text, r.lang) for r in found) == want and own_values(found)
    assert {r[0] for r in given() if 500 <= (r[0] or 0) < 700} <= {r.doc_id for r in found} and not {700, 701, 702} & {r.doc_id for r in found}


def zlib_fold(doc_id) -> int:
    import zlib

    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 4


def test_near_duplicates(spark, docs):
    table = given()
    links = jaccard_links([(r[0], r[1]) for r in table])
    group = list(range(len(table)))
    while True:
        old = list(group)
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
        if group == old:
            break
    found = result(spark, 1, docs)
    left = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in found)
    text_of = lambda i: (table[i][0], table[i][1] or "", *table[i][2:5])
    for g in set(group):
        assert sum(left[text_of(i)] for i in {text_of(i): i for i in range(len(table)) if group[i] == g}.values()) == 1 or not words(table[g][1])
    assert len(found) == len(set(group)) and own_values(found)


def test_repeated_passages(spark, docs):
    table = [r for r in given() if r[0] != 12]  # the long text takes brute force too long
    texts = [(r[1] or "").encode() for r in table]
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = Counter()
    for r, t in zip(table, texts, strict=True):
        gone = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept, at = "", 0
        for c in r[1] or "":
            size = len(c.encode())
            kept += "" if gone[at : at + size].all() else c
            at += size
        want[r[0], kept, len(kept), r[2], r[3]] += 1
    found = result(spark, 2, docs.filter("doc_id IS NULL OR doc_id <> 12"))
    assert Counter((r.doc_id, r.text, r.n_chars, r.lang, r.source) for r in found) == want and own_values(found)


def test_mixture(spark, docs):
    size: Counter = Counter()
    for r in given():
        size[r[3]] += len(words(r[1]))
    weight = dict(zip(sorted((s for s in size if s), key=str.encode) + [None], itertools.cycle((5.0, 2.0, 1.0)), strict=False))
    capped: set = set()
    while True:
        free = [s for s in size if s not in capped]
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        if not (more := {s for s in free if level * weight[s] > 2 * size[s]}):
            break
        capped |= more
    found = result(spark, 3, docs)
    rows_of = Counter((r[0], r[1], r[3]) for r in given())
    got = Counter((r.doc_id, r.text, r.source) for r in found)
    assert all(n <= 2 * rows_of[k] for k, n in got.items()) and own_values(found)
    taken, largest = Counter(), Counter()
    for (_, text, source), n in got.items():
        taken[source] += n * len(words(text))
        largest[source] = max(largest[source], len(words(text)))
    for s in size:
        assert abs(taken[s] - (2.0 * size[s] if s in capped else level * weight[s])) <= max(largest[s], max(len(words(r[1])) for r in given() if r[3] == s)) / 2 + 1
    again = result(spark, 3, docs.repartition(5))
    assert Counter((r.doc_id, r.text, r.source) for r in again) == got


def test_tokens(spark, docs):
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    want = Counter()
    for r in given():
        ids = library.encode_ordinary(r[1] or "")
        want[r[0], r[2], r[3], len(ids), tuple(ids), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in result(spark, 4, docs)) == want


def test_empty(spark):
    empty = spark.createDataFrame([], COLUMNS)
    for stage in range(5):
        assert result(spark, stage, empty) == []


def test_run(spark, docs, tmp_path):
    docs.drop(*[x.split()[0] for x in EXTRA.split(", ")]).write.parquet(str(tmp_path / "documents.parquet"))
    opened = mix.op1_mix(spark, str(tmp_path))
    before = spark.conf.get(CLEANUP, None)
    first, second = pipeline.run(spark, str(tmp_path)), pipeline.run(spark, str(tmp_path))
    assert spark.conf.get(CLEANUP, None) == before
    assert opened.count() == len(given())  # other queries' tables are still there
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in first.collect())
    assert got and got == sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in second.collect())
    # the same as stage by stage
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, table, str(tmp_path)).write.parquet(str(tmp_path / f"stage-{i}"))
        table = spark.read.parquet(str(tmp_path / f"stage-{i}"))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in pipeline.STAGES[-1][1](spark, table, "").collect()) == got
    assert first.agg(F.count("*")).first()[0] == len(got)
