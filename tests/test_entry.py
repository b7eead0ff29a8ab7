"""The registered queries: names, a flagship run, and each against its SQL on the smallest tables."""

from __future__ import annotations

import os
import re
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from corvine.plans import queries as plans

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="the given tables are not here")


def plain(value):
    if isinstance(value, float):
        return "None" if value != value else repr(float(value))
    if hasattr(value, "__len__") and not isinstance(value, str):
        return repr([plain(x) for x in value])
    return "None" if value is None else str(value)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", "doc_identity content_dedup incremental_changed bm25_topk rrf_fusion mmr_rerank chart_rules verdict_parse rate_limit_day table_markdown highlight_context file_hash_set chunk_batches docset_hash document_digest verdict_structured question_parts vector_store prompt_kinds chart_flow_titles".split())
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for file in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL / file}'")
    got, want = plans.QUERIES[name](spark, str(SMALL)).toPandas(), db.execute(plans.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda frame: sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_bm25_stats_of_every_term(spark):
    import duckdb
    import pyarrow.parquet as pq

    found = Counter()
    for text in pq.read_table(SMALL / "documents.parquet", columns=["text"]).column(0).to_pylist():
        found.update({w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w})
    got = plans.QUERIES["bm25_stats"](spark, str(SMALL)).toPandas()
    assert list(got.columns) == ["term", "df", "idf"]
    assert len(got) == len(found) and dict(zip(got.term, got.df, strict=True)) == found
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL / 'documents.parquet'}'")
    want = db.execute(plans.SQL["bm25_stats"]).df()
    rows = lambda frame: sorted(tuple(map(plain, r)) for r in frame[["term", "df", "idf"]].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["context_concat", "highlight_context"])
def test_contexts_leave_texts_in_place(spark, name):
    """Where documents are too large to be sent to all, the few best are: no text is shuffled (F6, F7)."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        plan = plans.QUERIES[name](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [doc" in plan and "SortMergeJoin [doc" not in plan
