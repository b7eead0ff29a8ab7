"""Hashes and ids of files, chunks and sets of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.operators.numbering import numbered


def sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def stable_source(path: Column, file_hash: Column) -> Column:
    """The base name of a path with the hash of the file."""
    return F.concat(basename(path), F.lit("::"), file_hash)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def chunk_id(file_hash: Column, page: Column, seq: Column) -> Column:
    return F.concat(F.lit("txt_"), file_hash, F.lit("_"), page.cast("string"), F.lit("_"), seq.cast("string"))


def doc_key(source: Column, page: Column, chunk: Column, content: Column) -> Column:
    """The id of a chunk: its metadata, absent parts empty, and the first 16 digits of its content's hash."""
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in (source, page, chunk)]
    return F.sha2(F.concat_ws("::", *parts, F.substring(sha256(F.coalesce(content, F.lit(""))), 1, 16)), 256)


def document_digest(content: Column, metadata: Column) -> Column:
    """The hash of a content and its metadata (a map), keys in order, no sign between them; null values are empty."""
    entries = F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(e["key"], F.coalesce(e["value"].cast("string"), F.lit(""))))
    return sha256(F.concat(F.coalesce(content, F.lit("")), F.array_join(entries, "")))


def meta(metadata: Column, key: str, default: str = "") -> Column:
    """What a map has at a key, or the default."""
    return F.coalesce(F.try_element_at(metadata, F.lit(key)), F.lit(default))


def set_hash(docs: DataFrame, order: str, digest: str, fan: int = 1000) -> DataFrame:
    """One hash of a set of documents in the order of a whole number, as a tree of hashes over runs of ``fan``.

    Documents are numbered without gaps, so each level is a thousandth of the one before whatever the numbers are, and
    levels are added until one run is left. No task holds more than a run. An empty set has the hash of an empty text.
    """
    rows = docs.select(F.col(order).alias("order"), F.col(digest).alias("h"))
    level, n = numbered(rows, None, "order", ("h",)), rows.count()
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), ""), 256)
    while True:
        level, n = level.groupBy(F.floor(F.col("at") / fan).alias("at")).agg(joined.alias("h")), -(-n // fan)
        if n <= 1:
            return level.agg(F.coalesce(F.min("h"), F.sha2(F.lit(""), 256)).alias("set_hash"))
