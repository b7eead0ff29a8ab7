"""Sets of documents kept with a tree of hashes, and their difference, for which only what has changed is read.

A document's place in the tree is given by the hash of its id: a node of level l has the documents whose hash begins with the
same 4 * l bits. So a document that comes, goes or changes touches one leaf and the nodes above it, whatever the number of
others. A kept set is a folder with ``rows`` (place, id, digest), sorted by place, and ``nodes`` (level, place, hash, n).
There are as many levels as leave about ``LEAF`` documents in a leaf.

Two sets are compared from the root down: children are looked at only where their parents differ, and rows are read only for
leaves that differ. A set that has outgrown the depth of the other (sixteen times as many documents) is compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents in a leaf; leaves that are told to the scan one by one, so that it can leave out row groups.
LEAF, NAMED = 1000, 1000
DIGITS = 16


def _place(hashed: Column, level: int) -> Column:
    """The first 4 * level bits; 0 for the root."""
    return F.call_function("shiftrightunsigned", hashed, F.lit(64 - 4 * level)) if level else F.lit(0).cast("long")


def keep(docs: DataFrame, path: str, leaf: int = LEAF) -> None:
    """Writes a set of (id, digest) with its tree. Null digests are empty ones; ids may repeat."""
    spark, levels = docs.sparkSession, 1
    while docs.count() > leaf * DIGITS**levels and levels < 8:
        levels += 1
    rows = docs.select(_place(F.xxhash64("id"), levels).alias("place"), "id", F.coalesce("digest", F.lit("")).alias("digest"))
    rows.repartitionByRange("place").sortWithinPartitions("place", "id").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    # a leaf's rows are few, and the order of ids and digests makes its hash that of a set
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "digest"))), lambda x: F.to_json(x)), "\n")
    nodes = rows.groupBy("place").agg(F.sha2(listed, 256).alias("hash"), F.count("*").alias("n")).withColumn("level", F.lit(levels))
    nodes.select("level", "place", "hash", "n").write.parquet(f"{path}/nodes")
    for level in range(levels - 1, -1, -1):
        below = spark.read.parquet(f"{path}/nodes").filter(F.col("level") == level + 1)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: F.concat(F.hex(x["place"]), F.lit(" "), x["hash"])), "\n")
        up = F.shiftright("place", 4) if level else F.lit(0).cast("long")
        above = below.groupBy(up.alias("place")).agg(F.sha2(joined, 256).alias("hash"), F.sum("n").alias("n")).withColumn("level", F.lit(level))
        above.select("level", "place", "hash", "n").write.mode("append").parquet(f"{path}/nodes")


def root(spark: SparkSession, path: str) -> str:
    """One hash of the whole set; that of an empty set is empty."""
    found = spark.read.parquet(f"{path}/nodes").filter("level = 0").first()
    return found.hash if found else ""


def changed_leaves(spark: SparkSession, before: str, after: str) -> tuple[int, DataFrame]:
    """The lowest level that both trees have, and its places (place) where they differ."""
    a, b = (spark.read.parquet(f"{x}/nodes") for x in (before, after))
    deepest = [x.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0] for x in (a, b)]
    if 0 in deepest:  # a set without documents: all leaves of the other
        return max(deepest), a.unionByName(b).filter(F.col("level") == max(deepest)).select("place")
    differ = None
    for level in range(min(deepest) + 1):
        mine, theirs = (x.filter(F.col("level") == level).select("place", F.col("hash").alias(name)) for x, name in ((a, "h_a"), (b, "h_b")))
        if differ is not None:
            children = differ.select(F.explode(F.sequence(F.col("place") * DIGITS, F.col("place") * DIGITS + (DIGITS - 1))).alias("place"))
            mine, theirs = mine.join(children, "place", "left_semi"), theirs.join(children, "place", "left_semi")
        differ = mine.join(theirs, "place", "full").filter("NOT h_a <=> h_b").select("place")
    return min(deepest), differ


def difference(spark: SparkSession, before: str, after: str) -> DataFrame:
    """(id, change): 'new', 'gone' or 'changed', for ids that are in one set only or with other digests."""
    level, differ = changed_leaves(spark, before, after)
    few = [r.place for r in differ.limit(NAMED + 1).collect()]

    def read(path: str, name: str) -> DataFrame:
        rows = spark.read.parquet(f"{path}/rows")
        own = spark.read.parquet(f"{path}/nodes").agg(F.coalesce(F.max("level"), F.lit(level))).first()[0]
        shift = 4 * (own - level)
        if len(few) <= NAMED and not shift:  # places that the scan can tell from the ends of row groups
            rows = rows.filter(F.col("place").isin(few) if few else F.lit(False))
        else:
            rows = rows.withColumn("at", F.call_function("shiftrightunsigned", F.col("place"), F.lit(shift))).join(differ.withColumnRenamed("place", "at"), "at", "left_semi")
        return rows.groupBy("id").agg(F.array_sort(F.collect_list("digest")).alias(name))

    a, b = read(before, "a").withColumnRenamed("id", "id_a"), read(after, "b").withColumnRenamed("id", "id_b")
    both = a.join(b, F.col("id_a").eqNullSafe(F.col("id_b")), "full").filter("NOT a <=> b")
    return both.select(F.coalesce("id_a", "id_b").alias("id"), F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").otherwise("changed").alias("change"))
