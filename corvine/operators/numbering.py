"""Row numbers without gaps over any number of rows, so that no task sorts a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Into how many equal parts the range of the order is cut.
PARTS = 65_536


def numbered(rows: DataFrame, key: str | None, order: str, ties: tuple = (), name: str = "at", parts: int = PARTS) -> DataFrame:
    """Adds ``name``: the place of each row of a key, from 0, in the order of a whole number and then of ``ties``; nulls come first.

    The range of ``order`` is cut into parts. Places are counted within (key, part), and each part begins where the ones
    before it end, which is a running sum over at most ``parts`` counts a key. Two numbers, the ends of the range, come to
    the driver. Only a part in which very many rows lie together is sorted in one task.
    """
    ends = rows.agg(F.min(order).cast("long").alias("low"), F.max(order).cast("long").alias("high")).first()
    low, width = ends["low"] or 0, max(1, -(-((ends["high"] or 0) - (ends["low"] or 0) + 1) // parts))
    key_of = F.lit(0) if key is None else F.struct(key)  # a struct of a null is no null
    part = F.coalesce(F.floor((F.col(order).cast("decimal(20,0)") - low) / width).cast("int"), F.lit(-1))
    rows = rows.withColumns({"_key": key_of, "_part": part})
    counts = rows.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_key", "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_key", "_part").orderBy(order, *ties)) - 1
    return rows.withColumn("_within", within).join(starts, ["_key", "_part"]).withColumn(name, F.col("_start") + F.col("_within")).drop("_key", "_part", "_start", "_within")
