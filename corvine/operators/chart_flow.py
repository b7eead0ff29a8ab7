"""Pages with features to analysed charts: rules, batches for a vision provider, parsing, one chart a title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.config import DEFAULTS
from corvine.functions import text as X
from corvine.operators.workflow import batches, called


class OfflineVision:
    """Describes each page of a batch by its number; None for a batch stands for a call that failed."""

    def describe(self, pages) -> str | None:
        return "".join(f"---CHART {i + 1}---\n**Title**: Chart {p % 3}\n**Page**: {p}\n" for i, p in enumerate(pages))


def analysed(charts: DataFrame, provider=None, size: int = 4, least: float = DEFAULTS.CHART_MIN_CONFIDENCE) -> DataFrame:
    """(file, page, has_chart, confidence) -> (file, page, batch, analysis). A failed call drops its batch.

    Only pages that pass the cheap rules reach the provider.
    """
    kept = charts.filter(F.col("has_chart") & (F.col("confidence") >= least)).select("file", "page")
    groups = batches(kept, "file", "page", size).groupBy("file", "batch").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    told = groups.withColumn("response", called(provider or OfflineVision(), "describe", "string", F.col("pages"))).filter("response IS NOT NULL")
    return told.select("file", "batch", "response", F.posexplode("pages").alias("i", "page")).select("file", "page", "batch", X.response_part(F.col("response"), F.col("i")).alias("analysis"))


def one_a_title(analyses: DataFrame) -> DataFrame:
    """The first page of each title of a file; analyses without a title all stay."""
    rows = analyses.withColumn("title", X.title(F.col("analysis")))
    first = rows.filter("title IS NOT NULL").groupBy("file", "title").agg(F.min(F.struct("page", "batch", "analysis")).alias("f")).select("file", "f.*", "title")
    return first.unionByName(rows.filter("title IS NULL"))
