"""Pages of files that a provider reads: text and tables to documents, images to chart decisions.

No parser or renderer is installed, so each is a provider, an object with one method that maps a file's bytes to what is on
its pages. It runs in tasks, a file at a time; all that follows is expressions over rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions import charts as C
from corvine.functions import identity as I
from corvine.functions import tables as M
from corvine.functions.text import strip
from corvine.operators.workflow import called

#: Pages that are rendered in one call.
RANGE = 20


def read_pages(files: DataFrame, reader) -> DataFrame:
    """(path, content) -> (path, file_hash, page from 1, text, tables) by ``reader.pages(content)``, which gives (text, tables) of each page.

    A file that the reader fails on has no pages.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, digest, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = list(reader.pages(content))
                except Exception:  # whatever a parser raises
                    found = []
                columns = [[path] * len(found), [digest] * len(found), range(1, len(found) + 1), [t for t, _ in found], [x for _, x in found]]
                types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.list_(pa.string()))))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=["path", "file_hash", "page", "text", "tables"])

    rows = files.select("path", F.sha2("content", 256).alias("file_hash"), "content")
    return rows.mapInArrow(run, "path string, file_hash string, page int, text string, tables array<array<array<string>>>")


def documents(pages: DataFrame, loader: str = "provider") -> DataFrame:
    """(path, file_hash, page, text, tables) -> a document of each page that has a table or a text.

    Of equal tables of a page the first counts, and only those of two rows or more. They are numbered through the file,
    and ``tables_count`` is how many it has up to here.
    """
    kept = F.array_distinct(F.filter(F.coalesce("tables", F.array().cast("array<array<array<string>>>")), lambda t: F.size(t) >= 2))
    before = Window.partitionBy("path", "file_hash").orderBy("page")
    rows = pages.withColumn("kept", kept).withColumn("tables_count", F.sum(F.size("kept")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.col("tables_count") - F.size("kept") + 1
    shown = F.filter(F.transform("kept", lambda t, i: M.markdown(t, first + i, F.col("page"))), lambda x: x != "")
    text = strip(F.coalesce("text", F.lit("")))
    parts = F.concat(shown, F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>")))
    head = F.concat(F.lit("## Page "), F.col("page").cast("string"))
    rows = rows.withColumn("parts", parts).filter(F.size("parts") > 0)
    return rows.select(
        I.stable_source(F.col("path"), F.col("file_hash")).alias("source"), "page", F.lit(loader).alias("loader"), "tables_count", F.lit("text").alias("type"),
        I.chunk_id(F.col("file_hash"), F.col("page"), F.lit(0)).alias("chunk_id"), "file_hash", F.array_join(F.concat(F.array(head), "parts"), "\n\n").alias("content"),
    )


def ranges(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, n_pages, ...) -> those and (first, last), a row for each range of pages."""
    starts = F.when(F.col("n_pages") > 0, F.sequence(F.lit(1), F.col("n_pages"), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return files.withColumn("first", F.explode(starts)).withColumn("last", F.least(F.col("first") + size - 1, F.col("n_pages")))


def images(page_ranges: DataFrame, renderer) -> DataFrame:
    """(path, content, first, last) -> (path, page, image) by ``renderer.render(content, first, last)``; images are a column, no files."""
    rows = page_ranges.repartition("path", "first").withColumn("found", called(renderer, "render", "array<binary>", F.col("content"), F.col("first"), F.col("last")))
    return rows.select("path", "first", F.posexplode("found").alias("at", "image")).select("path", (F.col("first") + F.col("at")).alias("page"), "image")


def charts(page_images: DataFrame, detector) -> DataFrame:
    """Adds has_chart, confidence, chart_types and rejected to page images, in the same row: ``detector.features`` of the image, and then the rules."""
    kinds = ", ".join(f"{x} {'double' if x == 'angle_var' else 'boolean' if x in ('bar_pattern', 'text_region') else 'int'}" for x in C.FEATURES)
    kept = [F.col(c) for c in page_images.columns]
    rows = page_images.withColumn("f", F.from_json(called(detector, "features", "string", F.col("image")), kinds)).select(*kept, "f.*")
    return rows.withColumn("v", C.verdict()).select(*kept, "v.*")
