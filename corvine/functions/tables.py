"""Raw tables (arrays of rows of nullable cells) to markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvine.functions.text import strip


def clean_cell(cell: Column) -> Column:
    flat = F.replace(F.regexp_replace(F.coalesce(cell, F.lit("")), r"[\n\r]", " "), F.lit("|"), F.lit("\\|"))
    return strip(flat)


def clean_rows(table: Column) -> Column:
    """Cleaned rows without those that are empty."""
    rows = F.transform(F.coalesce(table, F.array().cast("array<array<string>>")), lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), clean_cell))
    return F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))


def markdown(table: Column, index: Column, page: Column) -> Column:
    """A heading, the first row as header, a rule and the other rows, all padded to the widest; empty if no row is left."""

    def of(rows: Column) -> Column:
        width = F.array_max(F.transform(rows, F.size))
        line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
        padded = F.transform(rows, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int")))))
        head = F.concat(F.lit("### Table "), index.cast("string"), F.lit(" (Page "), page.cast("string"), F.lit(")"))
        rest = F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(0)))
        all_lines = F.concat(F.array(head, padded[0], line(F.array_repeat(F.lit("---"), width))), rest)
        return F.when(F.size(rows) > 0, F.array_join(all_lines, "\n")).otherwise(F.lit(""))

    return F.transform(F.array(clean_rows(table)), of)[0]
