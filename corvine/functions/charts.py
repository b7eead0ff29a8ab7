"""Chart decisions from image features, as one expression; and geometry of lines and images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the features that the rules read.
FEATURES = "lines diag circles rects horizontal vertical angle_var bar_pattern large color_peaks text_region very_short small_scattered".split()


# The thresholds and the order of the bonuses below are fixed values.
def verdict() -> Column:
    """(has_chart, confidence, chart_types sorted, rejected) from columns named as ``FEATURES``."""
    f = {x: F.col(x) for x in FEATURES}
    zero = F.lit(0.0)
    axis = (f["horizontal"] >= 1) | (f["vertical"] >= 1)
    slide = f["text_region"] & (f["circles"] < 2) & (f["diag"] < 2) & ~f["bar_pattern"] & ((f["small_scattered"] > 100) | (f["very_short"] > 50))
    network = (f["very_short"] > 50) & (f["circles"] < 2) & (f["diag"] < 3) & (f["lines"] < 10)
    grid_share = (f["horizontal"] + f["vertical"]) / F.greatest(f["lines"], F.lit(1))
    grid = (f["horizontal"] > 12) & (f["vertical"] > 12) & (f["circles"] == 0) & (f["diag"] < 2) & (grid_share > 0.75)
    rejected = F.when(slide, "text_slide").when(network, "background").when(grid, "table")

    is_line = ((f["diag"] >= 2) & (f["angle_var"] > 40)) | ((f["diag"] >= 1) & axis)
    is_bubble = f["circles"] >= 5
    is_zone = is_bubble & (f["large"] > 2)
    is_scatter = ~is_bubble & (f["circles"] >= 3) & (f["diag"] > 2)
    is_pie = (f["circles"] > 0) & (f["circles"] < 5)
    is_bar = f["bar_pattern"] & (f["rects"] >= 6)
    is_complex = (f["circles"] >= 3) & (f["large"] >= 2) & (f["color_peaks"] > 5)
    line_start = F.least(F.lit(0.88), 0.6 + f["diag"] / 40)
    # Each step names the confidence before it once, so the expression stays short; nulls of least and greatest count for
    # nothing. The order matters, as later bonuses are clamped.
    bonus = lambda c, test, by, most: F.least(c + F.when(test, by).otherwise(0.0), F.when(test, most))
    floor = lambda c, test, least: F.greatest(c, F.when(test, least))
    confidence = F.when(is_line, bonus(line_start, axis, 0.08, 0.95)).otherwise(zero)
    confidence = F.when(is_bubble, F.least(F.lit(0.92), 0.70 + F.least(f["circles"], F.lit(20)) * 0.01)).otherwise(confidence)
    confidence = bonus(confidence, is_bubble & (f["color_peaks"] > 5), 0.1, 0.95)
    confidence = bonus(confidence, is_zone, 0.05, 0.97)
    confidence = floor(confidence, is_scatter, F.lit(0.75))
    confidence = floor(confidence, is_pie, F.lit(0.80))
    confidence = floor(confidence, is_bar, 0.75 + F.least(f["rects"], F.lit(12)) / 40)
    confidence = floor(confidence, is_complex, F.lit(0.85))
    few_lines = (f["horizontal"].between(1, 6) | f["vertical"].between(1, 6)) & ((f["circles"] >= 3) | (f["diag"] >= 2) | f["bar_pattern"])
    confidence = F.transform(F.array(confidence), lambda c: F.when(few_lines & (c > 0.3), F.least(F.lit(0.90), c + 0.10)).otherwise(c))[0]
    named = (("line_chart", is_line), ("bubble_chart", is_bubble), ("zone_diagram", is_zone), ("scatter_plot", is_scatter), ("pie_chart", is_pie), ("bar_chart", is_bar), ("complex_visualization", is_complex))
    types = F.array_sort(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in named])))
    strong = is_line | is_bubble | ((f["circles"] >= 3) & (f["large"] >= 2)) | f["bar_pattern"] | ((f["circles"] >= 3) & (f["color_peaks"] > 5))
    kept = rejected.isNull()
    final = F.when(kept, confidence).otherwise(zero)
    return F.struct(
        (kept & (F.size(types) > 0) & (final > 0.4) & strong).alias("has_chart"),
        final.alias("confidence"),
        F.when(kept, types).otherwise(F.array().cast("array<string>")).alias("chart_types"),
        rejected.alias("rejected"),
    )


def bar_pattern(n: Column, mean_w: Column, std_w: Column, mean_h: Column, std_h: Column) -> Column:
    return (n >= 6) & ((std_w < 0.3 * mean_w) | (std_h < 0.3 * mean_h))


def line_class(dx: Column, dy: Column) -> Column:
    """short (under 50), ignored (under 80), horizontal, vertical or diagonal, by length and angle."""
    angle = F.abs(F.degrees(F.atan2(dy, dx)))
    flat, upright = (angle < 10) | (angle > 170), (angle > 80) & (angle < 100)
    return F.when(F.hypot(dx, dy) < 50, "short").when(F.hypot(dx, dy) < 80, "ignored").when(flat, "horizontal").when(upright, "vertical").otherwise("diagonal")


def scaled(width: Column, height: Column, most: int) -> Column:
    """(width, height) of an image shrunk so that its longer side is ``most``; smaller ones stay."""
    ratio = F.least(F.lit(1.0), most / F.greatest(width, height))
    return F.struct(F.floor(width * ratio).cast("long").alias("width"), F.floor(height * ratio).cast("long").alias("height"))
