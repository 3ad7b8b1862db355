"""Places on a page as column expressions: boxes are [left, top, right, bottom] from the top left corner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crop_margins(box: Column, width: Column, height: Column) -> Column:
    """STRUCT(left, bottom, right, top): what to cut off a page to keep the box; null for a degenerate box.

    The box is clamped to the page first.
    """
    clamp = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    x0, y0 = clamp(F.get(box, 0), width), clamp(F.get(box, 1), height)
    x1, y1 = clamp(F.get(box, 2), width), clamp(F.get(box, 3), height)
    whole = (F.size(box) == 4) & (x1 > x0) & (y1 > y0)
    return F.when(whole, F.struct(x0.alias("left"), (height - y1).alias("bottom"), (width - x1).alias("right"), y0.alias("top")))


def caption_band(rect: Column, kind: Column, height: Column, span: float = 0.35, margin: float = 0.02) -> Column:
    """STRUCT(left, bottom, right, top) margins of a band around a caption, whose box counts from the bottom of the page.

    Tables stand below their caption, figures above; ``span`` and ``margin`` are shares of the page's height.
    """
    bottom, top = F.get(rect, 1), F.get(rect, 3)
    table = kind == "table"
    low = F.greatest(F.lit(0.0), bottom - F.when(table, height * span).otherwise(height * margin))
    high = F.least(height, top + F.when(table, height * margin).otherwise(height * span))
    return F.struct(F.lit(0.0).alias("left"), low.alias("bottom"), F.lit(0.0).alias("right"), (height - high).alias("top"))
