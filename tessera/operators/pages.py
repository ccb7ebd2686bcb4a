"""Pictures of pages as pixel rows (image, y, x, v): region rules, energies, borders, traced lines, page scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import images, signals

CELL = ("image", "y", "x")


def plausible(boxes: DataFrame, least: int, most: int, aspect: tuple[float, float], fill: float) -> DataFrame:
    """Regions (area, height, width, fill, ...) of a plausible area, width by height, and share of their box."""
    shape = F.col("width") / F.col("height")
    return boxes.where(F.col("area").between(least, most) & shape.between(*aspect) & (F.col("fill") >= fill))


#: Kernels of the energies.
SMOOTH = [[1 / 16, 2 / 16, 1 / 16], [2 / 16, 4 / 16, 2 / 16], [1 / 16, 2 / 16, 1 / 16]]
ACROSS = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
DOWN = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]
CURVED = [[0, 1, 0], [1, -4, 1], [0, 1, 0]]


def energies(pixels: DataFrame) -> DataFrame:
    """``smooth``, ``sobel`` (length of the gradient) and ``laplace`` (its absolute value) of each pixel."""
    found = [images.stencil(pixels, k).select(*CELL, F.col("v").alias(n)) for k, n in ((SMOOTH, "smooth"), (ACROSS, "_h"), (DOWN, "_u"), (CURVED, "_l"))]
    out = found[0]
    for other in found[1:]:
        out = out.join(other, list(CELL))
    return out.select(*CELL, "smooth", F.hypot("_h", "_u").alias("sobel"), F.abs("_l").alias("laplace"))


def border_zeroed(pixels: DataFrame, height: int, width: int, share: float) -> DataFrame:
    """Pixels with 0 within a share of the picture's size from its border."""
    my, mx = int(height * share), int(width * share)
    inside = (F.col("y") >= my) & (F.col("y") < height - my) & (F.col("x") >= mx) & (F.col("x") < width - mx)
    return pixels.withColumn("v", F.when(inside, F.col("v")).otherwise(0.0))


def mean_heights(points: DataFrame) -> DataFrame:
    """(image, x, y): the mean height of each column's points."""
    return points.groupBy("image", "x").agg(F.avg("y").alias("y"))


def drawn(heights: DataFrame) -> DataFrame:
    """(image, x, y) pixels of the line through rounded heights: each column up or down to the next one's height.

    One picture's columns are ordered in one task; there are few.
    """
    rounded = heights.select("image", "x", F.rint("y").cast("long").alias("y"))
    then = F.coalesce(F.lead("y").over(Window.partitionBy("image").orderBy("x")), F.col("y"))
    return rounded.withColumn("_z", then).select("image", "x", F.explode(F.sequence(F.least("y", "_z"), F.greatest("y", "_z"))).alias("y"))


def polyline(points: DataFrame, keys: Sequence[str], thickness: int = 1) -> DataFrame:
    """(keys, x, y) pixels of the straight lines through points (keys, x: whole columns, distinct; y), column by column.

    Each column is filled from the line's rounded height there to that at the next column, so that the line has no gaps; the last point
    is a pixel. Pixels are repeated above (first) and below to the thickness. One line's points are ordered in one task; there are few.
    """
    nxt = F.lead(F.struct("x", "y")).over(Window.partitionBy(*keys).orderBy("x"))
    legs = points.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("double").alias("y")).withColumn("_n", nxt)
    last = F.coalesce(F.col("_n.x") - 1, F.col("x"))
    cells = legs.withColumn("_x", F.explode(F.sequence(F.col("x"), last)))
    at = lambda c: F.rint(F.round(F.when(F.col("_n").isNull(), F.col("y")).otherwise(F.col("y") + (F.col("_n.y") - F.col("y")) * (c - F.col("x")) / (F.col("_n.x") - F.col("x"))), 9)).cast("long")
    a, b = at(F.col("_x")), at(F.col("_x") + 1)
    above, below = thickness // 2, (thickness - 1) // 2
    rows = F.sequence(F.least(a, b) - above, F.greatest(a, b) + below)
    return cells.select(*keys, F.col("_x").alias("x"), F.explode(rows).alias("y")).distinct()


def rasterised(series: DataFrame, regions: DataFrame, pictures: DataFrame, thickness: int = 1) -> DataFrame:
    """(image, lead, y, x) pixels of signals (image, lead, i, mv) drawn into their regions (of ``lead_regions``) of pictures (image, height, width).

    The samples from the first to the last known one are laid evenly over the region's columns, a millivolt is one centimetre
    high, and what falls out of the picture is held at its border. Samples of one column are averaged; columns without one lie on the line between their
    neighbours. Unknown samples (null or NaN) within are left out; a signal without known samples is not drawn. The strip takes lead ``II``.
    """
    known = series.where(F.col("mv").isNotNull() & ~F.isnan("mv"))
    span = known.groupBy("image", "lead").agg(F.min("i").alias("_a"), F.max("i").alias("_b"))
    strip = regions.withColumn("_lead", F.when(F.col("lead") == STRIP, "II").otherwise(F.col("lead"))).withColumnRenamed("lead", "_region").withColumnRenamed("_lead", "lead")
    placed = known.join(span, ["image", "lead"]).join(strip, ["image", "lead"]).join(pictures, "image")
    share = F.coalesce(F.try_divide(F.col("i") - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0))
    x = F.col("x0") + (F.col("x1") - 1 - F.col("x0")) * share
    y = values.mv_to_pixel(F.col("mv"), F.col("baseline"), F.col("height") / HEIGHT / 10)
    held = lambda c, size: F.greatest(F.lit(0.0), F.least(F.col(size) - 1.0, c))
    placed = placed.select("image", F.col("_region").alias("lead"), F.rint(held(x, "width")).cast("long").alias("x"), held(y, "height").alias("y"))
    heights = placed.groupBy("image", "lead", "x").agg(F.rint(F.avg("y")).alias("y"))
    return polyline(heights, ["image", "lead"], thickness).join(pictures, "image").where((F.col("y") >= 0) & (F.col("y") < F.col("height"))).select("image", "lead", "y", "x")


def decoded_records(traced: DataFrame, regions: DataFrame, pictures: DataFrame, rate: float, mm_per_s: float = 25.0) -> DataFrame:
    """(image, lead, i, mv): every lead of each picture at a sampling rate, from traced heights (image, lead, x, y).

    A region's columns without a height count as its zero line; a region without any is a flat line. One lead's columns are put together in one
    row, as many as its region is wide.
    """
    columns = regions.withColumn("x", F.explode(F.sequence(F.col("x0").cast("long"), F.col("x1").cast("long") - 1))).select("image", "lead", "x", "baseline")
    known = traced.select("image", "lead", F.col("x").cast("long").alias("x"), F.col("y").cast("double").alias("y")).groupBy("image", "lead", "x").agg(F.avg("y").alias("y"))
    full = columns.join(known, ["image", "lead", "x"], "left").join(pictures, "image")
    full = full.withColumn("mv", values.pixel_to_mv(F.coalesce("y", F.col("baseline").cast("double")), F.col("baseline"), F.col("height") / HEIGHT / 10))
    lines = full.groupBy("image", "lead", "width").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "mv"))), lambda e: e["mv"]).alias("mv"))
    sizes = [r["width"] for r in lines.select("width").distinct().collect()]  # a rate a width of picture
    done = [lines.where(F.col("width") == w).withColumn("mv", signals.resampled_at_rate(F.col("mv"), w / WIDTH * mm_per_s / 10, rate)) for w in sizes]
    out = reduce(DataFrame.unionByName, done) if done else lines
    return out.select("image", "lead", F.posexplode("mv").alias("i", "mv"))


@dataclass(frozen=True)
class PageWeights:
    """Weights of a page's score, and what a page is expected to be."""

    edge: float = 1.0
    movement: float = 1.0
    fill: float = 1.0
    border: float = 1.0
    area: float = 1.0
    margin: int = 3
    low: float = 0.3
    high: float = 0.9


def scores(contours: DataFrame, energy: DataFrame, mask: DataFrame, height: int, width: int, weights: PageWeights = PageWeights()) -> DataFrame:
    """(image, edge, movement, border, fill, area, penalty, score) of page outlines.

    ``contours`` (image, y0, x0, y, x): points of an outline before and after it was fitted; ``energy``: pixels; ``mask``:
    the page's pixels. Energy is read at the nearest pixel (none counts as 0).
    """
    near = lambda c, size: F.greatest(F.lit(0), F.least(F.lit(size - 1), F.rint(c).cast("long")))
    at = contours.withColumn("_y", near("y", height)).withColumn("_x", near("x", width))
    grid = energy.select("image", F.col("y").cast("long").alias("_y"), F.col("x").cast("long").alias("_x"), "v")
    y, x, m = F.col("y"), F.col("x"), weights.margin
    border = (y < m) | (y > height - 1 - m) | (x < m) | (x > width - 1 - m)
    outline = at.join(grid, ["image", "_y", "_x"], "left").groupBy("image").agg(
        F.avg(F.coalesce("v", F.lit(0.0))).alias("edge"),
        (F.avg(F.hypot(y - F.col("y0"), x - F.col("x0"))) / max((height**2 + width**2) ** 0.5, 1e-8)).alias("movement"),
        F.avg(border.cast("int")).alias("border"),
    )
    box = (F.max("y") - F.min("y") + 1) * (F.max("x") - F.min("x") + 1)
    region = mask.groupBy("image").agg((F.count("*") / box).alias("fill"), (F.count("*") / (height * width)).alias("area"))
    found = outline.join(region, "image", "left").fillna(0.0, ["fill", "area"])
    found = found.withColumn("penalty", values.outside_window(F.col("area"), weights.low, weights.high))
    gains = weights.edge * F.col("edge") + weights.movement * F.col("movement") + weights.fill * F.col("fill")
    return found.withColumn("score", gains - weights.border * F.col("border") - weights.area * F.col("penalty"))


#: Leads by row and column of a recording, the strip below them, and its measures: heights in centimetres from the
#: top, offsets of each row's zero line, widths in units.
LEADS = (("I", "aVR", "V1", "V4"), ("II", "aVL", "V2", "V5"), ("III", "aVF", "V3", "V6"))
STRIP = "II_rhythm"
HEIGHT, TOP, ROW_HEIGHTS, STRIP_HEIGHT, OFFSETS = 21.5, 8.0, (3.0, 4.0, 3.5), 2.0, (1.0, 1.5, 1.0, 1.0)
WIDTH, MARGIN, LEAD_WIDTH = 28.0, 1.5, 6.25


def lead_regions(pictures: DataFrame) -> DataFrame:
    """(image, lead, row, y0, y1, x0, x1, baseline) in pixels of pictures (image, height, width) by the physical layout. Every
    measure is rounded (halves to even) before heights are added up."""
    pixels = lambda cm: F.rint(F.lit(cm) * (F.col("height") / HEIGHT)).cast("long")
    across = lambda units: F.rint(F.lit(units / WIDTH) * F.col("width")).cast("long")
    top, cm, regions = pixels(TOP), TOP, []
    for row, (size, offset) in enumerate(zip((*ROW_HEIGHTS, STRIP_HEIGHT), OFFSETS, strict=True)):
        bottom, zero = top + pixels(size), pixels(cm + offset)
        places = [(lead, across(MARGIN + c * LEAD_WIDTH), across(MARGIN + (c + 1) * LEAD_WIDTH)) for c, lead in enumerate(LEADS[row])] if row < len(LEADS) else [(STRIP, across(MARGIN), F.col("width") - across(MARGIN))]
        for lead, left, right in places:
            cells = (F.lit(lead).alias("lead"), F.lit(row + 1).alias("row"), top.alias("y0"), F.least(bottom, F.col("height")).alias("y1"), left.alias("x0"), F.least(right, F.col("width")).alias("x1"), zero.alias("baseline"))
            regions.append(F.struct(*cells))
        top, cm = bottom, cm + size
    return pictures.select("image", F.inline(F.array(*regions)))
