"""Edge energies of images as pixel rows (image, y, x, v): thin edges with hysteresis, and the energies of a page's contour."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import images
from tessera.operators.pages import ACROSS, CELL, CURVED, DOWN

#: Meetings of outlines' edges with rows in one task, at most as a mean.
ROWS = 1 << 21
#: The eight neighbours, as (dy, dx).
AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def blurred(pixels: DataFrame, sigma: float, reach: float = 4.0) -> DataFrame:
    """A Gaussian blur, one axis after the other, cut at ``reach`` deviations, by the weights of the pixels that exist."""
    if sigma <= 0:
        return pixels
    far = int(reach * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-far, far + 1)]
    return images.stencil(images.stencil(pixels, [weights], normalise=True), [[w] for w in weights], normalise=True)


def gradient(pixels: DataFrame) -> DataFrame:
    """``gy``, ``gx`` and ``v``, the length of the gradient, of each pixel; beyond the border values are 0."""
    down, across = (images.stencil(pixels, k).withColumnRenamed("v", n) for k, n in ((DOWN, "gy"), (ACROSS, "gx")))
    return down.join(across, list(CELL)).withColumn("v", F.hypot("gy", "gx"))


def _neighbours(pixels: DataFrame) -> DataFrame:
    """Pixels with all eight neighbours, and ``_n``: an array of their values in the order of AROUND."""
    moves = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate(AROUND)))
    sent = pixels.select(*CELL, "v", F.explode(moves).alias("_m"))
    sent = sent.select("image", (F.col("y") - F.col("_m.dy")).alias("y"), (F.col("x") - F.col("_m.dx")).alias("x"), F.col("_m.k").alias("k"), "v")
    own = [F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"_{k}") for k in range(len(AROUND))]
    seen = sent.groupBy(*CELL).agg(*own).dropna()
    return pixels.join(seen, list(CELL)).withColumn("_n", F.array(*(f"_{k}" for k in range(len(AROUND))))).drop(*(f"_{k}" for k in range(len(AROUND))))


def thinned(graded: DataFrame) -> DataFrame:
    """Pixels of ``gradient`` that no value along their gradient exceeds, on either side. The value there lies between two
    neighbours and is interpolated by the gradient's slope. Both ends of a plateau stay; pixels without eight neighbours go."""
    gy, gx = F.col("gy"), F.col("gx")
    at = lambda dy, dx: F.col("_n")[AROUND.index((dy, dx))]
    steep = F.abs(gy) >= F.abs(gx)
    share = F.when(steep, F.abs(gx) / F.abs(gy)).otherwise(F.abs(gy) / F.abs(gx))
    alike = gy * gx >= 0  # the gradient points down right or up left

    def ahead(s: int) -> Column:
        straight = F.when(steep, at(s, 0)).otherwise(at(0, s))
        aslant = F.when(alike, at(s, s)).otherwise(F.when(steep, at(s, -s)).otherwise(at(-s, s)))
        return share * aslant + (1 - share) * straight

    full = _neighbours(graded).where("v > 0")
    near = lambda c: c <= F.col("v") + 1e-9
    return full.where(near(ahead(1)) & near(ahead(-1))).drop("_n")


def thin_edges(pixels: DataFrame, low: float, high: float, sigma: float = 1.0) -> DataFrame:
    """(image, y, x) of edges one pixel wide: maxima along the gradient of the blurred image of at least ``low``, kept where their
    component (of eight neighbours) holds one of at least ``high``. Nulls are absent pixels; an empty image has none."""
    ridges = thinned(gradient(blurred(pixels, sigma))).where(F.col("v") >= low).select(*CELL, "v")
    named = images.components(ridges.select(*CELL))
    kept = named.join(ridges.where(F.col("v") >= high).select(*CELL), list(CELL), "left_semi").select("image", "component").distinct()
    return named.join(kept, ["image", "component"], "left_semi").select(*CELL)


def unit(pixels: DataFrame) -> DataFrame:
    """Values scaled to 0 to 1 by their image's range; 0 where the image has (nearly) none."""
    whole = pixels.groupBy("image").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return pixels.join(whole, "image").select(*CELL, F.when(span < 1e-8, 0.0).otherwise((F.col("v") - F.col("_lo")) / span).alias("v"))


MODES = ("gaussian", "sobel", "sobel_binary", "canny", "laplace_abs", "laplace_abs_inv")


def energy(
    pixels: DataFrame, mode: str, sigma: float = 0.0, binary_threshold: float = 0.5, low: float = 0.1, high: float = 0.2, power: float | None = None,
    unsharp: tuple[float, float] | None = None, border: int = 0, size: tuple[int, int] | None = None,
) -> DataFrame:
    """The energy (image, y, x, v from 0 to 1) that a page's contour follows, by one of MODES.

    Blur, sharpening (``unsharp``: deviation and amount), energy, scaling to 0 to 1, a power (``power``, none for the binary mode), scaling again, and 0
    within ``border`` pixels of the edges of images of ``size`` (height, width). An unknown mode is an error.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode of energy: {mode}")
    smooth = blurred(pixels, sigma)
    if unsharp is not None:
        soft = blurred(smooth, unsharp[0]).withColumnRenamed("v", "_s")
        smooth = smooth.join(soft, list(CELL)).select(*CELL, values.unsharp(F.col("v"), F.col("_s"), unsharp[1]).alias("v"))
    if mode == "gaussian":
        found = smooth
    elif mode in ("sobel", "sobel_binary"):
        found = gradient(smooth).select(*CELL, "v")
    elif mode == "canny":
        found = smooth.select(*CELL).join(thin_edges(smooth, low, high).withColumn("v", F.lit(1.0)), list(CELL), "left").fillna(0.0, ["v"])
    else:
        found = images.stencil(smooth, CURVED).withColumn("v", F.abs("v"))
    raw = unit(found)
    if mode == "laplace_abs_inv":
        raw = unit(raw.withColumn("v", 1 - F.col("v")))
    if mode == "sobel_binary":
        raw = raw.withColumn("v", F.when(F.col("v") >= binary_threshold, 1.0).otherwise(0.0))
    elif power is not None:
        raw = unit(raw.withColumn("v", values.gamma(F.col("v"), power)))
    if border > 0 and size is not None:
        inside = F.col("y").between(border, size[0] - 1 - border) & F.col("x").between(border, size[1] - 1 - border)
        raw = raw.withColumn("v", F.when(inside, F.col("v")).otherwise(0.0))
    return raw


def rectangle(pictures: DataFrame, margin: float, points: int) -> DataFrame:
    """(image, k, y, x): a closed contour along the sides of pictures (image, height, width), ``margin`` of their size from the border.

    A quarter of the points each lies evenly along the upper, right, lower and (with what is left) left side, which starts at its corner and
    stops short of the next one.
    """
    side = points // 4
    my, mx = (F.floor(F.col(c) * F.lit(float(margin))).cast("double") for c in ("height", "width"))
    bottom, right = F.col("height") - 1 - my, F.col("width") - 1 - mx
    k = F.col("k")
    share = (k - side * F.least(F.floor(k / max(side, 1)), F.lit(3))) / F.when(k < 3 * side, F.lit(float(side))).otherwise(float(points - 3 * side))
    y = F.when(k < side, my).when(k < 2 * side, my + share * (bottom - my)).when(k < 3 * side, bottom).otherwise(bottom + share * (my - bottom))
    x = F.when(k < side, mx + share * (right - mx)).when(k < 2 * side, right).when(k < 3 * side, right + share * (mx - right)).otherwise(mx)
    rows = pictures.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return rows.select("image", "k", y.alias("y"), x.alias("x"))


def polygon_mask(contours: DataFrame) -> DataFrame:
    """(image, y, x): pixels inside closed outlines (image, k, y, x) or on them, joined from corner to corner by ``k`` and back to the first.

    Each edge meets the rows it spans; between a row's crossings, in order, every other stretch is inside, also where the outline
    crosses or touches itself. Pixels on an edge always count. A row's stretches are cut at those before them, so that
    no pixel is met twice. Points with a null are left out; one point is its own outline. Pictures are dealt over so many tasks that each
    has about ROWS meetings of edges and rows; a picture's corners are ordered in one task, and a row's crossings are.
    """
    points = contours.dropna(subset=["k", "y", "x"]).select("image", "k", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    heights = points.groupBy("image").agg((F.count("*") * (F.floor(F.max("y")) - F.ceil(F.min("y")) + 1)).alias("_n"))  # at most so many meetings
    most = heights.agg(F.sum("_n")).first()[0] or 0
    tasks = max(1, math.ceil(most / ROWS))
    points = points.repartition(tasks, "image")  # a given number, which Spark doesn't lower by the size of the corners
    w = Window.partitionBy("image").orderBy("k", "y", "x")
    here, first = F.struct("y", "x"), F.first(F.struct("y", "x")).over(w)
    edges = points.withColumn("b", F.coalesce(F.lead(here).over(w), first)).withColumn("a", here).select("image", "a", "b")
    edges = edges.select("image", *(F.when(F.col("a.y") <= F.col("b.y"), F.col(p)).otherwise(F.col(q)).alias(n) for p, q, n in (("a", "b", "low"), ("b", "a", "high"))))
    rows = edges.withColumn("_lo", F.ceil("low.y")).withColumn("_hi", F.floor("high.y")).where("_lo <= _hi").withColumn("y", F.explode(F.sequence("_lo", "_hi")))
    level = F.col("low.y") == F.col("high.y")
    at = F.col("low.x") + (F.col("y") - F.col("low.y")) * (F.col("high.x") - F.col("low.x")) / F.when(~level, F.col("high.y") - F.col("low.y"))
    rows = rows.withColumn("at", F.round(at, 9))
    rows = rows.select(
        "image",
        "y",
        F.when(level, F.least("low.x", "high.x")).otherwise(F.col("at")).alias("lo"),
        F.when(level, F.greatest("low.x", "high.x")).otherwise(F.col("at")).alias("hi"),
        (~level & (F.col("y") < F.col("high.y"))).cast("int").alias("_c"),
    )
    order = Window.partitionBy("image", "y").orderBy("lo")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.sum("_c").over(before) % 2 == 1  # up to what comes next
    spans = rows.withColumn("_to", F.when(inside, F.lead("lo").over(order))).select("image", "y", F.ceil("lo").alias("lo"), F.floor(F.greatest("hi", "_to")).alias("hi"), F.col("lo").alias("_at"))
    reached = F.max("hi").over(Window.partitionBy("image", "y").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("lo", F.greatest("lo", reached + 1)).where("lo <= hi")
    return spans.select("image", "y", F.explode(F.sequence("lo", "hi")).alias("x"))
