"""Images as pixel rows (image, y, x, v) brought to another shape or tone: resizing, rectified pages, locally equalised greys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["image", "y", "x"]
CORNERS = ("top_left", "top_right", "bottom_right", "bottom_left")


def fitted_sizes(pictures: DataFrame, most: int) -> DataFrame:
    """Pictures (image, height, width) with the ``scale`` (1 at most) that brings their longer side to ``most``, and ``new_height``, ``new_width``."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest("height", "width"))
    side = lambda c: F.greatest(F.lit(1), F.rint(F.col(c) * F.col("scale")).cast("int"))
    return pictures.withColumn("scale", scale).withColumn("new_height", side("height")).withColumn("new_width", side("width"))


def resized(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Images brought to the sizes (image, height, width, new_height, new_width), smaller or larger, one axis after the other.

    A new cell is the mean of what it covers, weighted by area: each pixel sends to every cell it overlaps its share of value and weight, and
    these are summed before they move. Absent and null pixels have no weight; cells that none overlaps are absent.
    """
    known = pixels.where("v IS NOT NULL").select(*CELL, F.col("v").alias("s"), F.lit(1).cast("long").alias("n"))
    out = known.join(sizes.select("image", "height", "width", "new_height", "new_width"), "image")
    for axis, old, new in (("y", "height", "new_height"), ("x", "width", "new_width")):
        # in units of 1 / (old * new) a pixel spans ``new`` and a cell spans ``old``, so that all bounds are whole numbers
        begin = F.col(axis).cast("long") * F.col(new)
        first, last = F.expr(f"{axis} * {new} div {old}"), F.expr(f"(({axis} + 1) * {new} - 1) div {old}")
        sent = out.withColumn("_b", begin).withColumn("_c", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        overlap = F.least(F.col("_b") + F.col(new), (F.col("_c") + 1) * F.col(old)) - F.greatest(F.col("_b"), F.col("_c") * F.col(old))
        sent = sent.withColumn("_w", overlap).withColumn(axis, F.col("_c")).drop("_b", "_c")
        sides = ["height", "width", "new_height", "new_width"]
        out = sent.groupBy(*CELL, *sides).agg(F.sum(F.col("s") * F.col("_w")).alias("s"), F.sum(F.col("n") * F.col("_w")).alias("n"))
    return out.select(*CELL, (F.col("s") / F.col("n")).alias("v"))


def ordered_corners(points: DataFrame) -> DataFrame:
    """(image, top_left, top_right, bottom_right, bottom_left) as structs (x, y) of points (image, x, y): extremes of x + y and of y - x."""
    at, total, slope = F.struct("x", "y"), F.col("x") + F.col("y"), F.col("y") - F.col("x")
    pick = lambda how, by: how(at, F.struct(by, "y", "x"))
    found = ((F.min_by, total), (F.min_by, slope), (F.max_by, total), (F.max_by, slope))
    return points.groupBy("image").agg(*(pick(how, by).alias(c) for (how, by), c in zip(found, CORNERS, strict=True)))


def projective(u: Column, v: Column) -> tuple[Column, Column]:
    """Where the place (u, v) of the unit square lies in the quadrilateral of CORNERS, as (x, y); null in a degenerate one.

    The eight numbers of the map follow from the corners in closed form: two of them from how far the corners are from a
    parallelogram, the others from three corners.
    """
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = ((F.col(f"{c}.x"), F.col(f"{c}.y")) for c in CORNERS)
    ax, bx, sx = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    ay, by, sy = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    area = F.nullif(ax * by - bx * ay, F.lit(0.0))
    g, h = (sx * by - bx * sy) / area, (ax * sy - sx * ay) / area
    below = F.nullif(g * u + h * v + 1, F.lit(0.0))
    x = ((x1 - x0 + g * x1) * u + (x3 - x0 + h * x3) * v + x0) / below
    y = ((y1 - y0 + g * y1) * u + (y3 - y0 + h * y3) * v + y0) / below
    return x, y


def interpolated(pixels: DataFrame, places: DataFrame) -> DataFrame:
    """``v`` at places (image, .., sy, sx) between pixels: weighted by the distance to the four around, of which absent ones count as 0."""
    keys = [c for c in places.columns if c not in ("sy", "sx")]
    fy, fx = F.col("sy") - F.floor("sy"), F.col("sx") - F.floor("sx")
    four = F.array(*(
        F.struct((F.floor("sy") + dy).alias("y"), (F.floor("sx") + dx).alias("x"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w"))
        for dy in (0, 1) for dx in (0, 1)
    ))
    asked = places.withColumn("_p", F.explode(four)).select(*keys, F.col("_p.y").alias("_y"), F.col("_p.x").alias("_x"), F.col("_p.w").alias("_w"))
    known = pixels.select("image", F.col("y").cast("long").alias("_y"), F.col("x").cast("long").alias("_x"), "v")
    share = F.coalesce(F.col("v"), F.lit(0.0)) * F.col("_w")
    return asked.join(known, ["image", "_y", "_x"], "left").groupBy(*keys).agg(F.sum(share).alias("v"))


def rectified(pixels: DataFrame, corners: DataFrame, height: int, width: int) -> DataFrame:
    """The quadrilateral of each image (image and CORNERS, structs x, y in pixels) as an upright picture of this size.

    Every new pixel asks for the place it comes from; its corners come from the corners themselves. Images without corners, or with
    corners on one line, have no rows. Beyond the border values are 0.
    """
    unit = lambda c, n: F.col(c) / float(max(n - 1, 1))
    grid = corners.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    sx, sy = projective(unit("x", width), unit("y", height))
    # a place within rounding of a pixel is that pixel
    places = grid.select(*CELL, F.round(sy, 9).alias("sy"), F.round(sx, 9).alias("sx")).dropna()
    return interpolated(pixels, places)


def equalised(pixels: DataFrame, sizes: DataFrame, tiles: int = 8, limit: float = 2.0, levels: int = 256) -> DataFrame:
    """Grey values 0 to ``levels`` - 1 (whole numbers) spread by the clipped histograms of the tiles around them.

    An image (sizes: image, height, width) has ``tiles`` by ``tiles`` tiles. In each, counts beyond max(1, floor(limit * pixels / levels)) are cut off and
    handed back: the same whole number to every level, what is left one each to levels at even steps from level 0. A
    tile's table is the rounded running share of its counts times the highest level. A pixel takes the tables of the four
    tiles whose centres surround it, weighted by distance; beyond the outer centres the nearest ones count. The result is
    rounded. Null values are absent pixels.
    """
    own = pixels.where("v IS NOT NULL").select(*CELL, F.col("v").cast("int").alias("v")).join(sizes.select("image", "height", "width"), "image")
    side = lambda c: F.ceil(F.col(c) / float(tiles))
    own = own.withColumn("_h", side("height")).withColumn("_w", side("width"))
    counted = own.groupBy("image", F.expr("y div _h").alias("ty"), F.expr("x div _w").alias("tx"), "v").agg(F.count("*").alias("n"))
    tile = counted.groupBy("image", "ty", "tx").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("_m"), F.sum("n").alias("area"))
    every = F.sequence(F.lit(0), F.lit(levels - 1))
    tile = tile.withColumn("most", F.greatest(F.lit(1), F.floor(F.lit(float(limit)) * F.col("area") / levels)))
    tile = tile.withColumn("n", F.transform(every, lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0)).cast("long")))
    tile = tile.withColumn("extra", F.aggregate("n", F.lit(0).cast("long"), lambda s, n: s + F.greatest(n - F.col("most"), F.lit(0))))
    tile = tile.withColumn("each", F.expr(f"extra div {levels}")).withColumn("rest", F.expr(f"extra % {levels}"))
    tile = tile.withColumn("step", F.when(F.col("rest") > 0, F.greatest(F.lit(1), F.floor(F.lit(levels) / F.col("rest")))).otherwise(1))
    given = lambda k: ((k % F.col("step") == 0) & (k / F.col("step") < F.col("rest"))).cast("long")
    tile = tile.withColumn("n", F.transform("n", lambda n, k: F.least(n, F.col("most")) + F.col("each") + given(k)))
    start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<long>").alias("t"))
    sums = F.aggregate("n", start, lambda a, n: F.struct((a["s"] + n).alias("s"), F.concat(a["t"], F.array(a["s"] + n)).alias("t")))["t"]
    table = tile.select("image", "ty", "tx", "area", F.posexplode(sums).alias("v", "s"))
    table = table.select("image", "ty", "tx", "v", F.rint(F.col("s") * float(levels - 1) / F.col("area")).alias("t"))

    def around(at: str, size: str, length: str) -> Column:
        """The two tiles before and behind a place, and their weights; at the border twice the same."""
        place = F.col(at) / F.col(size) - 0.5
        last = F.ceil(F.col(length) / F.col(size)) - 1
        within = lambda k: F.greatest(F.lit(0), F.least(last, k)).cast("long")
        low = F.floor(place)
        return F.array(*(F.struct(within(low + d).alias("t"), (place - low if d else 1 - (place - low)).alias("w")) for d in (0, 1)))

    asked = own.withColumn("_a", F.explode(around("y", "_h", "height"))).withColumn("_b", F.explode(around("x", "_w", "width")))
    asked = asked.select(*CELL, "v", F.col("_a.t").alias("ty"), F.col("_b.t").alias("tx"), (F.col("_a.w") * F.col("_b.w")).alias("_s"))
    asked = asked.groupBy(*CELL, "v", "ty", "tx").agg(F.sum("_s").alias("_s"))
    found = asked.join(table, ["image", "ty", "tx", "v"], "left")
    # a tile without pixels of its own (an absent region) has no say
    value = F.sum(F.col("t") * F.col("_s")) / F.sum(F.when(F.col("t").isNotNull(), F.col("_s")))
    return found.groupBy(*CELL).agg(F.rint(F.round(value, 9)).cast("int").alias("v"))
