"""Images as pixel rows (image, y, x, v): neighbourhoods, morphology, pyramids, components, blocks, profiles.

A pixel gives its share to each neighbour that counts it, and shares are combined before they move; so one large image
is spread like many small ones. Null values count as absent pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import durable

CELL = ("image", "y", "x")


def _shared(pixels: DataFrame, offsets: Sequence[tuple[int, int, float]]) -> DataFrame:
    """A row (cell, v, w, own) for each pixel and offset: the value that the cell ``offset`` before it sees there."""
    moves = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(w)).alias("w")) for dy, dx, w in offsets))
    moved = pixels.where("v IS NOT NULL").withColumn("_m", F.explode(moves))
    own = (F.col("_m.dy") == 0) & (F.col("_m.dx") == 0)
    return moved.select("image", (F.col("y") - F.col("_m.dy")).alias("y"), (F.col("x") - F.col("_m.dx")).alias("x"), "v", F.col("_m.w").alias("w"), own.alias("own"))


def stencil(pixels: DataFrame, kernel: Sequence[Sequence[float]], normalise: bool = False) -> DataFrame:
    """The kernel-weighted sum around each pixel. Beyond the border values are 0, or left out of the weights (``normalise``)."""
    ry, rx = len(kernel) // 2, len(kernel[0]) // 2
    offsets = [(j - ry, i - rx, w) for j, row in enumerate(kernel) for i, w in enumerate(row) if w or (j, i) == (ry, rx)]
    total = F.sum(F.col("v") * F.col("w"))
    out = total / F.sum("w") if normalise else total
    return _shared(pixels, offsets).groupBy(*CELL).agg(out.alias("v"), F.max("own").alias("_own")).where("_own").drop("_own")


def extremum(pixels: DataFrame, reach: int, how: Callable[[str], Column]) -> DataFrame:
    """Moving minimum or maximum (``F.min``, ``F.max``) over a square, one axis after the other."""
    for axis in (0, 1):
        offsets = [(k, 0, 1.0) if axis == 0 else (0, k, 1.0) for k in range(-reach, reach + 1)]
        pixels = _shared(pixels, offsets).groupBy(*CELL).agg(how("v").alias("v"), F.max("own").alias("_own")).where("_own").drop("_own")
    return pixels


def closed(pixels: DataFrame, reach: int) -> DataFrame:
    """Grey closing: dilation, then erosion."""
    return extremum(extremum(pixels, reach, F.max), reach, F.min)


def ink_removed(pixels: DataFrame, reach: int) -> DataFrame:
    """White less the black-hat response: what dark strokes thinner than the square leave on a page of values 0 to 1."""
    background = closed(pixels, reach).withColumnRenamed("v", "background")
    both = pixels.join(background, list(CELL))
    return both.select(*CELL, (1 - F.greatest(F.col("background") - F.col("v"), F.lit(0.0))).alias("v"))


#: Binomial weights of a pyramid's steps.
BINOMIAL = ((-2, 1.0), (-1, 4.0), (0, 6.0), (1, 4.0), (2, 1.0))


def pyramid_down(pixels: DataFrame) -> DataFrame:
    """Half the rows and columns, smoothed by binomial weights of those that exist."""
    for axis in ("y", "x"):
        offsets = [(k, 0, w) if axis == "y" else (0, k, w) for k, w in BINOMIAL]
        shared = _shared(pixels, offsets).where(F.pmod(axis, F.lit(2)) == 0).withColumn(axis, F.expr(f"{axis} div 2"))
        smooth = (F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v")
        pixels = shared.groupBy(*CELL).agg(smooth, F.max("own").alias("_own")).where("_own").drop("_own")
    return pixels


def pyramid_up(small: DataFrame, like: DataFrame) -> DataFrame:
    """The smaller level at the places of ``like``, by binomial weights of the rows that reach each place; null where none does."""
    for axis in ("y", "x"):
        offsets = [(k, 0, w) if axis == "y" else (0, k, w) for k, w in BINOMIAL]
        shared = _shared(small.withColumn(axis, F.col(axis) * 2), offsets)
        small = shared.groupBy(*CELL).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    return like.select(*CELL).join(small, list(CELL), "left")


def laplacian_levels(pixels: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The differences of each level to the one above it, finest first, and the smallest level."""
    out = []
    for _ in range(levels):
        small = durable(pyramid_down(pixels))
        up = pyramid_up(small, pixels).withColumnRenamed("v", "u")
        out.append(pixels.join(up, list(CELL)).select(*CELL, (F.col("v") - F.coalesce("u", F.lit(0.0))).alias("v")))
        pixels = small
    return out, pixels


def reconstructed(differences: Sequence[DataFrame], smallest: DataFrame) -> DataFrame:
    """The image whose levels these are."""
    out = smallest
    for level in reversed(differences):
        up = pyramid_up(out, level).withColumnRenamed("v", "u")
        out = level.join(up, list(CELL)).select(*CELL, (F.col("v") + F.coalesce("u", F.lit(0.0))).alias("v"))
    return out


def smallest_reachable(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) of every node with an edge (image, a, b): the smallest node of its component.

    Large-star and small-star steps: every node hands its smallest neighbour to the others, until edges stay as they
    are. Each round is cut by a checkpoint; a round is a group-by and a join of edges, whatever a component's size.
    """
    key = ["image", "a"]

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy(*key).agg(F.least(F.min("b"), F.first("a")).alias("m"))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("image", "a", "b").cast("decimal(38,0)"))).first())

    edges = durable(edges.where("a <> b").select("image", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select("image", F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least(both), key).where("b > a").select("image", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = least(large)
        small = large.join(low, key).select("image", F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = durable(small.where("a <> b").distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = edges.select("image", F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select("image", F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def components(mask: DataFrame) -> DataFrame:
    """(image, y, x, component) of the set pixels (image, y, x), linked with all eight neighbours.

    A component is named by its smallest run start, ``y * 2**31 + x``. Pixels become runs of their row first, so that
    links are between runs.
    """
    w = Window.partitionBy("image", "y").orderBy("x")
    pixels = mask.select(*(F.col(c).cast("long").alias(c) for c in ("y", "x")), "image").distinct()
    begins = F.when(F.coalesce(F.col("x") - F.lag("x").over(w) > 1, F.lit(True)), F.col("x"))
    runs = pixels.withColumn("_b", begins).withColumn("node", F.col("y") * (1 << 31) + F.last("_b", True).over(w)).drop("_b")
    runs = durable(runs)
    below = runs.select("image", (F.col("y") - 1).alias("y"), F.explode(F.array(F.col("x") - 1, F.col("x"), F.col("x") + 1)).alias("x"), F.col("node").alias("b"))
    links = runs.withColumnRenamed("node", "a").join(below, list(CELL)).select("image", "a", "b").distinct()
    found = smallest_reachable(links)
    out = runs.join(found, ["image", "node"], "left")
    return out.select(*CELL, F.coalesce("root", "node").alias("component"))


def boxes(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bounding box, area, height, width and fill ratio of the pixels of each key."""
    out = mask.groupBy(*keys).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("area"))
    out = out.withColumn("height", F.col("y1") - F.col("y0") + 1).withColumn("width", F.col("x1") - F.col("x0") + 1)
    return out.withColumn("fill", F.col("area") / (F.col("height") * F.col("width")))


def corners(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The four outermost pixels: extremes of x + y (top left, bottom right) and of x - y (top right, bottom left)."""
    at, total, slope = F.struct("x", "y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")
    pick = lambda how, by: how(at, F.struct(by, "y", "x"))
    return mask.groupBy(*keys).agg(
        pick(F.min_by, total).alias("top_left"), pick(F.max_by, slope).alias("top_right"), pick(F.max_by, total).alias("bottom_right"), pick(F.min_by, slope).alias("bottom_left")
    )


def radial_profile(pixels: DataFrame, cy: float, cx: float) -> DataFrame:
    """(image, radius, v, n): mean value by whole distance from a centre."""
    radius = F.floor(F.sqrt(F.pow(F.col("y") - cy, 2) + F.pow(F.col("x") - cx, 2)))
    return pixels.groupBy("image", radius.alias("radius")).agg(F.avg("v").alias("v"), F.count("v").alias("n"))


def flat(pixels: DataFrame, white: float = 0.99, share: float = 0.995, deviation: float = 0.01, spread: float = 0.02) -> DataFrame:
    """(image, flat): almost all white, or almost no deviation, or almost no range."""
    tests = (F.avg((F.col("v") >= white).cast("double")) >= share) | (F.stddev_pop("v") < deviation) | (F.max("v") - F.min("v") < spread)
    return pixels.groupBy("image").agg(tests.alias("flat"))


def block_corrected(pairs: DataFrame, block: int = 32, bin_width: int = 8, dark: int = 96, least_gain: int = 8) -> DataFrame:
    """``v`` of pixel pairs (image, y, x, work, clean; values 0 to 255): in each block, as many of the darkest gains as
    its dark histogram exceeds the clean one are replaced by the clean value. Of equal gains the first in reading order goes
    first. Pixels with a null count as invalid and keep ``work``; blocks with too few valid pixels are left alone."""
    cells = ["image", "by", "bx"]
    p = pairs.withColumn("by", F.expr(f"y div {block}")).withColumn("bx", F.expr(f"x div {block}"))
    valid = F.col("work").isNotNull() & F.col("clean").isNotNull()
    both = F.array(F.struct(F.col("work").alias("v"), F.lit(1).alias("s")), F.struct(F.col("clean").alias("v"), F.lit(-1).alias("s")))
    last = min(256 // bin_width, dark // bin_width + 1)
    counted = p.where(valid).select(*cells, F.explode(both).alias("e")).groupBy(*cells, F.floor(F.col("e.v") / bin_width).alias("bin"))
    excess = counted.agg(F.sum("e.s").alias("d"), F.count("*").alias("m")).groupBy(*cells)
    excess = excess.agg(F.sum(F.when(F.col("bin") < last, F.greatest("d", F.lit(0))).otherwise(0)).alias("n"), (F.sum("m") / 2).alias("valid"))
    excess = excess.where((F.col("valid") >= max(8, block // 2)) & (F.col("n") > 0)).drop("valid")
    gain = F.col("clean") - F.col("work")
    w = Window.partitionBy(*cells).orderBy(F.desc("gain"), "y", "x")
    able = p.where(valid & (F.col("work") <= dark) & (gain >= least_gain)).withColumn("gain", gain)
    chosen = able.join(excess, cells).withColumn("_rn", F.row_number().over(w)).where("_rn <= n").select(*CELL, F.lit(True).alias("_c"))
    return pairs.join(chosen, list(CELL), "left").select(*CELL, F.when(F.col("_c"), F.col("clean")).otherwise(F.col("work")).alias("v"))
