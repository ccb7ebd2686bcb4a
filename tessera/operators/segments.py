"""Line segments of masks (image, y, x) by progressive voting.

Pixels begin to vote in a seeded random order, share by share. The strongest cell of an image (then the smallest angle, then the smallest rho) with
``threshold`` votes claims the pixels on its line. They are cut where more than ``gap`` lies between neighbours; pieces of ``length``
or more are segments, whose pixels leave and take their votes back. A cell claims once. When no cell is strong enough, the next share
of pixels votes.

Cells are settled many at a time: a cell that is the strongest one at all of its pixels shares none with a
stronger one, so that nothing which happens before its turn can change it. The result is that of one cell after the other.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import delete, stored

LINE = ["image", "theta", "rho"]
PIXEL = ["image", "y", "x"]


def vote_share(seed: int, shares: int) -> Column:
    """The share, 0 to ``shares`` - 1, with which a pixel begins to vote."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("image").cast("string"), F.col("y").cast("string"), F.col("x").cast("string")))
    return F.floor(F.conv(F.substring(digest, 1, 4), 16, 10).cast("long") * shares / 65536).cast("int")


def _along(angles: int) -> Column:
    """A pixel's place along a line of its cell."""
    theta = F.col("theta") * F.lit(math.pi / angles)
    return F.col("y") * F.cos(theta) - F.col("x") * F.sin(theta)


def _cut(claimed: DataFrame, angles: int, length: float, gap: float) -> DataFrame:
    """Claimed pixels with ``run`` (the smallest place of their piece), ``first`` and ``last`` (its end pixels) and ``long``."""
    place = F.round(_along(angles), 6)  # so that equal distances are equal
    line = Window.partitionBy(*LINE).orderBy("at", "y", "x")
    begins = F.coalesce(F.col("at") - F.lag("at").over(line) > gap, F.lit(True))
    runs = claimed.withColumn("at", place).withColumn("_b", F.when(begins, F.struct("at", "y", "x"))).withColumn("run", F.last("_b", True).over(line))
    whole = Window.partitionBy(*LINE, "run")
    end = F.struct("at", "y", "x")
    out = runs.withColumn("first", F.min(end).over(whole)).withColumn("last", F.max(end).over(whole)).withColumn("pixels", F.count("*").over(whole))
    return out.withColumn("long", F.col("last.at") - F.col("first.at") >= length - 1e-6)


def segments(
    mask: DataFrame, angles: int = 180, step: float = 1.0, threshold: int = 10, length: float = 50.0, gap: float = 10.0, shares: int = 4, seed: int = 0
) -> DataFrame:
    """(image, theta, rho, y0, x0, y1, x1, pixels): one row per segment; theta in steps of 180 / ``angles`` degrees, rho in bins of ``step``.

    Each pixel belongs to one segment at most; repeated pixels count once, pixels with a null are left out, an empty mask has none. Each share
    spreads its pixels' cells once and keeps those of strong cells; a round is a few shuffles of what is left of these.
    Windows hold one line's pixels. A line's ends are its pixels of least and greatest place along it.
    """
    spark = mask.sparkSession
    pixels = mask.select("image", *(F.col(c).cast("long").alias(c) for c in ("y", "x"))).dropna().distinct()
    live = stored(pixels.withColumn("share", vote_share(seed, shares)))
    theta = F.col("theta") * F.lit(math.pi / angles)
    rho = F.round((F.col("x") * F.cos(theta) + F.col("y") * F.sin(theta)) / step + 1e-7).cast("long")
    settled: list[DataFrame] = []
    found: list[DataFrame] = []
    for share in range(shares):
        cells = live.withColumn("voted", (F.col("share") <= share).cast("int")).withColumn("theta", F.explode(F.sequence(F.lit(0), F.lit(angles - 1)))).withColumn("rho", rho)
        strong = cells.groupBy(*LINE).agg(F.sum("voted").alias("votes")).where(F.col("votes") >= threshold)
        if settled:
            strong = strong.join(reduce(DataFrame.union, settled), LINE, "left_anti")
        near = stored(cells.join(strong, LINE, "left_semi").select(*PIXEL, "theta", "rho", "voted"))
        gone: list[DataFrame] = []
        while True:
            votes = near.groupBy(*LINE).agg(F.sum("voted").alias("votes")).where(F.col("votes") >= threshold)
            rank = F.struct("votes", -F.col("theta"), -F.col("rho"))
            ranked = near.join(votes, LINE)
            best = ranked.groupBy(*PIXEL).agg(F.max(rank).alias("best"))
            won = ranked.join(best, PIXEL).groupBy(*LINE).agg(F.min((rank == F.col("best")).cast("int")).alias("won")).where("won = 1").select(*LINE)
            claimed = stored(_cut(near.join(won, LINE).select(*PIXEL, "theta", "rho"), angles, length, gap))
            if claimed.isEmpty():
                delete(spark, claimed.stored_at)
                break
            taken = claimed.where("long").select(*PIXEL)
            left = near.join(claimed.select(*LINE).distinct(), LINE, "left_anti").join(taken, PIXEL, "left_anti")
            near = stored(left, replaces=near)
            gone.append(claimed)
        delete(spark, near.stored_at)
        if gone:
            settled += [c.select(*LINE).distinct() for c in gone]
            found += gone
            live = stored(live.join(reduce(DataFrame.union, gone).where("long"), PIXEL, "left_anti"), replaces=live)
    schema = "theta int, rho long, y0 long, x0 long, y1 long, x1 long, pixels long"
    if not found:
        out = pixels.limit(0).select("image", *(F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in schema.split(", ")))
    else:
        every = reduce(DataFrame.union, found).where(F.col("long") & (F.struct("at", "y", "x") == F.col("first")))
        ends = [F.col(f"{e}.{c}").alias(f"{c}{k}") for k, e in enumerate(("first", "last")) for c in ("y", "x")]
        out = every.select("image", "theta", "rho", *ends, "pixels")
    out = stored(out)
    for done in (live, *found):
        delete(spark, done.stored_at)
    return out
