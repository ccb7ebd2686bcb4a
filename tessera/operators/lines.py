"""Line families from vote tables (image, theta, rho, votes), ``theta`` in degrees, ``rho`` in bins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import signals


def strong_entries(votes: DataFrame, ratio: float) -> DataFrame:
    """Entries with at least ``ratio`` of their image's most votes."""
    top = votes.groupBy("image").agg(F.max("votes").alias("_top"))
    return votes.join(top, "image").where(F.col("votes") >= F.lit(float(ratio)) * F.col("_top")).drop("_top")


def dominant_theta(entries: DataFrame, weighted: bool = False) -> DataFrame:
    """(image, dominant): the angle with the most entries, then (``weighted``) the most votes; of equals the smallest."""
    counted = entries.groupBy("image", "theta").agg(F.count("*").alias("n"), F.sum("votes").alias("s"))
    rank = F.struct("n", "s", -F.col("theta")) if weighted else F.struct("n", -F.col("theta"))
    return counted.groupBy("image").agg(F.max_by("theta", rank).alias("dominant"))


def angle_distance(a: Column, b: Column) -> Column:
    """Degrees between two line directions, 0 to 90."""
    return F.abs(F.pmod(a - b + 90, F.lit(180)) - 90)


def family(entries: DataFrame, tolerance: float, turned: float = 0.0) -> DataFrame:
    """Entries within ``tolerance`` of their image's dominant angle turned by so many degrees."""
    near = entries.join(dominant_theta(entries), "image")
    return near.where(angle_distance(F.col("theta"), F.col("dominant") + turned) <= tolerance).drop("dominant")


def outer_lines(entries: DataFrame) -> DataFrame:
    """(image, low, high): the lines of least and of greatest rho; of equals the one with more votes."""
    low, high = _outer(F.lit(True))
    return entries.groupBy("image").agg(low.alias("low"), high.alias("high"))


def _outer(inside: Column) -> tuple[Column, Column]:
    """Aggregates of ``outer_lines`` over the entries for which ``inside`` holds; null without any."""
    line = F.struct("theta", "rho", "votes")
    low, high = F.struct("rho", -F.col("votes"), "theta"), F.struct("rho", "votes", -F.col("theta"))
    return F.min_by(line, F.when(inside, low)), F.max_by(line, F.when(inside, high))


#: Weights of votes, separation and outerness in a pair's score.
PAIR_WEIGHTS = (0.4, 0.3, 0.3)


def rho_profile(entries: DataFrame) -> DataFrame:
    """(image, rho, votes, theta): the strongest entry of each rho."""
    best = F.max_by("theta", F.struct("votes", -F.col("theta")))
    return entries.groupBy("image", "rho").agg(F.max("votes").alias("votes"), best.alias("theta"))


def spaced_candidates(entries: DataFrame, gap: int, most: int) -> DataFrame:
    """At most ``most`` local maxima of an image's rho profile, strongest first, at least ``gap`` bins apart."""
    profile = rho_profile(entries)
    peaks = signals.local_maxima(profile, ["image"], "rho", "votes")
    picks = signals.spaced_peaks(peaks, "image", "rho", "votes", gap).select("image", F.posexplode(F.slice("picks", 1, most)).alias("k", "rho"))
    return picks.join(profile, ["image", "rho"])


def pair_scores(candidates: DataFrame, accumulation: float = PAIR_WEIGHTS[0], separation: float = PAIR_WEIGHTS[1], outerness: float = PAIR_WEIGHTS[2]) -> DataFrame:
    """Unordered pairs of an image's candidates (a bounded number) with their score, best first by ``place``.

    The score weighs the weaker line's share of the most votes, the distance as a share of the widest, and how near
    both lines are to the outermost ones.
    """
    span = candidates.groupBy("image").agg(F.min("rho").alias("lo"), F.max("rho").alias("hi"), F.max("votes").alias("top"))
    side = lambda s: candidates.select("image", F.col("rho").alias(f"rho_{s}"), F.col("votes").alias(f"votes_{s}"))
    pairs = side("a").join(side("b"), "image").where("rho_a < rho_b").join(span, "image")
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    pairs = pairs.withColumn("accum", F.least("votes_a", "votes_b") / F.col("top")).withColumn("sep", unit((F.col("rho_b") - F.col("rho_a")) / width))
    outer = (unit(1 - (F.col("rho_a") - F.col("lo")) / width) + unit(1 - (F.col("hi") - F.col("rho_b")) / width)) / 2
    pairs = pairs.withColumn("outer", outer)
    score = accumulation * F.col("accum") + separation * F.col("sep") + outerness * F.col("outer")
    return pairs.select("image", "rho_a", "rho_b", "accum", "sep", "outer", score.alias("score"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The pair of the highest score; ties go by outerness, separation, votes, then the smaller rho."""
    rank = F.struct("score", "outer", "sep", "accum", -F.col("rho_a"), -F.col("rho_b"))
    return pairs.groupBy("image").agg(F.max_by(F.struct("rho_a", "rho_b", "score"), rank).alias("p")).select("image", "p.*")


def nearest_bin(value: Column, first: float, step: float, bins: int) -> Column:
    """The bin of a uniform grid nearest to a value; halfway the lower one, beyond the ends the last one."""
    place = F.ceil((value - first) / step - 0.5)
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), place)).cast("long")


def family_separation(families: DataFrame) -> DataFrame:
    """``sep``: the distance of a family's two lines as a share of the image's width along the family's normal, 0 to 1; -1
    without both. Columns: height, width, reference (degrees), and low, high (segments: arrays of two points)."""
    middle = lambda s: values.projected((F.col(f"{s}")[0]["x"] + F.col(f"{s}")[1]["x"]) / 2, (F.col(f"{s}")[0]["y"] + F.col(f"{s}")[1]["y"]) / 2, F.col("reference"))
    bounds = values.projected_bounds(F.col("height"), F.col("width"), F.col("reference"))
    span = bounds["high"] - bounds["low"]
    span = F.when(span > 0, span).otherwise(1.0)
    sep = values.clipped(F.abs(middle("high") - middle("low")) / span, 0.0, 1.0)
    return families.withColumn("sep", F.coalesce(F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), sep), F.lit(-1.0)))


def hybrid_families(by_votes: DataFrame, by_score: DataFrame) -> DataFrame:
    """Of an image's two families (image, sep, ...) the wider one, ``source`` says which; of equals that by votes."""
    both = by_votes.withColumn("source", F.lit("global")).unionByName(by_score.withColumn("source", F.lit("score")))
    rank = F.struct("sep", (F.col("source") == "global").cast("int"))
    return both.groupBy("image").agg(F.max_by(F.struct(*both.columns), rank).alias("_f")).select("_f.*")


def perpendicular_centre(dominant: Column, reference: Column | None = None) -> Column:
    """The direction across the dominant one, or across its family's reference where there is one."""
    anchor = dominant if reference is None else F.coalesce(reference, dominant)
    return values.wrapped_degrees(anchor + 90)


def nearest_entry(entries: DataFrame, target: float, least: int = 0, absolute: bool = False) -> DataFrame:
    """An image's entry of at least ``least`` votes nearest to a target angle (with ``absolute`` by absolute angle); then the most votes, the smallest rho."""
    theta = F.abs("theta") if absolute else F.col("theta")
    rank = F.struct(F.abs(theta - target), -F.col("votes"), F.col("rho"), F.col("theta"))
    return entries.where(F.col("votes") >= least).groupBy("image").agg(F.min_by(F.struct("theta", "rho", "votes"), rank).alias("_e")).select("image", "_e.*")


def rho_slice(votes: DataFrame, theta: int, least: float) -> DataFrame:
    """(image, rho, votes, log_votes, strong) of the entries at one angle; strong ones have ``least`` of the image's most votes."""
    top = votes.groupBy("image").agg(F.max("votes").alias("_top"))
    own = votes.where(F.col("theta") == theta).join(top, "image")
    return own.select("image", "rho", "votes", F.log1p("votes").alias("log_votes"), (F.col("votes") >= F.lit(float(least)) * F.col("_top")).alias("strong"))


def angle_votes(points: DataFrame, theta: float, first: float, step: float, bins: int) -> DataFrame:
    """(image, bin, votes) of points (image, x, y) at one angle (degrees); places beyond the ends count in the last bins."""
    place = values.clipped(F.rint((values.projected(F.col("x"), F.col("y"), F.lit(float(theta))) - first) / step), 0.0, float(bins - 1))
    return points.groupBy("image", place.cast("long").alias("bin")).agg(F.count("*").alias("votes"))


def smoothed_votes(votes: DataFrame, sigma_rho: float, sigma_theta: float, reach: float = 4.0) -> DataFrame:
    """(image, theta, rho, smooth): votes under a Gaussian in both directions, cut at ``reach`` deviations. Each entry
    sends its weighted votes to its neighbours, one direction after the other, and sums are made before they move."""

    def spread(df: DataFrame, column: str, sigma: float) -> DataFrame:
        if sigma <= 0:
            return df
        far = int(reach * sigma + 0.5)
        weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-far, far + 1)]
        kernel = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w / sum(weights)).alias("w")) for k, w in zip(range(-far, far + 1), weights, strict=True)))
        sent = df.withColumn("_k", F.explode(kernel)).withColumn(column, F.col(column) + F.col("_k.k"))
        return sent.groupBy("image", "theta", "rho").agg(F.sum(F.col("smooth") * F.col("_k.w")).alias("smooth"))

    start = votes.select("image", "theta", "rho", F.col("votes").cast("double").alias("smooth"))
    return spread(spread(start, "rho", sigma_rho), "theta", sigma_theta)


#: The bounds of a grid, two of the dominant family and two across it.
BOUNDS = ("D_min", "D_max", "P_min", "P_max")


def bounds_side_by_side(bounds: DataFrame, selectors: list[str]) -> DataFrame:
    """(image, label, one column a selector) of bounds (image, selector, label, rho): all four labels of each image, "-" where missing."""
    labels = F.explode(F.array(*map(F.lit, BOUNDS))).alias("label")
    every = bounds.select("image").distinct().select("image", labels)
    picked = [F.max(F.when(F.col("selector") == s, F.col("rho").cast("string"))).alias(s) for s in selectors]
    found = bounds.groupBy("image", "label").agg(*picked)
    return every.join(found, ["image", "label"], "left").fillna("-", selectors)


def labelled_pairs(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs (image, rho_a, rho_b, ...) with the names of both candidates (image, rho, name); an unknown one is null."""
    for side in ("a", "b"):
        own = candidates.select("image", F.col("rho").alias(f"rho_{side}"), F.col("name").alias(f"name_{side}"))
        pairs = pairs.join(own, ["image", f"rho_{side}"], "left")
    return pairs


def window_candidates(votes: DataFrame, peaks: DataFrame, centre: float, rho_reach: float, theta: float, theta_reach: float) -> DataFrame:
    """Entries of a window in rho and angle, ``is_peak`` tells those that are peaks (image, theta, rho)."""
    near = votes.where(values.within_windows((F.col("rho"), centre, rho_reach), (F.col("theta"), theta, theta_reach)))
    known = peaks.select("image", "theta", "rho", F.lit(True).alias("is_peak")).distinct()
    return near.join(known, ["image", "theta", "rho"], "left").withColumn("is_peak", F.coalesce("is_peak", F.lit(False)))


def peaks(votes: DataFrame, reach_rho: int, reach_theta: int, ratio: float) -> DataFrame:
    """Entries with at least ``ratio`` of their image's most votes that no entry around them exceeds, so many rho bins and
    degrees away at most. Each strong entry asks its neighbours: cells of one reach on a side, nine to a question."""
    strong = strong_entries(votes, ratio)
    cell = lambda r, t: (F.floor(r / (reach_rho + 1)).alias("_r"), F.floor(t / (reach_theta + 1)).alias("_t"))
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("_n")
    asked = strong.select("*", *cell(F.col("rho"), F.col("theta"))).select("*", around)
    asked = asked.withColumn("_r", F.col("_r") + F.col("_n.a")).withColumn("_t", F.col("_t") + F.col("_n.b")).drop("_n")
    others = votes.select("image", *cell(F.col("rho"), F.col("theta")), F.col("rho").alias("_rho"), F.col("theta").alias("_theta"), F.col("votes").alias("_votes"))
    near = (F.abs(F.col("rho") - F.col("_rho")) <= reach_rho) & (F.abs(F.col("theta") - F.col("_theta")) <= reach_theta)
    best = asked.join(others, ["image", "_r", "_t"]).where(near).groupBy("image", "theta", "rho", "votes").agg(F.max("_votes").alias("_top"))
    return best.where("_top <= votes").drop("_top")


def boundary_grid(votes: DataFrame, ratio: float, tolerance: float) -> DataFrame:
    """(image, label, theta, rho, votes): the outer lines of the dominant family and of the family across it, all found in one pass."""
    strong = strong_entries(votes, ratio)
    near = strong.join(dominant_theta(strong), "image")
    found = []
    for letter, turned in (("D", 0.0), ("P", 90.0)):
        ends = _outer(angle_distance(F.col("theta"), F.col("dominant") + turned) <= tolerance)
        found += [line.alias(f"{letter}_{name}") for line, name in zip(ends, ("min", "max"), strict=True)]
    ends = near.groupBy("image").agg(*found)
    rows = F.explode(F.array(*(F.struct(F.lit(label).alias("label"), F.col(label).alias("line")) for label in BOUNDS))).alias("_e")
    return ends.select("image", rows).where("_e.line IS NOT NULL").select("image", "_e.label", "_e.line.*")


def chosen_grid(votes: DataFrame, pictures: DataFrame, ratio: float, tolerance: float, gap: int, most: int, step: float = 1.0) -> DataFrame:
    """(image, label, theta, rho, votes, source): the two bounds of the dominant family and the two of the family across it.

    Each family has two pairs of lines to choose from: ``global``, the outer ones of its entries of at least ``ratio`` of the most votes, and
    ``score``, the best pair (see ``pair_scores``) of at most ``most`` peaks of all votes near its angle that are ``gap`` bins apart, and of the
    outer entries, which are candidates in any case. The pair that is farther apart in the picture (pictures: image, height, width; ``step``: pixels a bin) is
    taken, of equals the outer entries. A family without entries has no bounds.
    """
    strong = strong_entries(votes, ratio)
    dominant = dominant_theta(strong)
    found = []
    for letter, turned in (("D", 0.0), ("P", 90.0)):
        near = lambda df: df.join(dominant, "image").where(angle_distance(F.col("theta"), F.col("dominant") + turned) <= tolerance).drop("dominant")  # noqa: E731, B023
        outer = outer_lines(near(strong))
        forced = outer.select("image", F.explode(F.array("low", "high")).alias("_e")).select("image", "_e.*")
        peaks_near = spaced_candidates(near(votes), gap, most).select("image", "theta", "rho", "votes")
        candidates = rho_profile(peaks_near.unionByName(forced))
        pair = best_pair(pair_scores(candidates)).drop("score")
        for side, name in (("a", "low"), ("b", "high")):
            line = candidates.select("image", F.col("rho").alias(f"rho_{side}"), F.struct("theta", "rho", "votes").alias(name))
            pair = pair.join(line, ["image", f"rho_{side}"])

        def placed(lines_of: DataFrame) -> DataFrame:
            rows = lines_of.select("image", F.col("low").alias("low_line"), F.col("high").alias("high_line")).join(pictures, "image").join(dominant, "image")
            ends = {e: values.box_points(F.col(f"{e}_line.rho") * step, F.radians(F.col(f"{e}_line.theta").cast("double")), F.col("height"), F.col("width")) for e in ("low", "high")}
            return family_separation(rows.withColumn("reference", F.col("dominant") + turned).withColumns(ends))  # noqa: B023

        chosen = hybrid_families(placed(outer), placed(pair))
        for end, name in (("low", "min"), ("high", "max")):
            found.append(chosen.select("image", F.lit(f"{letter}_{name}").alias("label"), f"{end}_line.*", "source"))
    return reduce(DataFrame.unionByName, found)
