"""Scalar functions on numbers, angles, lines and labels, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sharpened(p: Column, beta: float, eps: float = 1e-6) -> Column:
    """The probability whose odds are the given one's to the power of ``beta``."""
    p = clipped(p, eps, 1 - eps)
    odds = F.pow(p / (1 - p), F.lit(float(beta)))
    return odds / (1 + odds)


def as_byte(x: Column) -> Column:
    """[0, 1] as 0 to 255, halves to the even number."""
    return clipped(F.rint(x * 255), 0.0, 255.0).cast("int")


def gamma(x: Column, power: float) -> Column:
    """[0, 1] clipped, to a power."""
    return F.pow(clipped(x, 0.0, 1.0), F.lit(float(power)))


def unsharp(x: Column, blurred: Column, amount: float) -> Column:
    return clipped(x + amount * (x - blurred), 0.0, 1.0)


def wrapped_degrees(theta: Column) -> Column:
    """A line's direction in [-90, 90)."""
    return F.pmod(theta + 90.0, F.lit(180.0)) - 90.0


def projected(x: Column, y: Column, theta: Column) -> Column:
    """A point's place along the normal of direction ``theta`` (degrees)."""
    return x * F.cos(F.radians(theta)) + y * F.sin(F.radians(theta))


def canonical_line(rho: Column, theta: Column) -> Column:
    """(rho, theta) with theta (radians, in [0, pi)) brought to [-pi/2, pi/2)."""
    turn = theta >= math.pi / 2
    return F.struct(F.when(turn, -rho).otherwise(rho).alias("rho"), F.when(turn, theta - math.pi).otherwise(theta).alias("theta"))


def box_points(rho: Column, theta: Column, height: Column, width: Column) -> Column:
    """The first two distinct points (x, y) in which a line (theta in radians) meets the border of an image, else null:
    left, right, upper, lower edge in turn."""
    c, s = F.cos(theta), F.sin(theta)
    steep, flat = F.abs(s) > 1e-8, F.abs(c) > 1e-8
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    within = lambda v, size: (v >= 0) & (v <= size - 1)
    left, right = F.try_divide(rho, s), F.try_divide(rho - (width - 1) * c, s)
    upper, lower = F.try_divide(rho, c), F.try_divide(rho - (height - 1) * s, c)
    found = F.array_compact(
        F.array(
            F.when(steep & within(left, height), point(F.lit(0.0), left)),
            F.when(steep & within(right, height), point(width - 1, right)),
            F.when(flat & within(upper, width), point(upper, F.lit(0.0))),
            F.when(flat & within(lower, width), point(lower, height - 1)),
        )
    )
    new = lambda done, p: ~F.exists(done, lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]) < 1e-6)
    empty = F.array().cast("array<struct<x:double,y:double>>")
    points = F.aggregate(found, empty, lambda done, p: F.when(new(done, p), F.concat(done, F.array(p))).otherwise(done))
    return F.when(F.size(points) >= 2, F.slice(points, 1, 2))


def projected_bounds(height: Column, width: Column, theta: Column) -> Column:
    """(low, high) of the image's four corners along the normal of direction ``theta`` (degrees)."""
    zero = F.lit(0.0)
    corners = [projected(x, y, theta) for x, y in ((zero, zero), (width - 1, zero), (zero, height - 1), (width - 1, height - 1))]
    return F.struct(F.least(*corners).alias("low"), F.greatest(*corners).alias("high"))


def outside_window(x: Column, low: float, high: float) -> Column:
    """How far a value lies outside a window, in widths of it; 0 inside."""
    width = max(high - low, 1e-8)
    return F.when(x < low, (low - x) / width).when(x > high, (x - high) / width).otherwise(0.0)


def within_windows(*windows: tuple[Column, float, float]) -> Column:
    """Whether every value is at most its reach away from its centre: (value, centre, reach)."""
    out = F.lit(True)
    for value, centre, reach in windows:
        out = out & (F.abs(value - centre) <= reach)
    return out


def pixel_to_mv(y: Column, baseline: Column, px_per_mm: Column, mv_per_mm: float = 0.1) -> Column:
    return (baseline - y) / px_per_mm * mv_per_mm


def mv_to_pixel(mv: Column, baseline: Column, px_per_mm: Column, mv_per_mm: float = 0.1) -> Column:
    return baseline - mv / mv_per_mm * px_per_mm


def decibels(ratio: Column) -> Column:
    return 10 * F.log10(ratio)


def steps(rows: Column, batch: int, accumulation: int, parts: int) -> Column:
    """(steps of an epoch, steps between saves)."""
    n = F.ceil(rows / (batch * accumulation))
    return F.struct(n.alias("steps"), F.greatest(F.lit(1), F.floor(n / parts)).alias("every"))


def axis_bounds(low: Column, high: Column, fixed_low: float | None = None, fixed_high: float | None = None) -> Column:
    """(low, high) of an axis over data bounds: 5 % (0.05 at least) either way where both are the same, then a tenth as a
    margin at each end that isn't fixed."""
    a, b = F.lit(fixed_low) if fixed_low is not None else low, F.lit(fixed_high) if fixed_high is not None else high
    same = a == b
    more = F.greatest(F.abs(a) * 0.05, F.lit(0.05))
    a, b = F.when(same, a - more).otherwise(a), F.when(same, b + more).otherwise(b)
    pad = (b - a) * 0.1
    return F.struct((a - (0 if fixed_low is not None else pad)).alias("low"), (b + (0 if fixed_high is not None else pad)).alias("high"))


def clock(seconds: Column) -> Column:
    """Minutes and seconds as 02m05s; halves of a second go to the even one."""
    return F.format_string("%02dm%02ds", F.floor(seconds / 60).cast("long"), F.rint(F.pmod(seconds, F.lit(60.0))).cast("long"))


def html_escaped(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def joined(values: Column, separator: str = "/") -> Column:
    """An array as one text; null becomes empty."""
    return F.coalesce(F.array_join(values, separator), F.lit(""))


def trailing_int(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)$", 1).try_cast("long")


def file_stem(path: Column) -> Column:
    """The name in a path without its last extension."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def alias(value: Column, names: dict[str, str]) -> Column:
    """The full name of a trimmed, lower-cased short one; an unknown one is an error that lists those allowed."""
    key = F.lower(F.trim(value))
    wrong = F.raise_error(F.concat(F.lit("unknown name "), F.coalesce(value, F.lit("null")), F.lit(", allowed: " + ", ".join(sorted(names)))))
    out = wrong.cast("string")
    for short, name in names.items():
        out = F.when(key == short, name).otherwise(out)
    return out


def to_long(text: Column) -> Column:
    """A whole number, or null where the text is none or has a fraction."""
    number = F.trim(text.cast("string")).try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("long"))


def fraction_slice(values: Column, low: float, high: float) -> Column:
    """Elements from ``low`` to ``high`` of an array's length, both rounded with halves to the even number."""
    a, b = (F.rint(F.lit(float(x)) * F.size(values)).cast("int") for x in (low, high))
    return F.slice(values, a + 1, F.greatest(b - a, F.lit(0)))


def evenly(low: float, high: float, n: int) -> Column:
    """``n`` evenly spaced numbers from ``low`` to ``high``."""
    step = (high - low) / max(1, n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: low + step * k)


def hue_range(h: Column, s: Column, v: Column, ranges: Sequence[tuple[Sequence[int], Sequence[int]]]) -> Column:
    """Whether a colour lies in one of several boxes (lower, upper), ends included."""
    out = F.lit(False)
    for low, high in ranges:
        out = out | (h.between(low[0], high[0]) & s.between(low[1], high[1]) & v.between(low[2], high[2]))
    return out


#: Boxes of hue (0 to 180), saturation and value that are red.
RED = (((0, 50, 50), (10, 255, 255)), ((170, 50, 50), (180, 255, 255)))


def quad_accepted(x0: Column, y0: Column, x1: Column, y1: Column, area: Column, height: Column, width: Column, margin: int = 10, aspect: float = 1.1, share: float = 0.08) -> Column:
    """Whether a region is a page: away from the border, landscape, and over a share of the image."""
    border = (x0 <= margin) | (y0 <= margin) | (x1 >= width - 1 - margin) | (y1 >= height - 1 - margin)
    one = F.lit(1.0)
    return ~border & (F.greatest(one, x1 - x0) / F.greatest(one, y1 - y0) >= aspect) & (area / (height * width) > share)
