"""Queries on segments, edges, outlines and warped pictures, made from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import edges, segments, warps
from tessera.plans.picture_queries import _GRID, _grid
from tessera.session import table

HEIGHT, WIDTH = 64, 48


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("image")).distinct().withColumn("height", F.lit(HEIGHT)).withColumn("width", F.lit(WIDTH))


def line_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of each picture's pixels of a value divisible by 7."""
    mask = _grid(spark, d).where("pmod(v, 7) = 0")
    return segments.segments(mask, angles=12, step=3.0, threshold=14, length=20.0, gap=9.0, shares=2)


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """The grid with 0 where it has no pixel."""
    cells = _sizes(spark, d).select("image", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), "width")
    cells = cells.select("image", F.col("y").cast("long").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("width").cast("long") - 1)).alias("x"))
    return cells.join(_grid(spark, d), ["image", "y", "x"], "left").fillna(0.0, ["v"])


def thin_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges.thin_edges(_whole(spark, d), 90.0, 420.0, sigma=0.0)


def contour_energies(spark: SparkSession, d: str) -> DataFrame:
    """Every energy of a contour except thin edges, side by side."""
    g = _grid(spark, d)
    found = {
        "gaussian": edges.energy(g, "gaussian", sigma=0.5),
        "sobel": edges.energy(g, "sobel", power=0.5, border=2, size=(HEIGHT, WIDTH)),
        "sobel_binary": edges.energy(g, "sobel_binary", binary_threshold=0.3),
        "laplace_abs": edges.energy(g, "laplace_abs"),
        "laplace_abs_inv": edges.energy(g, "laplace_abs_inv"),
    }
    out = g.select("image", "y", "x")
    for name, e in found.items():
        out = out.join(e.select("image", "y", "x", (F.round("v", 5) + F.lit(0.0)).alias(name)), ["image", "y", "x"])
    return out


def rectified_pages(spark: SparkSession, d: str) -> DataFrame:
    """The quadrilateral of the outermost pixels of high values, upright."""
    g = _grid(spark, d)
    corners = warps.ordered_corners(g.where("pmod(v, 11) = 0 AND y BETWEEN 6 AND 55 AND x BETWEEN 5 AND 40").select("image", "x", "y"))
    return warps.rectified(g, corners, 40, 30).withColumn("v", F.round("v", 4))


def equalised_tiles(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d).withColumn("v", F.pmod("v", F.lit(256.0)))
    return warps.equalised(g, _sizes(spark, d), tiles=4, limit=3.0)


def polygon_masks(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events in order as the corners of an outline that crosses itself many times."""
    e = table(spark, d, "events").select(F.col("user_id").alias("image"), F.col("event_id").alias("k"), F.pmod("event_id", F.lit(41)).alias("y"), F.pmod(F.floor("value"), F.lit(53)).alias("x"))
    return edges.polygon_mask(e)


def resized_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Each picture at most 37 pixels long, and brought up from there to 50 by 90."""
    g, sizes = _grid(spark, d), warps.fitted_sizes(_sizes(spark, d), 37)
    small = warps.resized(g, sizes)
    again = sizes.select("image", F.col("new_height").alias("height"), F.col("new_width").alias("width"), F.lit(50).alias("new_height"), F.lit(90).alias("new_width"))
    both = small.withColumn("size", F.lit("small")).union(warps.resized(small, again).withColumn("size", F.lit("large")))
    return both.withColumn("v", F.round(F.col("v") + 1e-8, 5))


QUERIES = {f.__name__: f for f in (line_segments, thin_edges, contour_energies, rectified_pages, equalised_tiles, polygon_masks, resized_pictures)}

_SEGMENTS = f"""WITH RECURSIVE {_GRID},
    w AS (
      SELECT image, 0 AS b, 'pixel' AS kind, y::BIGINT AS y, x::BIGINT AS x, (('0x' || substr(md5('0:' || image || ':' || y || ':' || x), 1, 4))::INT * 2 // 65536)::INT AS share,
             0 AS theta, 0::BIGINT AS rho, 0::BIGINT AS y1, 0::BIGINT AS x1, 0::BIGINT AS pixels FROM g WHERE v % 7 = 0
      UNION ALL
      (WITH cells AS (
         SELECT w.image, b, y, x, share, t.theta::INT AS theta, round((x * cos(t.theta * (pi() / 12)) + y * sin(t.theta * (pi() / 12))) / 3.0::DOUBLE + 1e-7::DOUBLE)::BIGINT AS rho
         FROM w, range(12) t(theta) WHERE kind = 'pixel'),
       votes AS (SELECT image, theta, rho, count(*) FILTER (share <= b) AS votes FROM cells GROUP BY 1, 2, 3),
       able AS (SELECT * FROM votes WHERE votes >= 14 AND NOT EXISTS (SELECT 1 FROM w WHERE w.kind = 'dead' AND w.image = votes.image AND w.theta = votes.theta AND w.rho = votes.rho)),
       best AS (SELECT image, arg_max(theta, (votes, -theta, -rho)) AS theta, arg_max(rho, (votes, -theta, -rho)) AS rho FROM able GROUP BY 1),
       placed AS (SELECT c.image, c.b, y, x, c.theta, c.rho, round(y * cos(c.theta * (pi() / 12)) - x * sin(c.theta * (pi() / 12)), 6) AS pos FROM cells c JOIN best USING (image, theta, rho)),
       gaps AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY image ORDER BY pos, y, x) <= 9 THEN 0 ELSE 1 END AS new FROM placed),
       runs AS (SELECT *, sum(new) OVER (PARTITION BY image ORDER BY pos, y, x) AS run FROM gaps),
       whole AS (SELECT image, run, count(*) AS pixels, min((pos, y, x)) AS first, max((pos, y, x)) AS last, max(pos) - min(pos) >= 20 - 1e-6::DOUBLE AS long FROM runs GROUP BY 1, 2),
       taken AS (SELECT r.image, r.y, r.x FROM runs r JOIN whole USING (image, run) WHERE long),
       ends AS (SELECT DISTINCT w.image, w.b FROM w WHERE kind = 'pixel' AND b = 1 AND image NOT IN (SELECT image FROM best)),
       onward AS (SELECT w.*, CASE WHEN w.image IN (SELECT image FROM best) THEN w.b ELSE w.b + 1 END AS then_b FROM w WHERE kind <> 'segment' AND w.image NOT IN (SELECT image FROM ends))
       SELECT image, then_b, kind, y, x, share, theta, rho, y1, x1, pixels FROM onward o
       WHERE kind = 'dead' OR NOT EXISTS (SELECT 1 FROM taken t WHERE t.image = o.image AND t.y = o.y AND t.x = o.x)
       UNION ALL
       SELECT DISTINCT image, b, 'dead', 0, 0, 0, theta, rho, 0, 0, 0 FROM placed
       UNION ALL
       SELECT DISTINCT p.image, p.b, 'segment', first[2]::BIGINT, first[3]::BIGINT, 0, p.theta, p.rho, last[2]::BIGINT, last[3]::BIGINT, whole.pixels
       FROM placed p JOIN whole USING (image) WHERE long))
    SELECT image, theta, rho, y AS y0, x AS x0, y1, x1, pixels FROM w WHERE kind = 'segment'"""

_SOBEL = """k AS (SELECT unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS dy, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS dx, unnest([-1, 0, 1, -2, 2, -1, 0, 1]) AS wx, unnest([-1, -2, -1, 0, 0, 1, 2, 1]) AS wy),
    s AS (SELECT c.image, c.y, c.x, coalesce(sum(g.v * wy), 0)::DOUBLE AS gy, coalesce(sum(g.v * wx), 0)::DOUBLE AS gx, sqrt(pow(coalesce(sum(g.v * wy), 0), 2) + pow(coalesce(sum(g.v * wx), 0), 2)) AS m
          FROM g c CROSS JOIN k LEFT JOIN g ON g.image = c.image AND g.y = c.y + dy AND g.x = c.x + dx GROUP BY 1, 2, 3)"""
_UNIT = "CASE WHEN max({0}) OVER w - min({0}) OVER w < 1e-8::DOUBLE THEN 0 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"
_OVERLAP = """SELECT image, cy AS y, cx AS x, sum(v * oy * ox) / sum(oy * ox) AS v
    FROM (SELECT image, v, c.y AS cy, d.x AS cx, least((p.y + 1) * {nh}, (c.y + 1) * {h}) - greatest(p.y * {nh}, c.y * {h}) AS oy, least((p.x + 1) * {nw}, (d.x + 1) * {w}) - greatest(p.x * {nw}, d.x * {w}) AS ox
          FROM {of} p, range({nh}) c(y), range({nw}) d(x)) WHERE oy > 0 AND ox > 0 GROUP BY 1, 2, 3"""

ORACLES = {
    "line_segments": _SEGMENTS,
    "thin_edges": f"""WITH RECURSIVE {_GRID.replace('g AS', 'h AS')}, z AS (SELECT DISTINCT event_type AS image FROM events),
        g AS (SELECT z.image, r.y, q.x, coalesce(h.v, 0) AS v FROM z, range(64) r(y), range(48) q(x) LEFT JOIN h ON h.image = z.image AND h.y = r.y AND h.x = q.x), {_SOBEL},
        n AS (SELECT c.image, c.y, c.x, c.gy, c.gx, c.m, map(list((o.y - c.y) * 10 + o.x - c.x), list(o.m)) AS a FROM s c JOIN s o ON o.image = c.image AND abs(o.y - c.y) <= 1 AND abs(o.x - c.x) <= 1
              GROUP BY ALL HAVING count(*) = 9 AND c.m > 0),
        d AS (SELECT *, abs(gy) >= abs(gx) AS steep, CASE WHEN gy * gx >= 0 THEN 11 WHEN abs(gy) >= abs(gx) THEN 9 ELSE -9 END AS aslant, least(abs(gx), abs(gy)) / greatest(abs(gx), abs(gy)) AS q FROM n),
        r AS (SELECT image, y, x, m FROM d WHERE m >= 90
              AND q * a[aslant] + (1 - q) * a[CASE WHEN steep THEN 10 ELSE 1 END] <= m + 1e-9::DOUBLE AND q * a[-aslant] + (1 - q) * a[CASE WHEN steep THEN -10 ELSE -1 END] <= m + 1e-9::DOUBLE),
        e AS (SELECT image, y, x FROM r WHERE m >= 420 UNION SELECT r.image, r.y, r.x FROM e JOIN r ON r.image = e.image AND abs(r.y - e.y) <= 1 AND abs(r.x - e.x) <= 1)
        SELECT * FROM e""",
    "contour_energies": f"""WITH {_GRID}, {_SOBEL},
        t AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d, exp(-0.5::DOUBLE * pow(unnest([-2, -1, 0, 1, 2]) / 0.5::DOUBLE, 2)) AS w),
        bx AS (SELECT c.image, c.y, c.x, sum(g.v * t.w) / sum(t.w) AS v FROM g c, t JOIN g ON g.image = c.image AND g.y = c.y AND g.x = c.x + t.d GROUP BY 1, 2, 3),
        bb AS (SELECT c.image, c.y, c.x, sum(g.v * t.w) / sum(t.w) AS b FROM bx c, t JOIN bx g ON g.image = c.image AND g.x = c.x AND g.y = c.y + t.d GROUP BY 1, 2, 3),
        q AS (SELECT c.image, c.y, c.x, abs(coalesce(sum(CASE WHEN g.y = c.y AND g.x = c.x THEN -4 * g.v ELSE g.v END), 0)) AS l
              FROM g c JOIN g ON g.image = c.image AND abs(g.y - c.y) + abs(g.x - c.x) <= 1 GROUP BY 1, 2, 3),
        u AS (SELECT image, y, x, {_UNIT.format('b')} AS b, {_UNIT.format('m')} AS m, {_UNIT.format('l')} AS l FROM bb JOIN s USING (image, y, x) JOIN q USING (image, y, x) WINDOW w AS (PARTITION BY image)),
        p AS (SELECT *, sqrt(m) AS r, 1 - l AS i FROM u),
        o AS (SELECT image, y, x, b, m, l, {_UNIT.format('r')} AS r, {_UNIT.format('i')} AS i FROM p WINDOW w AS (PARTITION BY image))
        SELECT image, y, x, round(b, 5) AS gaussian, CASE WHEN y BETWEEN 2 AND 61 AND x BETWEEN 2 AND 45 THEN round(r, 5) ELSE 0 END AS sobel,
               CASE WHEN m >= 0.3::DOUBLE THEN 1.0::DOUBLE ELSE 0 END AS sobel_binary, round(l, 5) AS laplace_abs, round(i, 5) AS laplace_abs_inv FROM o""",
    "rectified_pages": f"""WITH {_GRID}, c AS (SELECT image, y, x FROM g WHERE v % 11 = 0 AND y BETWEEN 6 AND 55 AND x BETWEEN 5 AND 40),
        q AS (SELECT image, arg_min((x, y), (x + y, y, x)) AS a, arg_min((x, y), (y - x, y, x)) AS b, arg_max((x, y), (x + y, y, x)) AS c, arg_max((x, y), (y - x, y, x)) AS d FROM c GROUP BY 1),
        p AS (SELECT image, a[1]::DOUBLE AS x0, a[2]::DOUBLE AS y0, b[1]::DOUBLE AS x1, b[2]::DOUBLE AS y1, c[1]::DOUBLE AS x2, c[2]::DOUBLE AS y2, d[1]::DOUBLE AS x3, d[2]::DOUBLE AS y3 FROM q),
        -- the map as a sum of three corners in homogeneous coordinates, whose factors make it meet the fourth
        h AS (SELECT *, (x3 - x2) * (y0 - y2) - (x0 - x2) * (y3 - y2) AS k1, (x2 - x1) * (y0 - y1) - (x0 - x1) * (y2 - y1) AS k3, (x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1) AS k0 FROM p),
        f AS (SELECT *, k0 * (1 - u - v) AS w0, k1 * u AS w1, k3 * v AS w3 FROM (SELECT h.*, r.y, s.x, s.x / 29.0::DOUBLE AS u, r.y / 39.0::DOUBLE AS v FROM h, range(40) r(y), range(30) s(x) WHERE k0 <> 0)),
        e AS (SELECT image, y, x, round((w0 * x0 + w1 * x1 + w3 * x3) / (w0 + w1 + w3), 9) AS sx, round((w0 * y0 + w1 * y1 + w3 * y3) / (w0 + w1 + w3), 9) AS sy FROM f WHERE w0 + w1 + w3 <> 0),
        a AS (SELECT e.image, e.y, e.x, floor(sy)::BIGINT + j AS gy, floor(sx)::BIGINT + i AS gx, (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) AS w
              FROM e, range(2) t(j), range(2) o(i))
        SELECT a.image, a.y, a.x, round(sum(coalesce(g.v, 0) * w), 4) AS v FROM a LEFT JOIN g ON g.image = a.image AND g.y = gy AND g.x = gx GROUP BY 1, 2, 3""",
    "equalised_tiles": f"""WITH {_GRID}, p AS (SELECT image, y, x, (v % 256)::INT AS v FROM g),
        a AS (SELECT image, y // 16 AS r, x // 12 AS c, count(*) AS area, greatest(1, floor(3.0::DOUBLE * count(*) / 256))::INT AS most FROM p GROUP BY 1, 2, 3),
        n AS (SELECT image, y // 16 AS r, x // 12 AS c, v, count(*) AS n FROM p GROUP BY 1, 2, 3, 4),
        f AS (SELECT image, r, c, k.v::INT AS v, area, most, coalesce(n, 0) AS n FROM a CROSS JOIN range(256) k(v) LEFT JOIN n USING (image, r, c, v)),
        e AS (SELECT image, r, c, sum(greatest(n - most, 0))::BIGINT AS extra FROM f GROUP BY 1, 2, 3),
        d AS (SELECT *, CASE WHEN extra % 256 > 0 THEN greatest(1, 256 // (extra % 256)) ELSE 1 END AS step FROM f JOIN e USING (image, r, c)),
        h AS (SELECT *, least(n, most) + extra // 256 + (v % step = 0 AND v // step < extra % 256)::INT AS m FROM d),
        t AS (SELECT image, r, c, v, round_even(sum(m) OVER (PARTITION BY image, r, c ORDER BY v) * 255.0::DOUBLE / area, 0) AS t FROM h),
        q AS (SELECT p.*, y / 16.0::DOUBLE - 0.5::DOUBLE AS py, x / 12.0::DOUBLE - 0.5::DOUBLE AS px FROM p),
        b AS (SELECT q.image, q.y, q.x, q.v, greatest(0, least(3, floor(py)::INT + j)) AS r, greatest(0, least(3, floor(px)::INT + i)) AS c,
                     (CASE WHEN j = 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) * (CASE WHEN i = 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) AS w FROM q, range(2) o(j), range(2) u(i))
        SELECT image, y, x, round_even(round(sum(t * w) / sum(w), 9), 0)::INT AS v FROM b JOIN t USING (image, r, c, v) GROUP BY 1, 2, 3""",
    "polygon_masks": """WITH c AS (SELECT user_id AS image, event_id AS k, event_id % 41 AS y, floor(value)::BIGINT % 53 AS x FROM events),
        e AS (SELECT image, y AS ya, x AS xa, coalesce(lead(y) OVER w, first_value(y) OVER w) AS yb, coalesce(lead(x) OVER w, first_value(x) OVER w) AS xb FROM c WINDOW w AS (PARTITION BY image ORDER BY k, y, x)),
        o AS (SELECT image, least(ya, yb) AS y0, greatest(ya, yb) AS y1, CASE WHEN ya <= yb THEN xa ELSE xb END AS x0, CASE WHEN ya <= yb THEN xb ELSE xa END AS x1 FROM e),
        r AS (SELECT o.*, t.y, round(x0 + (t.y - y0) * (x1 - x0) / (y1 - y0)::DOUBLE, 9) AS xc FROM o JOIN range(41) t(y) ON t.y BETWEEN y0 AND y1)
        SELECT image, r.y, p.x FROM r, range(53) p(x) GROUP BY 1, 2, 3
        HAVING count(*) FILTER (y0 < y1 AND r.y < y1 AND xc < p.x) % 2 = 1 OR bool_or(CASE WHEN y0 = y1 THEN p.x BETWEEN least(x0, x1) AND greatest(x0, x1) ELSE xc = p.x END)""",
    "resized_pictures": f"""WITH {_GRID}, s AS ({_OVERLAP.format(of='g', h=64, w=48, nh=37, nw=28)}), l AS ({_OVERLAP.format(of='s', h=37, w=28, nh=50, nw=90)})
        SELECT image, y, x, round(v + 1e-8, 5) AS v, 'small' AS size FROM s UNION ALL SELECT image, y, x, round(v + 1e-8, 5), 'large' FROM l""",
}
