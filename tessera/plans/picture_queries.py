"""Queries on pixel grids and line votes made from the event table, and on models of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import images, kernels, learning, lines, signals
from tessera.session import table

SIDE = 64


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """Pixels (image, y, x, v): each event type's greatest whole value at user mod 64 and event mod 48."""
    e = table(spark, d, "events").select(F.col("event_type").alias("image"), F.pmod("user_id", F.lit(SIDE)).alias("y"), F.pmod("event_id", F.lit(48)).alias("x"), "value")
    return e.groupBy("image", "y", "x").agg(F.floor(F.max("value")).cast("double").alias("v"))


def _mask(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("pmod(v, 5) < 3").drop("v")


def stencil_3x3(spark: SparkSession, d: str) -> DataFrame:
    kernel = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
    return images.stencil(_grid(spark, d), kernel)


def grey_closing(spark: SparkSession, d: str) -> DataFrame:
    return images.closed(_grid(spark, d), 1)


def ink_removal(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d).withColumn("v", F.pmod("v", F.lit(256.0)) / 255)
    return images.ink_removed(g, 1).withColumn("v", F.round("v", 6))


def pyramid_down(spark: SparkSession, d: str) -> DataFrame:
    return images.pyramid_down(_grid(spark, d)).withColumn("v", F.round("v", 5))


def pyramid_round_trip(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    differences, smallest = images.laplacian_levels(g, 2)
    return images.reconstructed(differences, smallest).withColumn("v", F.round("v", 5) + F.lit(0.0))


def pyramid_details(spark: SparkSession, d: str) -> DataFrame:
    """What the smaller level, brought back to size, leaves of each pixel."""
    differences, _ = images.laplacian_levels(_grid(spark, d), 1)
    return differences[0].withColumn("v", F.round(F.col("v") + 1e-8, 5) + F.lit(0.0))


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    found = images.components(_mask(spark, d))
    return images.boxes(found, ["image", "component"]).withColumn("fill", F.round("fill", 6))


def corner_points(spark: SparkSession, d: str) -> DataFrame:
    c = images.corners(_mask(spark, d), ["image"])
    return c.select("image", *(F.col(f"{p}.{a}").alias(f"{p}_{a}") for p in ("top_left", "top_right", "bottom_right", "bottom_left") for a in ("y", "x")))


def radial_profile(spark: SparkSession, d: str) -> DataFrame:
    return images.radial_profile(_grid(spark, d), SIDE / 2, 24.0).withColumn("v", F.round("v", 6))


def block_correction(spark: SparkSession, d: str) -> DataFrame:
    pairs = _grid(spark, d).select("image", "y", "x", F.pmod("v", F.lit(128.0)).alias("work"), F.pmod(F.col("v") * 7 + F.col("x"), F.lit(256.0)).alias("clean"))
    return images.block_corrected(pairs, block=16)


def _votes(spark: SparkSession, d: str) -> DataFrame:
    points = _grid(spark, d).select("image", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return signals.hough_votes(points, 36, 4.0).withColumn("theta", F.col("theta") * 5)


def hough_threshold(spark: SparkSession, d: str) -> DataFrame:
    return lines.strong_entries(_votes(spark, d), 0.6).withColumn("theta", F.col("theta").cast("long"))


def hough_dominant_family(spark: SparkSession, d: str) -> DataFrame:
    entries = lines.strong_entries(_votes(spark, d), 0.6)
    outer = lines.outer_lines(lines.family(entries, 10.0))
    weighted = lines.dominant_theta(entries, weighted=True)
    return outer.join(weighted, "image").select("image", F.col("low.rho").alias("low_rho"), F.col("high.rho").alias("high_rho"), F.col("dominant").cast("long").alias("dominant"))


def hough_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Best pair of spaced candidates for each image; candidates are picked greedily, which has no SQL form."""
    candidates = lines.spaced_candidates(_votes(spark, d), 3, 12)
    return lines.best_pair(lines.pair_scores(candidates)).withColumn("score", F.round("score", 6))


def nearest_bin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", lines.nearest_bin(F.col("value"), 2.0, 7.5, 40).alias("bin"))


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), (F.col("label") % 3).alias("label"))
    train, test = learning.split_by_hash(e, "vec_id", 0.25)
    train, test = learning.standardised(train, test)
    return train, test


def feature_scaling(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    (out,) = learning.standardised(e)
    return out.select("vec_id", F.posexplode("features").alias("k", "z")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("z", 5).alias("z"))


def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    train, _ = _features(spark, d)
    _, shares = learning.projected(train, 8)
    return spark.createDataFrame([(k, float(s)) for k, s in enumerate(shares)], "k int, share double")


def kernel_components(spark: SparkSession, d: str) -> DataFrame:
    """Each training vector's places along four components of the cubic kernel, their signs left open."""
    train, _ = _features(spark, d)
    model = kernels.kernel_components(train.select("vec_id", "features"), "vec_id", 4, extra=76, tolerance=1e-7)
    places = model.training().select(F.col("key").alias("vec_id"), F.posexplode("features").alias("component", "place"))
    return places.select("vec_id", "component", F.round(F.abs("place"), 3).alias("place"))


def kernel_machine_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Which label a machine with a kernel of degree 20 gives the held-out vectors."""
    train, test = _features(spark, d)
    machine = kernels.kernel_machine(train, "vec_id", kernels.Polynomial(20, 1.0, 1 / 640), landmarks=200, rounds=15, penalty=0.001)
    return machine.predicted(test).select("vec_id", "label", "predicted")


def lr_grid(spark: SparkSession, d: str) -> DataFrame:
    train, test = _features(spark, d)
    return learning.logistic_grid(train, test, (5, 20), (0.0, 0.1), (0.0,))


def svm_predictions(spark: SparkSession, d: str) -> DataFrame:
    train, test = _features(spark, d)
    return learning.predicted(learning.linear_svm(train, 10), test).select("vec_id", "label", "predicted")


def mlp_predictions(spark: SparkSession, d: str) -> DataFrame:
    train, test = _features(spark, d)
    return learning.predicted(learning.perceptron(train, (train.select(F.size("features")).first()[0], 16, 3), 30), test).select("vec_id", "label", "predicted")


QUERIES = {
    f.__name__: f
    for f in (
        stencil_3x3, grey_closing, ink_removal, pyramid_down, pyramid_round_trip, pyramid_details, connected_components, corner_points, radial_profile, block_correction,
        hough_threshold, hough_dominant_family, hough_pairs, nearest_bin, feature_scaling, pca_variance, kernel_components, kernel_machine_predictions, lr_grid, svm_predictions, mlp_predictions,
    )
}

_GRID = """g AS (SELECT event_type AS image, user_id % 64 AS y, event_id % 48 AS x, floor(max(value)) AS v FROM events GROUP BY 1, 2, 3)"""
_VOTES = """v AS (SELECT image, theta * 5 AS theta, round((x * cos(theta * pi() / 36) + y * sin(theta * pi() / 36)) / 4 + 1e-7)::BIGINT AS rho, count(*) AS votes
    FROM g, range(36) t(theta) GROUP BY 1, 2, 3), s AS (SELECT * FROM v QUALIFY votes >= 0.6::DOUBLE * max(votes) OVER (PARTITION BY image))"""


def _axis_extreme(of: str, how: str, name: str) -> str:
    """One axis after the other, over the pixels that exist."""
    one = f"{name}_y AS (SELECT a.image, a.y, a.x, {how}(b.v) AS v FROM {of} a JOIN {of} b ON b.image = a.image AND b.x = a.x AND abs(b.y - a.y) <= 1 GROUP BY 1, 2, 3)"
    return one + f", {name} AS (SELECT a.image, a.y, a.x, {how}(b.v) AS v FROM {name}_y a JOIN {name}_y b ON b.image = a.image AND b.y = a.y AND abs(b.x - a.x) <= 1 GROUP BY 1, 2, 3)"


_CLOSED = f"{_axis_extreme('g', 'max', 'hi')}, {_axis_extreme('hi', 'min', 'lo')}"
_DOWN = """w AS (SELECT d, [1, 4, 6, 4, 1][d + 3] AS w FROM range(-2, 3) t(d)),
    a AS (SELECT c.image, c.y // 2 AS y, c.x, sum(g.v * w) / sum(w) AS v FROM g c, w JOIN g ON g.image = c.image AND g.x = c.x AND g.y = c.y + d WHERE c.y % 2 = 0 GROUP BY 1, 2, 3)
    SELECT c.image, c.y, c.x // 2 AS x, round(sum(a.v * w) / sum(w), 5) AS v FROM a c, w JOIN a ON a.image = c.image AND a.y = c.y AND a.x = c.x + d WHERE c.x % 2 = 0 GROUP BY 1, 2, 3"""

ORACLES = {
    "stencil_3x3": f"""WITH {_GRID}, k AS (SELECT unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS dy, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS dx, unnest([-1, 0, 1, -2, 2, -1, 0, 1]) AS w)
        SELECT c.image, c.y, c.x, coalesce(sum(g.v * w), 0)::DOUBLE AS v FROM g c CROSS JOIN k LEFT JOIN g ON g.image = c.image AND g.y = c.y + dy AND g.x = c.x + dx GROUP BY 1, 2, 3""",
    "grey_closing": f"WITH {_GRID}, {_CLOSED} SELECT * FROM lo",
    "ink_removal": f"""WITH {_GRID.replace('floor(max(value))', '(floor(max(value)) % 256) / 255')}, {_CLOSED}
        SELECT image, y, x, round(1 - greatest(lo.v - g.v, 0), 6) AS v FROM g JOIN lo USING (image, y, x)""",
    "pyramid_down": f"WITH {_GRID}, {_DOWN}",
    "pyramid_round_trip": f"WITH {_GRID} SELECT image, y, x, round(v, 5) AS v FROM g",
    "pyramid_details": f"""WITH {_GRID}, small AS ({'WITH ' + _DOWN.replace('round(sum(a.v * w) / sum(w), 5)', 'sum(a.v * w) / sum(w)')}),
        k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d, unnest([1, 4, 6, 4, 1]) AS w),
        r AS (SELECT image, y * 2 + d AS y, x, sum(v * w) / sum(w) AS v FROM small, k GROUP BY 1, 2, 3), u AS (SELECT image, y, x * 2 + d AS x, sum(v * w) / sum(w) AS v FROM r, k GROUP BY 1, 2, 3)
        SELECT g.image, g.y, g.x, round(g.v - coalesce(u.v, 0) + 1e-8, 5) + 0.0::DOUBLE AS v FROM g LEFT JOIN u USING (image, y, x)""",
    "connected_components": f"""WITH RECURSIVE {_GRID}, m AS (SELECT image, y, x, y * 2147483648 + x AS id FROM g WHERE v % 5 < 3),
        r AS (SELECT image, y, x, id AS c FROM m UNION
              SELECT m.image, m.y, m.x, r.c FROM r JOIN m ON m.image = r.image AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1 AND m.id <> r.c),
        p AS (SELECT image, y, x, min(c) AS component FROM r GROUP BY 1, 2, 3),
        b AS (SELECT image, component, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, count(*) AS area FROM p GROUP BY 1, 2)
        SELECT *, y1 - y0 + 1 AS height, x1 - x0 + 1 AS width, round(area / ((y1 - y0 + 1) * (x1 - x0 + 1)), 6) AS fill FROM b""",
    "corner_points": f"""WITH {_GRID}, m AS (SELECT image, y, x FROM g WHERE v % 5 < 3)
        SELECT image, arg_min(y, (x + y, y, x)) AS top_left_y, arg_min(x, (x + y, y, x)) AS top_left_x, arg_max(y, (x - y, y, x)) AS top_right_y,
               arg_max(x, (x - y, y, x)) AS top_right_x, arg_max(y, (x + y, y, x)) AS bottom_right_y, arg_max(x, (x + y, y, x)) AS bottom_right_x,
               arg_min(y, (x - y, y, x)) AS bottom_left_y, arg_min(x, (x - y, y, x)) AS bottom_left_x FROM m GROUP BY 1""",
    "radial_profile": f"WITH {_GRID} SELECT image, floor(sqrt(pow(y - 32, 2) + pow(x - 24, 2)))::BIGINT AS radius, round(avg(v), 6) AS v, count(v) AS n FROM g GROUP BY 1, 2",
    "block_correction": f"""WITH {_GRID}, p AS (SELECT image, y, x, y // 16 AS yb, x // 16 AS xb, v % 128 AS work, (v * 7 + x) % 256 AS clean FROM g),
        c AS (SELECT image, yb, xb, floor(unnest([work, clean]) / 8) AS bin, unnest([1, -1]) AS s FROM p),
        h AS (SELECT image, yb, xb, bin, sum(s) AS d, count(*) AS m FROM c GROUP BY ALL),
        n AS (SELECT image, yb, xb, sum(CASE WHEN bin < 13 THEN greatest(d, 0) ELSE 0 END) AS n FROM h GROUP BY 1, 2, 3 HAVING sum(m) / 2 >= 8),
        k AS (SELECT p.image, p.y, p.x, n, row_number() OVER (PARTITION BY p.image, p.yb, p.xb ORDER BY clean - work DESC, y, x) AS rn
              FROM p JOIN n USING (image, yb, xb) WHERE work <= 96 AND clean - work >= 8)
        SELECT p.image, p.y, p.x, CASE WHEN k.rn <= k.n THEN clean ELSE work END AS v FROM p LEFT JOIN k USING (image, y, x)""",
    "hough_threshold": f"WITH {_GRID}, {_VOTES} SELECT * FROM s",
    "hough_dominant_family": f"""WITH {_GRID}, {_VOTES}, c AS (SELECT image, theta, count(*) AS n, sum(votes) AS t FROM s GROUP BY 1, 2),
        d AS (SELECT image, arg_max(theta, (n, -theta)) AS plain, arg_max(theta, (n, t, -theta)) AS dominant FROM c GROUP BY 1)
        SELECT image, arg_min(rho, (rho, -votes)) AS low_rho, arg_max(rho, (rho, votes)) AS high_rho, any_value(dominant) AS dominant FROM s JOIN d USING (image)
        WHERE abs((theta - plain + 270) % 180 - 90) <= 10 GROUP BY 1""",
    "nearest_bin": "SELECT event_id, greatest(0, least(39, ceil((value - 2.0::DOUBLE) / 7.5::DOUBLE - 0.5::DOUBLE)))::BIGINT AS bin FROM events",
    "feature_scaling": """WITH r AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)
        SELECT vec_id, k, round((v - avg(v) OVER w) / coalesce(nullif(stddev_pop(v) OVER w, 0), 1), 5) AS z FROM r WINDOW w AS (PARTITION BY k)""",
}
