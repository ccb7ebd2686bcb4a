"""Pixel, line and model operators against plain loops on small images, with absent pixels, ties and empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import images, learning, lines

PIXELS = "image string, y long, x long, v double"


def dense(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        out[r.y, r.x] = r.v
    return out


@pytest.fixture(scope="module")
def picture(spark):
    values = np.random.default_rng(3).integers(0, 9, (7, 6)).astype(float)
    return values, spark.createDataFrame([("a", y, x, float(values[y, x])) for y in range(7) for x in range(6)], PIXELS)


def test_stencil_borders(spark, picture):
    values, df = picture
    kernel = np.arange(9).reshape(3, 3) - 2.0
    padded = np.pad(values, 1)
    want = sum(kernel[j, i] * padded[j : j + 7, i : i + 6] for j in range(3) for i in range(3))
    assert np.allclose(dense(images.stencil(df, kernel.tolist()).collect(), (7, 6)), want)
    mean = dense(images.stencil(df, [[1.0] * 3] * 3, normalise=True).collect(), (7, 6))
    assert np.isclose(mean[0, 0], values[:2, :2].mean()) and np.isclose(mean[3, 3], values[2:5, 2:5].mean())


def test_closing_and_pyramid(spark, picture):
    values, df = picture

    def square(a, how, fill):
        p = np.pad(a, 1, constant_values=fill)
        return how([p[j : j + 7, i : i + 6] for j in range(3) for i in range(3)], axis=0)

    want = square(square(values, np.max, -np.inf), np.min, np.inf)
    assert np.array_equal(dense(images.closed(df, 1).collect(), (7, 6)), want)
    differences, smallest = images.laplacian_levels(df, 2)
    assert smallest.count() == 2 * 2
    assert np.allclose(dense(images.reconstructed(differences, smallest).collect(), (7, 6)), values)


def test_components_of_random_masks_and_a_long_snake(spark):
    rng = random.Random(2)
    snake = {(y, x) for y in range(0, 21, 2) for x in range(15)} | {(y, 14 if y % 4 == 1 else 0) for y in range(1, 21, 2)}
    masks = {"noise": {(rng.randrange(14), rng.randrange(14)) for _ in range(70)}, "snake": snake, "dot": {(5, 5)}}
    df = spark.createDataFrame([(k, y, x) for k, m in masks.items() for y, x in m], "image string, y long, x long")
    got = {(r.image, r.y, r.x): r.component for r in images.components(df.unionByName(df)).collect()}

    for name, mask in masks.items():
        left = set(mask)
        while left:
            todo, part = [left.pop()], []
            while todo:
                y, x = todo.pop()
                part.append((y, x))
                near = {(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1)} & left
                left -= near
                todo += near
            assert {got[name, y, x] for y, x in part} == {min(y * (1 << 31) + x for y, x in part)}
    assert len(got) == sum(map(len, masks.values()))


def test_no_pixels(spark):
    none = spark.createDataFrame([], PIXELS)
    assert images.closed(none, 2).count() == images.pyramid_down(none).count() == images.components(none.drop("v")).count() == 0


def test_block_correction_replaces_the_largest_gains(spark):
    rows = [("a", 0, x, 10.0 if x < 6 else 200.0, 10.0 if x < 2 else 180.0 - x) for x in range(16)] + [("a", 1, 0, None, 5.0)]
    df = spark.createDataFrame(rows, "image string, y long, x long, work double, clean double")
    got = {(r.y, r.x): r.v for r in images.block_corrected(df, block=16).collect()}
    assert [got[0, x] for x in range(7)] == [10.0, 10.0, 178.0, 177.0, 176.0, 175.0, 200.0] and got[1, 0] is None


def test_line_choices(spark):
    votes = spark.createDataFrame([("a", 0, 1, 9), ("a", 0, 8, 9), ("a", 90, 5, 9), ("a", 175, 4, 9), ("a", 45, 2, 3)], "image string, theta long, rho long, votes long")
    strong = lines.strong_entries(votes, 0.5)
    assert strong.count() == 4 and lines.dominant_theta(strong).first().dominant == 0
    assert {(r.theta, r.rho) for r in lines.family(strong, 5.0).collect()} == {(0, 1), (0, 8), (175, 4)}
    assert [(r.theta, r.rho) for r in lines.family(strong, 5.0, turned=90).collect()] == [(90, 5)]
    best = lines.best_pair(lines.pair_scores(lines.family(strong, 5.0))).first()
    assert (best.rho_a, best.rho_b, round(best.score, 6)) == (1, 8, 1.0)
    bins = spark.createDataFrame([(-5.0,), (0.5,), (0.6,), (99.0,), (None,)], "v double").select(lines.nearest_bin(F.col("v"), 0.0, 1.0, 10))
    assert [r[0] for r in bins.collect()][:4] == [0, 0, 1, 9]


def test_models_separate_separable_classes(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(0, 0.3, 4) + [5 * (k % 3), -5 * (k % 3), 5 * (k % 3 == 1), 5 * (k % 3 == 1)]).tolist() + [1.0], k % 3) for k in range(240)]
    df = spark.createDataFrame(rows, "key long, features array<double>, label int")
    train, test = learning.standardised(*learning.split_by_hash(df, "key", 0.25))
    assert train.count() + test.count() == 240 and 30 < test.count() < 90
    assert {r.f for r in train.select(F.get("features", F.lit(4)).alias("f")).collect()} == {0.0}
    (a, b), shares = learning.projected(train, 2, test)
    assert 0.9 < sum(shares) <= 1 + 1e-9 and len(a.first().features) == 2
    (c, _), _ = learning.projected(train, 3, test, degree=2)
    assert len(c.first().features) == 3
    for model in (learning.logistic(a), learning.linear_svm(train, 20), learning.perceptron(train, (5, 6, 3), 40)):
        assert learning.accuracy(learning.predicted(model, b if model.stages[0].__class__.__name__.startswith("Logistic") else test)) > 0.9
    assert learning.accuracy(test.withColumn("predicted", F.lit(0)).limit(0)) == 0.0


def test_components_share_of_variance_equals_numpy(spark):
    from tessera.plans import picture_queries

    train, _ = picture_queries._features(spark, "/root/testdata/sf0.001")
    x = np.array([list(r[0]) for r in train.select("features").collect()])
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    got = [r.share for r in picture_queries.pca_variance(spark, "/root/testdata/sf0.001").orderBy("k").collect()]
    assert got == pytest.approx((values / values.sum())[:8].tolist(), rel=1e-5)


def test_line_pairs_against_loops(spark):
    from tessera.plans import picture_queries

    votes = picture_queries._votes(spark, "/root/testdata/sf0.001").collect()
    got = {r.image: (r.rho_a, r.rho_b, r.score) for r in picture_queries.hough_pairs(spark, "/root/testdata/sf0.001").collect()}
    for image in {r.image for r in votes}:
        best: dict = {}
        for r in votes:
            if r.image == image and (r.votes, -r.theta) > best.get(r.rho, (0, 0)):
                best[r.rho] = (r.votes, -r.theta)
        rhos = sorted(best)
        height = [best[r][0] for r in rhos]
        peaks = [r for k, r in enumerate(rhos) if (k == 0 or height[k] >= height[k - 1]) and (k == len(rhos) - 1 or height[k] >= height[k + 1])]
        picks: list = []
        for r in sorted(peaks, key=lambda r: (-best[r][0], r)):
            if all(abs(r - q) >= 3 for q in picks):
                picks.append(r)
        picks = sorted(picks[:12])
        top, wide = max(best[r][0] for r in picks), picks[-1] - picks[0]
        found = []
        for i, a in enumerate(picks):
            for b in picks[i + 1 :]:
                accum, sep = min(best[a][0], best[b][0]) / top, (b - a) / wide
                outer = ((1 - (a - picks[0]) / wide) + (1 - (picks[-1] - b) / wide)) / 2
                found.append((round(0.4 * accum + 0.3 * sep + 0.3 * outer, 9), outer, sep, accum, -a, -b))
        score, *_, a, b = max(found)
        assert got[image] == (-a, -b, pytest.approx(score, abs=1e-5))


def test_chosen_grid_against_loops(spark):
    import math

    rng = np.random.default_rng(12)
    rows = {}
    for image in "abc":
        for theta, rho in rng.integers(0, [36, 40], (260, 2)).tolist():
            rows[image, theta * 5 - 90, rho + 1] = int(rng.integers(1, 8))
        for rho in (4, 33):
            rows[image, 10, rho] = rows[image, -80, rho] = 9
    rows |= {("d", 10, 20): 9, ("d", 10, 3): 4, ("d", 15, 28): 5, ("d", 10, 24): 2}  # one strong line: only peaks below the threshold are apart
    height, width, ratio, tolerance, gap, most, step = 50, 40, 0.9, 12.0, 3, 8, 1.5
    votes = spark.createDataFrame([(*k, n) for k, n in rows.items()], "image string, theta long, rho long, votes long")
    pictures = spark.createDataFrame([(i, height, width) for i in "abcd"], "image string, height int, width int")
    got = {(r.image, r.label): (r.theta, r.rho, r.votes, r.source) for r in lines.chosen_grid(votes, pictures, ratio, tolerance, gap, most, step).collect()}

    def middle(theta, rho, reference):
        c, s, r = math.cos(math.radians(theta)), math.sin(math.radians(theta)), rho * step
        points = []
        for x, y, fits in ((0, r / s if abs(s) > 1e-8 else math.inf, height), (width - 1, (r - (width - 1) * c) / s if abs(s) > 1e-8 else math.inf, height)):
            points += [(x, y)] if 0 <= y <= fits - 1 else []
        for y, x in ((0, r / c if abs(c) > 1e-8 else math.inf), (height - 1, (r - (height - 1) * s) / c if abs(c) > 1e-8 else math.inf)):
            points += [(x, y)] if 0 <= x <= width - 1 else []
        distinct = [p for k, p in enumerate(points) if all(math.dist(p, q) >= 1e-6 for q in points[:k])][:2]
        if len(distinct) < 2:
            return None
        (x0, y0), (x1, y1) = distinct
        return (x0 + x1) / 2 * math.cos(math.radians(reference)) + (y0 + y1) / 2 * math.sin(math.radians(reference))

    def separation(pair, reference):
        ends = [middle(t, r, reference) for t, r, _ in pair]
        if None in ends:
            return -1.0
        corners = [x * math.cos(math.radians(reference)) + y * math.sin(math.radians(reference)) for x in (0, width - 1) for y in (0, height - 1)]
        return min(1.0, abs(ends[1] - ends[0]) / ((max(corners) - min(corners)) or 1.0))

    away = lambda a, b: abs((a - b + 90) % 180 - 90)
    sources = set()
    for image in "abcd":
        own = [(t, r, n) for (i, t, r), n in rows.items() if i == image]
        strong = [e for e in own if e[2] >= ratio * max(n for _, _, n in own)]
        count = {t: sum(x == t for x, _, _ in strong) for t, _, _ in strong}
        dominant = min(count, key=lambda t: (-count[t], t))
        for letter, turned in (("D", 0), ("P", 90)):
            band, entries = ([e for e in some if away(e[0], dominant + turned) <= tolerance] for some in (own, strong))
            if not entries:
                continue
            outer = [min(entries, key=lambda e: (e[1], -e[2], e[0])), max(entries, key=lambda e: (e[1], e[2], -e[0]))]

            def strongest(some):
                best = {}
                for t, r, n in some:
                    if r not in best or (n, -t) > (best[r][2], -best[r][0]):
                        best[r] = (t, r, n)
                return best

            profile = strongest(band)
            rhos = sorted(profile)
            peaks = [r for k, r in enumerate(rhos) if all(profile[r][2] >= profile[q][2] for q in rhos[max(0, k - 1) : k + 2])]
            picks = []
            for r in sorted(peaks, key=lambda r: (-profile[r][2], r)):
                if all(abs(r - q) >= gap for q in picks):
                    picks.append(r)
            candidates = strongest([profile[r] for r in picks[:most]] + outer)
            rhos = sorted(candidates)
            wide, top, scored = rhos[-1] - rhos[0], max(c[2] for c in candidates.values()), []
            for k, a in enumerate(rhos):
                for b in rhos[k + 1 :]:
                    accum, sep = min(candidates[a][2], candidates[b][2]) / top, (b - a) / wide
                    out = ((1 - (a - rhos[0]) / wide) + (1 - (rhos[-1] - b) / wide)) / 2
                    scored.append((round(0.4 * accum + 0.3 * sep + 0.3 * out, 12), out, sep, accum, -a, -b))
            choices = [("global", outer)]
            if scored:
                *_, a, b = max(scored)
                choices.append(("score", [candidates[-a], candidates[-b]]))
            source, pair = max(choices, key=lambda c: (round(separation(c[1], dominant + turned), 9), c[0] == "global"))
            sources.add(source)
            for line, name in zip(pair, ("min", "max"), strict=True):
                assert got.pop((image, f"{letter}_{name}")) == (*line, source)
    assert not got and sources == {"global", "score"}
