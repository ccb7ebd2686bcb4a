"""Segments, edges, outlines and warped pictures against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import edges, segments, warps

PIXELS = "image string, y long, x long, v double"


def pixels(spark, image, name="a"):
    return spark.createDataFrame([(name, y, x, float(v)) for (y, x), v in np.ndenumerate(image)], PIXELS)


def picture(df, shape, column="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r[column]
    return out


# --- segments ---------------------------------------------------------------------------------------


def greedy_segments(points, shares, angles, step, threshold, length, gap):
    """One cell after the other, all votes counted anew each time."""
    cell = lambda p, t: (t, math.floor((p[1] * math.cos(t * math.pi / angles) + p[0] * math.sin(t * math.pi / angles)) / step + 1e-7 + 0.5))
    live, settled, out = set(points), set(), []
    for share in range(max(shares.values()) + 1):
        while True:
            votes = {}
            for p in live:
                if shares[p] <= share:
                    for t in range(angles):
                        votes[cell(p, t)] = votes.get(cell(p, t), 0) + 1
            able = [(-n, *c) for c, n in votes.items() if n >= threshold and c not in settled]
            if not able:
                break
            _, t, rho = min(able)
            settled.add((t, rho))
            place = lambda p: round(p[0] * math.cos(t * math.pi / angles) - p[1] * math.sin(t * math.pi / angles), 6)  # noqa: E731, B023
            line = sorted((place(p), *p) for p in live if cell(p, t) == (t, rho))
            runs = [[line[0]]]
            for a, b in zip(line, line[1:], strict=False):
                if b[0] - a[0] > gap:
                    runs.append([])
                runs[-1].append(b)
            for run in runs:
                if run[-1][0] - run[0][0] >= length - 1e-6:
                    out.append((t, rho, *run[0][1:], *run[-1][1:], len(run)))
                    live -= {p[1:] for p in run}
    return sorted(out)


@pytest.mark.parametrize("shares", [1, 3])
def test_segments_equal_one_cell_after_the_other(spark, shares):
    rng = np.random.default_rng(3)
    points = {(int(y), int(x)) for y, x in rng.integers(0, 40, (120, 2))} | {(9, x) for x in range(3, 30)} | {(y, y + 4) for y in range(30)} | {(30, x) for x in range(40) if x != 17}
    rows = [("a", *p) for p in points]
    mask = spark.createDataFrame([*rows, rows[0], ("a", None, 3), ("b", 1, 1)], "image string, y int, x int")
    own = mask.dropna().distinct().withColumn("s", segments.vote_share(0, shares)).where("image = 'a'").collect()
    kinds = {"angles": 18, "step": 2.0, "threshold": 8, "length": 8.0, "gap": 4.0}
    found = segments.segments(mask, shares=shares, **kinds).collect()
    assert {r.image for r in found} == {"a"}
    expected = greedy_segments(points, {(r.y, r.x): r.s for r in own}, **kinds)
    assert len(expected) > 4
    assert sorted((r.theta, r.rho, r.y0, r.x0, r.y1, r.x1, r.pixels) for r in found) == expected
    assert segments.segments(mask.limit(0)).count() == 0


# --- edges -------------------------------------------------------------------------------------------


def thin_by_loops(image, low, high):
    """Gradient, suppression and hysteresis over an image, pixel by pixel."""
    h, w = image.shape
    wide = np.pad(image, 1)
    gy, gx = np.zeros((h, w)), np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            n = wide[y : y + 3, x : x + 3]
            gy[y, x] = n[2] @ [1, 2, 1] - n[0] @ [1, 2, 1]
            gx[y, x] = n[:, 2] @ [1, 2, 1] - n[:, 0] @ [1, 2, 1]
    m = np.hypot(gy, gx)
    weak = set()
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            if m[y, x] < max(low, 1e-12):
                continue
            # the place one step along the gradient's longer part
            sy, sx = gy[y, x] / max(abs(gy[y, x]), abs(gx[y, x])), gx[y, x] / max(abs(gy[y, x]), abs(gx[y, x]))
            sides = []
            for s in (1, -1):
                py, px = y + s * sy, x + s * sx
                fy, fx = math.floor(py + 1e-12), math.floor(px + 1e-12)
                ay, ax = py - fy, px - fx
                four = [(fy, fx, (1 - ay) * (1 - ax)), (fy, fx + 1, (1 - ay) * ax), (fy + 1, fx, ay * (1 - ax)), (fy + 1, fx + 1, ay * ax)]
                sides.append(sum(m[a, b] * q for a, b, q in four if abs(q) > 1e-9))
            if max(sides) <= m[y, x] + 1e-9:
                weak.add((y, x))
    kept, queue = set(), [p for p in weak if m[p] >= high]
    while queue:
        p = queue.pop()
        if p not in kept:
            kept.add(p)
            queue += [q for q in ((p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)) if q in weak]
    return kept


def test_thin_edges_on_noise_a_plateau_and_a_broken_edge(spark):
    rng = np.random.default_rng(1)
    noise = rng.integers(1, 60, (18, 15)).astype(float)
    plateau = np.add.outer(np.zeros(12), np.repeat([1, 11, 31, 41], 4)) + rng.random((12, 16)) * 1e-3  # a ramp two pixels wide
    broken = np.ones((20, 12)) + rng.random((20, 12)) * 1e-3
    broken[:, 6:] += 50
    broken[8:11, 6:] -= 45  # weak there
    broken[15:17, 6:] = broken[15:17, :6]  # nothing there
    step = np.zeros((12, 12))
    step[4:9, 3:8] = 100.0
    for image, low, high in ((step, 50.0, 390.0), (noise, 20.0, 180.0), (plateau, 30.0, 70.0), (broken, 10.0, 150.0), (broken, 40.0, 150.0)):
        found = {(r.y, r.x) for r in edges.thin_edges(pixels(spark, image), low, high, sigma=0.0).collect()}
        assert found == thin_by_loops(image, low, high)
        assert found
    assert edges.thin_edges(pixels(spark, np.zeros((6, 6))), 1.0, 2.0).count() == 0
    assert edges.thin_edges(spark.createDataFrame([], PIXELS), 1.0, 2.0).count() == 0


def test_energies(spark):
    image = np.arange(30.0).reshape(5, 6)
    df = pixels(spark, image)
    with pytest.raises(ValueError):
        edges.energy(df, "snake")
    for mode in edges.MODES:
        got = picture(edges.energy(df, mode, border=1, size=(5, 6)), (5, 6))
        assert np.nanmin(got) >= 0 and np.nanmax(got) <= 1 and (got[0] == 0).all() and (got[:, -1] == 0).all()
    flat = picture(edges.energy(pixels(spark, np.full((4, 4), 3.0)), "gaussian"), (4, 4))
    assert (flat == 0).all()
    sharp = picture(edges.energy(pixels(spark, np.eye(7)), "gaussian", unsharp=(1.0, 2.0)), (7, 7))
    assert sharp[3, 3] == 1 and sharp[0, 6] == 0


def test_rectangle_is_closed_and_even(spark):
    pictures = spark.createDataFrame([("a", 100, 60)], "image string, height int, width int")
    got = [(r.y, r.x) for r in edges.rectangle(pictures, 0.1, 18).orderBy("k").collect()]
    line = lambda a, b, n: np.linspace(a, b, n, endpoint=False)
    want = [(10, x) for x in line(6, 53, 4)] + [(y, 53) for y in line(10, 89, 4)] + [(89, x) for x in line(53, 6, 4)] + [(y, 6) for y in line(89, 10, 6)]
    assert np.allclose(got, want)


def inside(points, y, x):
    """Even-odd rule with one ray, or on an edge."""
    odd = False
    for (y0, x0), (y1, x1) in zip(points, points[1:] + points[:1], strict=True):
        if (y1 - y0) * (x - x0) == (x1 - x0) * (y - y0) and min(y0, y1) <= y <= max(y0, y1) and min(x0, x1) <= x <= max(x0, x1):
            return True
        if (y0 <= y) != (y1 <= y) and x0 + (y - y0) * (x1 - x0) / (y1 - y0) < x:
            odd = not odd
    return odd


def test_polygon_masks(spark):
    rng = np.random.default_rng(2)
    shapes = {
        "square": [(2, 2), (2, 8), (8, 8), (8, 2)],
        "concave": [(0, 0), (0, 12), (12, 12), (6, 6), (12, 0)],
        "touching": [(0, 0), (4, 4), (0, 8), (8, 8), (4, 4), (8, 0)],
        "star": [(0, 6), (12, 10), (4, 0), (4, 12), (12, 2)],
        "flat": [(3, 1), (3, 9)],
        "point": [(5, 5)],
        "halves": [(0.5, 0.5), (0.5, 9.5), (9.5, 9.5), (9.5, 0.5)],
        "random": [tuple(map(int, p)) for p in rng.integers(0, 13, (25, 2))],
    }
    rows = [(name, k, float(y), float(x)) for name, points in shapes.items() for k, (y, x) in enumerate(points)]
    found = edges.polygon_mask(spark.createDataFrame([*rows, ("square", 9, None, 1.0)], "image string, k int, y double, x double")).collect()
    for name, points in shapes.items():
        want = {(y, x) for y in range(14) for x in range(14) if inside(points, y, x)}
        assert {(r.y, r.x) for r in found if r.image == name} == want, name
    assert len(found) == len(set(found))


def test_polygon_masks_are_dealt_by_their_meetings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, k, int(y), int(x)) for i in range(12) for k, (y, x) in enumerate(rng.integers(0, 13, (25, 2)))]
    df = spark.createDataFrame(rows, "image int, k int, y int, x int")
    whole = edges.polygon_mask(df)
    monkeypatch.setattr(edges, "ROWS", 400)
    dealt = edges.polygon_mask(df)
    assert dealt.rdd.getNumPartitions() >= 9  # 12 outlines of 25 edges in 13 rows
    assert "Aggregate" not in dealt._jdf.queryExecution().optimizedPlan().toString()  # no pixel is met twice
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole.collect()))


# --- warps -------------------------------------------------------------------------------------------


def test_resizing_both_ways(spark):
    rng = np.random.default_rng(4)
    image = rng.random((9, 7))
    holes = image.copy()
    holes[2, 3] = holes[8, 6] = np.nan

    def areas(old, new):
        return np.array([[max(0.0, min((k + 1) / old, (c + 1) / new) - max(k / old, c / new)) for k in range(old)] for c in range(new)])

    for source in (image, holes):
        known = ~np.isnan(source)
        df = pixels(spark, source).where(~F.isnan("v"))
        for h, w in ((4, 3), (9, 7), (20, 31), (3, 15)):
            sizes = spark.createDataFrame([("a", 9, 7, h, w)], "image string, height int, width int, new_height int, new_width int")
            a, b = areas(9, h), areas(7, w)
            with np.errstate(invalid="ignore"):
                want = (a @ np.where(known, source, 0) @ b.T) / (a @ known @ b.T)
            assert np.allclose(picture(warps.resized(df, sizes), (h, w)), want, equal_nan=True)
    fitted = warps.fitted_sizes(spark.createDataFrame([("a", 900, 700), ("b", 20, 10)], "image string, height int, width int"), 300).orderBy("image").collect()
    assert [(r.new_height, r.new_width) for r in fitted] == [(300, 233), (20, 10)]


def test_rectified_pages(spark):
    rng = np.random.default_rng(5)
    image = rng.random((12, 10))
    df = pixels(spark, image)
    corner = lambda *points: warps.ordered_corners(spark.createDataFrame([("a", float(x), float(y)) for x, y in points], "image string, x double, y double"))
    whole = warps.rectified(df, corner((0, 0), (9, 11), (9, 0), (0, 11)), 12, 10)
    assert np.allclose(picture(whole, (12, 10)), image)

    points = [(1.5, 0.5), (8.0, 2.0), (9.5, 10.0), (0.0, 8.0)]  # the last row and column partly outside
    rows, height, width = [], 9, 8
    for (u, v), (x, y) in zip([(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)], points, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x, x], [0, 0, 0, u, v, 1, -u * y, -v * y, y]]
    m = np.array(rows)
    a, b, c, d, e, f, g, h = np.linalg.solve(m[:, :8], m[:, 8])
    wide, want = np.pad(image, 3), np.zeros((height, width))
    for v in range(height):
        for u in range(width):
            x, y = (a * u + b * v + c) / (g * u + h * v + 1) + 3, (d * u + e * v + f) / (g * u + h * v + 1) + 3
            i, j = int(y), int(x)
            want[v, u] = sum(wide[i + p, j + q] * abs(1 - p - (y - i)) * abs(1 - q - (x - j)) for p in (0, 1) for q in (0, 1))
    assert np.allclose(picture(warps.rectified(df, corner(*points), height, width), (height, width)), want)
    assert warps.rectified(df, corner((0, 0), (5, 5), (9, 9), (3, 3)), 4, 4).count() == 0


def test_local_equalisation(spark):
    rng = np.random.default_rng(6)
    image = (rng.random((22, 17)) ** 2 * 256).astype(int)
    tiles, limit, h, w = 3, 2.5, 8, 6
    tables = {}
    for r in range(3):
        for c in range(3):
            tile = image[r * h : (r + 1) * h, c * w : (c + 1) * w]
            n = np.bincount(tile.ravel(), minlength=256)
            most = max(1, int(limit * tile.size / 256))
            extra = int(np.maximum(n - most, 0).sum())
            n = np.minimum(n, most) + extra // 256
            rest = extra % 256
            for k in range(0, 256, max(1, 256 // rest) if rest else 256):
                if rest:
                    n[k] += 1
                    rest -= 1
            tables[r, c] = np.rint(np.cumsum(n) * 255 / tile.size)
    want = np.zeros(image.shape)
    for y in range(22):
        for x in range(17):
            py, px = y / h - 0.5, x / w - 0.5
            i, j = math.floor(py), math.floor(px)
            mix = sum(
                tables[min(max(i + a, 0), 2), min(max(j + b, 0), 2)][image[y, x]] * abs(1 - a - (py - i)) * abs(1 - b - (px - j)) for a in (0, 1) for b in (0, 1)
            )
            want[y, x] = np.rint(round(mix, 9))
    sizes = spark.createDataFrame([("a", 22, 17)], "image string, height int, width int")
    assert (picture(warps.equalised(pixels(spark, image), sizes, tiles, limit), image.shape) == want).all()


# --- leads -------------------------------------------------------------------------------------------


def test_leads_are_drawn_and_decoded_again(spark):
    from tessera.operators import pages

    height, width, n = 430, 560, 250
    leads = [x for row in pages.LEADS for x in row]
    wave = {lead: [0.6 * math.sin(6.28 * i * (k + 2) / n) + 0.1 * k / 12 for i in range(n)] for k, lead in enumerate(leads)}
    rows = [("p", lead, i, v if not (lead == "V2" and (i < 20 or i == 100)) else (None if i % 2 else float("nan"))) for lead, own in wave.items() for i, v in enumerate(own) if lead != "aVF"]
    pictures = spark.createDataFrame([("p", height, width), ("empty", height, width)], "image string, height int, width int")
    regions = pages.lead_regions(pictures)
    series = spark.createDataFrame(rows, "image string, lead string, i int, mv double")
    drawn = pages.rasterised(series, regions, pictures)
    where = {r.lead: r for r in regions.where("image = 'p'").collect()}
    got: dict = {}
    for r in drawn.collect():
        got.setdefault(r.lead, set()).add((r.y, r.x))
    assert set(got) == {*leads, pages.STRIP} - {"aVF"}
    scale = height / pages.HEIGHT
    for lead, pixels_ in got.items():
        box = where[lead]
        own = [(i, v) for i, v in enumerate(wave["II" if lead == pages.STRIP else lead])]
        if lead == "V2":
            own = [(i, v) for i, v in own if not (i < 20 or i == 100)]
        first, last = own[0][0], own[-1][0]
        sums: dict = {}
        for i, v in own:
            sums.setdefault(round(box.x0 + (box.x1 - 1 - box.x0) * (i - first) / (last - first)), []).append(box.baseline - v * scale)
        at = {x: float(np.rint(np.mean(ys))) for x, ys in sums.items()}
        xs = sorted(at)
        line = lambda x: int(np.rint(round(float(np.interp(x, xs, [at[k] for k in xs])), 9)))  # noqa: E731, B023
        want = {(y, x) for x in range(xs[0], xs[-1]) for y in range(min(line(x), line(x + 1)), max(line(x), line(x + 1)) + 1)} | {(line(xs[-1]), xs[-1])}
        assert pixels_ == want, lead
    thick = pages.rasterised(series.where("lead = 'I'"), regions, pictures, thickness=3)
    assert {(r.y, r.x) for r in thick.collect()} == {(y + d, x) for y, x in got["I"] for d in (-1, 0, 1)}

    traced = drawn.groupBy("image", "lead", "x").agg(F.avg("y").alias("y"))
    rate = 100.0
    found: dict = {}
    for r in pages.decoded_records(traced, regions, pictures, rate).orderBy("i").collect():
        found.setdefault((r.image, r.lead), []).append(r.mv)
    assert set(found) == {(p, lead) for p in ("p", "empty") for lead in [*leads, pages.STRIP]}
    assert set(found["empty", "I"]) == {0.0} == set(found["p", "aVF"])
    own = np.array(found["p", "I"])
    seconds = (where["I"].x1 - where["I"].x0) / round(width / pages.WIDTH * 2.5)
    assert len(own) == round(seconds * rate)
    truth = np.interp(np.linspace(0, n - 1, len(own)), range(n), wave["I"])
    assert np.abs(own - truth).mean() < 0.06


def test_polyline_of_far_points(spark):
    from tessera.operators import pages

    df = spark.createDataFrame([("a", 0, 0.0), ("a", 4, 2.0), ("a", 5, 9.0), ("b", 7, 3.4)], "k string, x int, y double")
    got = sorted((r.k, r.x, r.y) for r in pages.polyline(df, ["k"]).collect())
    assert got == [("a", 0, 0), ("a", 1, 0), ("a", 1, 1), ("a", 2, 1), ("a", 2, 2), ("a", 3, 2), *(("a", 4, y) for y in range(2, 10)), ("a", 5, 9), ("b", 7, 3)]
    assert pages.polyline(df.limit(0), ["k"]).count() == 0
