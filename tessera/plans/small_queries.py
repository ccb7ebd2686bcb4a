"""Queries of sets, masks, look-ups, vote peaks, traced lines and page scores, with their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import images, lines, pages, statistics, tables
from tessera.plans.more_queries import _GROUPED, _votes
from tessera.plans.picture_queries import _GRID, _grid, _mask
from tessera.session import table

#: The three lanes that orders are shown in, as a table written in the code.
LANES = (("1-URGENT", "fast", 1), ("2-HIGH", "fast", 2), ("5-LOW", "slow", 9))


def inline_constants(spark: SparkSession, d: str) -> DataFrame:
    lanes = spark.createDataFrame(list(LANES), "o_orderpriority string, lane string, weight int")
    joined = table(spark, d, "orders").join(F.broadcast(lanes), "o_orderpriority")
    return joined.groupBy("lane").agg(F.count("*").alias("n"), F.sum("weight").cast("long").alias("weight"))


def dictionary_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for p, lane, _ in LANES for x in (p, lane)))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderpriority")), F.lit("other")).alias("lane"))


def membership(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type").isin("click", "view") & ~F.pmod("user_id", F.lit(10)).isin(0, 3)).select("event_id")


def skipped_failures(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose properties can't be read as a number above 2 are left out, and counted beside what stays."""
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    good = F.coalesce(F.col("k") > 2, F.lit(False))
    return e.groupBy("event_type").agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("bad"), F.round(F.sum(F.when(good, F.col("k"))), 4).alias("total"))


def features_and_target(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    features = [c for c in part.columns if c not in ("p_partkey", "p_retailprice")]
    return part.select("p_partkey", F.concat_ws("|", *features).alias("features"), "p_retailprice")


def index_joined(spark: SparkSession, d: str) -> DataFrame:
    """Every customer in order, with a prediction where there is one."""
    predictions = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("guess"))
    return table(spark, d, "customer").select("c_custkey").join(predictions, "c_custkey", "left").orderBy("c_custkey")


def best_setting(spark: SparkSession, d: str) -> DataFrame:
    """For each status the urgency with the most orders; of equals the one that came first."""
    counted = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.floor(F.count("*") / 50).alias("score"), F.min("o_orderkey").alias("first"))
    return counted.groupBy("o_orderstatus").agg(F.max_by("o_orderpriority", F.struct("score", -F.col("first"))).alias("best"))


def name_union(spark: SparkSession, d: str) -> DataFrame:
    names = [table(spark, d, t).select(F.substring(c, -2, 2).alias("name")) for t, c in (("customer", "c_name"), ("supplier", "s_name"))]
    return names[0].union(names[1]).distinct()


def subset_test(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_linestatus").alias("s"), F.collect_set(F.col("l_linenumber").cast("string")).alias("n"))
    holds = lambda c, wanted: F.size(F.array_except(F.array(*map(F.lit, wanted)), c)) == 0
    return seen.select("l_suppkey", holds(F.col("s"), ["O", "F"]).alias("both"), holds(F.col("n"), ["6", "7"]).alias("late"))


def mask_algebra(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_quantity") > 25, F.col("l_discount") > 0.05
    parts = {"either": a | b, "both": a & b, "neither": ~(a | b), "one": a != b}
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(*(F.count_if(m).alias(n) for n, m in parts.items()))


def category_codes(spark: SparkSession, d: str) -> DataFrame:
    codes = statistics.category_codes(table(spark, d, "events"), "event_type")
    return table(spark, d, "events").join(codes, "event_type").select("event_id", "code")


def json_list_rows(spark: SparkSession, d: str) -> DataFrame:
    """A JSON list of objects as rows; a missing field is null."""
    text = F.concat(F.lit('[{"step": '), F.col("o_orderkey"), F.lit(', "loss": '), F.col("o_totalprice"), F.lit('}, {"step": 7}]'))
    rows = table(spark, d, "orders").select("o_orderkey", F.from_json(text, "array<struct<step:long,loss:double>>").alias("log"))
    return rows.select("o_orderkey", F.inline("log"))


def padded_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Word lists of twelve: longer ones are cut, shorter ones filled, and a mask tells the words."""
    found = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    t = table(spark, d, "benchmark").select("item_id", found.alias("w"))
    return t.select("item_id", F.array_join(F.slice(F.concat("w", F.array_repeat(F.lit("[PAD]"), 12)), 1, 12), " ").alias("tokens"), F.least(F.size("w"), F.lit(12)).alias("words"))


def picked_components(spark: SparkSession, d: str) -> DataFrame:
    boxes = images.boxes(images.components(_mask(spark, d)), ["image", "component"])
    return pages.plausible(boxes, least=2, most=60, aspect=(0.3, 3.0), fill=0.5).withColumn("fill", F.round("fill", 6))


def energy_maps(spark: SparkSession, d: str) -> DataFrame:
    g = _grid(spark, d)
    return pages.energies(g).select("image", "y", "x", *(F.round(c, 5).alias(c) for c in ("smooth", "sobel", "laplace")))


def bordered(spark: SparkSession, d: str) -> DataFrame:
    return pages.border_zeroed(_grid(spark, d), 64, 48, 0.1)


def vote_peaks(spark: SparkSession, d: str) -> DataFrame:
    return lines.peaks(_votes(spark, d), 3, 10, 0.5)


def projection_profile(spark: SparkSession, d: str) -> DataFrame:
    return lines.rho_profile(_votes(spark, d))


def traced_line(spark: SparkSession, d: str) -> DataFrame:
    """Mean height by column, and the pixels of the line drawn through it."""
    points = table(spark, d, "events").select(F.col("event_type").alias("image"), F.pmod("event_id", F.lit(80)).alias("x"), F.pmod("user_id", F.lit(50)).cast("double").alias("y"))
    return pages.drawn(pages.mean_heights(points))


def page_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("image", F.col("event_type"))
    y, x = F.pmod("user_id", F.lit(64)).cast("double"), F.pmod("event_id", F.lit(48)).cast("double")
    contour = e.select("image", (y + 0.3).alias("y0"), x.alias("x0"), (y * 0.9).alias("y"), (x + 1.2).alias("x"))
    found = pages.scores(contour, _grid(spark, d), _mask(spark, d), 64, 48)
    return found.select("image", *(F.round(c, 5).alias(c) for c in ("edge", "movement", "border", "fill", "area", "penalty", "score")))


def lead_layout(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "part").select(F.col("p_partkey").alias("image"), (F.lit(1000) + F.col("p_partkey") * 7).cast("long").alias("height"), (F.lit(1500) + F.col("p_partkey") * 11).cast("long").alias("width"))
    return pages.lead_regions(sizes)


def drawn_leads(spark: SparkSession, d: str) -> DataFrame:
    """Twelve vectors each as the leads of a recording, drawn by its physical layout."""
    names = [x for row in pages.LEADS for x in row]
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 12).alias("image"), F.get(F.array(*map(F.lit, names)), F.pmod("vec_id", F.lit(12)).cast("int")).alias("lead"), F.posexplode("embedding").alias("i", "mv"))
    pictures = e.select("image").distinct().withColumn("height", F.lit(86)).withColumn("width", F.lit(112))
    drawn = pages.rasterised(e.withColumn("mv", F.col("mv").cast("double") * 2), pages.lead_regions(pictures), pictures)
    return drawn.groupBy("image", "lead").agg(F.count("*").alias("pixels"), F.sum("y").alias("ys"), F.sum(F.col("x") * F.col("y")).alias("xys"))


def renewed_items(spark: SparkSession, d: str) -> DataFrame:
    """Expected documents without a usable mark: what has to be made again."""
    usable = table(spark, d, "labels").where("quality IS NOT NULL AND toxic = 0").select("doc_id")
    return tables.renewed(table(spark, d, "documents").select("doc_id"), usable, "doc_id")


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "orders").select("o_orderkey", tables.hash_order("o_orderkey", 42).alias("place"))
    return keyed.orderBy("place", "o_orderkey").limit(300).select("o_orderkey")


def flat_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Blank and flat pictures among the event types' grids."""
    g = _grid(spark, d).withColumn("v", F.when(F.col("image") == "click", 1.0).otherwise(F.col("v") / 500))
    return images.flat(g)


QUERIES = {
    f.__name__: f
    for f in (
        inline_constants, dictionary_lookup, membership, skipped_failures, features_and_target, index_joined, best_setting, name_union, subset_test, mask_algebra, category_codes,
        json_list_rows, padded_tokens, picked_components, energy_maps, bordered, vote_peaks, projection_profile, traced_line, page_scores, lead_layout, drawn_leads, renewed_items, seeded_sample, flat_pictures,
    )
}

_LANES = "l(p, lane, weight) AS (VALUES ('1-URGENT', 'fast', 1), ('2-HIGH', 'fast', 2), ('5-LOW', 'slow', 9))"
_BOXES = """m AS (SELECT image, y, x, y * 2147483648 + x AS id FROM g WHERE v % 5 < 3),
    r AS (SELECT image, y, x, id AS c FROM m UNION SELECT m.image, m.y, m.x, r.c FROM r JOIN m ON m.image = r.image AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1 AND m.id <> r.c),
    p AS (SELECT image, y, x, min(c) AS component FROM r GROUP BY 1, 2, 3),
    b AS (SELECT image, component, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, count(*) AS area, max(y) - min(y) + 1 AS height, max(x) - min(x) + 1 AS width FROM p GROUP BY 1, 2)"""


def _convolved(name: str, kernel: list[list[float]]) -> str:
    cells = [(y - 1, x - 1, w) for y, row in enumerate(kernel) for x, w in enumerate(row) if w]
    return f"{name} AS (SELECT c.image, c.y, c.x, coalesce(sum(g.v * w), 0)::DOUBLE AS v FROM g c CROSS JOIN (VALUES {', '.join(f'({y}, {x}, {w}::DOUBLE)' for y, x, w in cells)}) k(dy, dx, w) LEFT JOIN g ON g.image = c.image AND g.y = c.y + dy AND g.x = c.x + dx GROUP BY 1, 2, 3)"


ORACLES = {
    "inline_constants": f"WITH {_LANES} SELECT lane, count(*) AS n, sum(weight)::BIGINT AS weight FROM orders JOIN l ON p = o_orderpriority GROUP BY 1",
    "dictionary_lookup": f"WITH {_LANES} SELECT o_orderkey, coalesce(lane, 'other') AS lane FROM orders LEFT JOIN l ON p = o_orderpriority",
    "membership": "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id % 10 NOT IN (0, 3)",
    "skipped_failures": """SELECT event_type, count(*) FILTER (WHERE k > 2) AS ok, count(*) - count(*) FILTER (WHERE k > 2) AS bad, round(sum(k) FILTER (WHERE k > 2), 4) AS total
        FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1""",
    "features_and_target": "SELECT p_partkey, p_size::VARCHAR AS features, p_retailprice FROM part",
    "index_joined": "SELECT c_custkey, guess FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS guess FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "best_setting": """SELECT o_orderstatus, arg_max(o_orderpriority, (score, -first)) AS best FROM (SELECT o_orderstatus, o_orderpriority, count(*) // 50 AS score, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1""",
    "name_union": "SELECT right(c_name, 2) AS name FROM customer UNION SELECT right(s_name, 2) FROM supplier",
    "subset_test": "SELECT l_suppkey, count(DISTINCT l_linestatus) FILTER (WHERE l_linestatus IN ('O', 'F')) = 2 AS both, count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber IN (6, 7)) = 2 AS late FROM lineitem GROUP BY 1",
    "mask_algebra": """SELECT l_linenumber, count(*) FILTER (WHERE a OR b) AS either, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE NOT a AND NOT b) AS neither, count(*) FILTER (WHERE a <> b) AS one
        FROM (SELECT l_linenumber, l_quantity > 25 AS a, l_discount > 0.05::DOUBLE AS b FROM lineitem) GROUP BY 1""",
    "category_codes": "SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events WHERE event_type IS NOT NULL",
    "json_list_rows": "SELECT o_orderkey, o_orderkey AS step, o_totalprice AS loss FROM orders UNION ALL SELECT o_orderkey, 7, NULL FROM orders",
    "padded_tokens": r"""SELECT item_id, array_to_string((list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') || ['[PAD]' for k in range(12)])[:12], ' ') AS tokens,
        least(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')), 12)::INT AS words FROM benchmark""",
    "picked_components": f"""WITH RECURSIVE {_GRID}, {_BOXES} SELECT *, round(area / (height * width), 6) AS fill FROM b
        WHERE area BETWEEN 2 AND 60 AND width / height BETWEEN 0.3::DOUBLE AND 3 AND area / (height * width) >= 0.5::DOUBLE""",
    "energy_maps": f"""WITH {_GRID}, {_convolved('s', [[1 / 16, 2 / 16, 1 / 16], [2 / 16, 4 / 16, 2 / 16], [1 / 16, 2 / 16, 1 / 16]])}, {_convolved('h', [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])},
        {_convolved('u', [[-1, -2, -1], [0, 0, 0], [1, 2, 1]])}, {_convolved('l', [[0, 1, 0], [1, -4, 1], [0, 1, 0]])}
        SELECT image, y, x, round(s.v, 5) AS smooth, round(sqrt(h.v * h.v + u.v * u.v), 5) AS sobel, round(abs(l.v), 5) AS laplace FROM s JOIN h USING (image, y, x) JOIN u USING (image, y, x) JOIN l USING (image, y, x)""",
    "bordered": f"WITH {_GRID} SELECT image, y, x, CASE WHEN y >= 6 AND y < 58 AND x >= 4 AND x < 44 THEN v ELSE 0 END::DOUBLE AS v FROM g",
    "vote_peaks": f"""WITH {_GROUPED}, t AS (SELECT *, max(votes) OVER (PARTITION BY image) AS top FROM v)
        SELECT a.image, a.theta, a.rho, a.votes FROM t a JOIN v b ON b.image = a.image AND abs(b.rho - a.rho) <= 3 AND abs(b.theta - a.theta) <= 10
        WHERE a.votes >= 0.5::DOUBLE * a.top GROUP BY 1, 2, 3, 4 HAVING max(b.votes) <= a.votes""",
    "projection_profile": f"WITH {_GROUPED} SELECT image, rho, max(votes) AS votes, arg_max(theta, (votes, -theta)) AS theta FROM v GROUP BY 1, 2",
    "traced_line": """WITH h AS (SELECT event_type AS image, event_id % 80 AS x, avg(user_id % 50) AS y FROM events GROUP BY 1, 2), c AS (SELECT image, x, round_even(y, 0)::BIGINT AS y FROM h),
        n AS (SELECT *, coalesce(lead(y) OVER (PARTITION BY image ORDER BY x), y) AS z FROM c) SELECT image, x, unnest(range(least(y, z), greatest(y, z) + 1)) AS y FROM n""",
    "page_scores": f"""WITH {_GRID}, c AS (SELECT event_type AS image, (user_id % 64)::DOUBLE AS y, (event_id % 48)::DOUBLE AS x FROM events),
        p AS (SELECT image, y + 0.3::DOUBLE AS y0, x AS x0, y * 0.9::DOUBLE AS y, x + 1.2::DOUBLE AS x FROM c),
        k AS (SELECT p.image, avg(coalesce(g.v, 0)) AS edge, avg(sqrt(pow(p.y - y0, 2) + pow(p.x - x0, 2))) / sqrt(64 * 64 + 48 * 48) AS movement,
                     avg((p.y < 3 OR p.y > 60 OR p.x < 3 OR p.x > 44)::INT) AS border
              FROM p LEFT JOIN g ON g.image = p.image AND g.y = greatest(0, least(63, round_even(p.y, 0))) AND g.x = greatest(0, least(47, round_even(p.x, 0))) GROUP BY 1),
        m AS (SELECT image, count(*) / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)) AS fill, count(*) / (64 * 48) AS area FROM g WHERE v % 5 < 3 GROUP BY 1),
        s AS (SELECT *, CASE WHEN area < 0.3::DOUBLE THEN (0.3::DOUBLE - area) / 0.6::DOUBLE WHEN area > 0.9::DOUBLE THEN (area - 0.9::DOUBLE) / 0.6::DOUBLE ELSE 0 END AS penalty FROM k JOIN m USING (image))
        SELECT image, round(edge, 5) AS edge, round(movement, 5) AS movement, round(border, 5) AS border, round(fill, 5) AS fill, round(area, 5) AS area, round(penalty, 5) AS penalty,
               round(edge + movement + fill - border - penalty, 5) AS score FROM s""",
    "lead_layout": """WITH s AS (SELECT p_partkey AS image, 1000 + p_partkey * 7 AS height, 1500 + p_partkey * 11 AS width FROM part),
        r(row, size, sofar, zero) AS (VALUES (1, 3.0::DOUBLE, 0.0::DOUBLE, 9.0::DOUBLE), (2, 4.0, 3.0, 12.5), (3, 3.5, 7.0, 16.0), (4, 2.0, 10.5, 19.5)),
        l(row, col, lead) AS (VALUES (1, 0, 'I'), (1, 1, 'aVR'), (1, 2, 'V1'), (1, 3, 'V4'), (2, 0, 'II'), (2, 1, 'aVL'), (2, 2, 'V2'), (2, 3, 'V5'), (3, 0, 'III'), (3, 1, 'aVF'), (3, 2, 'V3'), (3, 3, 'V6'), (4, 0, 'II_rhythm')),
        h AS (SELECT s.*, r.row, r.zero, round_even(8 * (height / 21.5::DOUBLE), 0) + sum(round_even(size * (height / 21.5::DOUBLE), 0)) OVER w AS y1, round_even(size * (height / 21.5::DOUBLE), 0) AS own FROM s, r WINDOW w AS (PARTITION BY image ORDER BY row))
        SELECT image, lead, row, (y1 - own)::BIGINT AS y0, least(y1, height)::BIGINT AS y1, round_even((1.5::DOUBLE + col * 6.25::DOUBLE) / 28 * width, 0)::BIGINT AS x0,
               CASE WHEN row = 4 THEN width - round_even(1.5::DOUBLE / 28 * width, 0) ELSE least(width, round_even((1.5::DOUBLE + (col + 1) * 6.25::DOUBLE) / 28 * width, 0)) END::BIGINT AS x1, round_even(zero * (height / 21.5::DOUBLE), 0)::BIGINT AS baseline
        FROM h JOIN l USING (row)""",
    "renewed_items": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality IS NOT NULL AND toxic = 0",
    "seeded_sample": "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '|42'), o_orderkey LIMIT 300",
    "flat_pictures": f"""WITH {_GRID}, q AS (SELECT image, CASE WHEN image = 'click' THEN 1 ELSE v / 500 END AS v FROM g)
        SELECT image, avg((v >= 0.99::DOUBLE)::INT) >= 0.995::DOUBLE OR stddev_pop(v) < 0.01::DOUBLE OR max(v) - min(v) < 0.02::DOUBLE AS flat FROM q GROUP BY 1""",
}
