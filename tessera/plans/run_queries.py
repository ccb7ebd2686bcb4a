"""Queries that compare runs, join and sort tables, and shape arrays and texts.

Events stand in for evaluations: a user mod 6 is a run, the day a step, the type a phase or family, an even whole value a hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import answers
from tessera.operators import runs, tables
from tessera.session import table

PHASES = ("view", "purchase", "click")
MEASURE_COLUMNS = ("high", "low")


def _evaluations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(
        "event_id", F.concat(F.lit("r"), F.pmod("user_id", F.lit(6)).cast("string")).alias("run"), F.dayofmonth("ts").cast("long").alias("step"), F.col("event_type").alias("phase"),
        F.pmod("event_id", F.lit(40)).alias("item"), (F.pmod(F.floor("value"), F.lit(2)) == 0).cast("long").alias("correct"),
        F.when(F.col("value") > 100, F.col("value")).alias("high"), F.when(F.col("value") <= 100, F.col("value")).alias("low"),
    )


def inner_merge(spark: SparkSession, d: str) -> DataFrame:
    """Labels merged with themselves under two keys, one of them with nulls, which match."""
    left = table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.nullif("quality", F.lit(0)).alias("grade"), "toxic")
    right = table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.nullif("quality", F.lit(0)).alias("grade"), F.col("quality").alias("again"))
    return tables.merged(left, right, ["key", "grade"])


def group_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("first_key"))


def dedupe_precedence(spark: SparkSession, d: str) -> DataFrame:
    return runs.preferred(_evaluations(spark, d), ["run", "step"], PHASES, "event_id").select("run", "step", "phase", "event_id")


def run_rates(spark: SparkSession, d: str) -> DataFrame:
    return runs.rates(_evaluations(spark, d), ["run", "phase"]).withColumn("percent", F.round("percent", 6))


def run_points(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_points(_evaluations(spark, d).withColumn("step", F.when(F.col("run") == "r0", F.lit(1)).otherwise(F.col("step")).cast("long")))


def run_latest(spark: SparkSession, d: str) -> DataFrame:
    return runs.latest_values(_evaluations(spark, d), ["run"], "step", "event_id", MEASURE_COLUMNS)


def run_values_at_step(spark: SparkSession, d: str) -> DataFrame:
    return runs.values_at_step(_evaluations(spark, d), ["run"], "step", "event_id", MEASURE_COLUMNS)


def pivot_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.side_by_side(_evaluations(spark, d), "item", [f"r{k}" for k in range(6)], ("phase", "correct"), "event_id")


def metadata_explode(spark: SparkSession, d: str) -> DataFrame:
    whole = F.from_json("props", "map<string,double>")
    e = table(spark, d, "events").select("event_id", F.col("value").alias("total"), whole.alias("by_family"))
    return runs.metric_rows(e, ["event_id"], "total", "by_family")


def missing_names(spark: SparkSession, d: str) -> DataFrame:
    suppliers = table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("key"))
    return runs.missing_names(suppliers, table(spark, d, "nation").select(F.col("n_nationkey").alias("key")), "key")


def masked_mae(spark: SparkSession, d: str) -> DataFrame:
    away = F.abs(F.col("l_discount") - F.col("l_tax"))
    inside = F.col("l_returnflag") == "R"
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(
        F.round(F.avg(F.when(inside, away)), 8).alias("inside"), F.round(F.avg(F.when(~inside, away)), 8).alias("outside"),
        F.round(F.avg(inside.cast("double")), 8).alias("share"), F.round(F.avg(F.when(F.col("l_returnflag") == "none", away)), 8).alias("nothing"),
    )


def dice_overlap(spark: SparkSession, d: str) -> DataFrame:
    p, y = F.col("l_discount") * 10, F.col("l_tax") * 12.5
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(
        F.round(2 * F.sum(p * y) / (F.sum(p + y) + 1e-6), 8).alias("dice"), F.round(F.sum(F.abs(p - y) * F.col("l_quantity")) / (F.sum("l_quantity") + 1e-6), 8).alias("weighted_l1")
    )


def first_differences(spark: SparkSession, d: str) -> DataFrame:
    steps = _evaluations(spark, d).select("run", "event_id")
    return tables.spacing(steps, ["run"], "event_id")


def percent_limit(spark: SparkSession, d: str) -> DataFrame:
    from tessera.sources.files import first_fraction

    return first_fraction(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.03)


def custom_rank_sort(spark: SparkSession, d: str) -> DataFrame:
    rank = answers.custom_rank(F.col("o_orderpriority"), ("5-LOW", "1-URGENT"))
    return table(spark, d, "orders").select("o_orderkey", rank.cast("long").alias("rank")).orderBy("rank", "o_orderkey")


def pad_truncate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", tables.sized(F.slice(F.col("embedding").cast("array<double>"), 1, F.expr("cast(pmod(vec_id, 65) AS INT)")), 48).alias("v"))
    rows = e.select(F.posexplode("v").alias("i", "value"), "vec_id")
    return rows.select(F.concat_ws("_", "vec_id", "i", F.lit("II")).alias("id"), "value")


def argmax_onehot(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    best = (F.array_position(v, F.array_max(v)) - 1).alias("code")
    return table(spark, d, "embeddings").select("vec_id", best).select("vec_id", *tables.one_hot("code", list(range(64))))


def weighted_centroid(spark: SparkSession, d: str) -> DataFrame:
    """For each column of an image the mass-weighted row, where there is mass enough."""
    e = table(spark, d, "events").select("event_type", F.pmod("event_id", F.lit(32)).alias("x"), F.pmod("user_id", F.lit(50)).alias("y"), (F.col("value") / 500).alias("p"))
    mass, moment = F.sum(F.col("p") * F.col("p")), F.sum(F.col("p") * F.col("p") * F.col("y"))
    return e.groupBy("event_type", "x").agg(F.when(mass > 0.05, F.round(moment / (mass + 1e-8), 6)).alias("y"))


def sft_text(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    text = answers.training_text("Answer in a box.", F.col("text"), F.col("conv_id"), "boxed")
    return c.select("conv_id", "turn", F.md5(text).alias("digest"), answers.point_label(F.col("role"), F.col("conv_id")).alias("label"))


def final_answers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("Final answer: x\n\\boxed{ "), F.col("conv_id").cast("string"), F.lit("}} then \\boxed{ }")).alias("t"))
    return c.select("conv_id", "turn", answers.final_answer(F.col("t")).alias("answer"))


def coalesce_keys(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", answers.first_filled(F.when(F.col("o_orderstatus") == "F", ""), F.when(F.col("o_totalprice") > 2e5, "high"), F.col("o_orderstatus")).alias("first"))


LETTERS, TURNED = "abcdefghijklmnopqrstuvwxyz", "nopqrstuvwxyzabcdefghijklm"


def cipher_trace(spark: SparkSession, d: str) -> DataFrame:
    """Part names under a letter cipher: the alphabet is the worked example, so every letter is known."""
    turned = F.translate(F.lower("p_name"), LETTERS, TURNED)
    prompt = F.concat(F.lit(f"secret encryption rules\n{TURNED} -> {LETTERS}\ndecrypt the following text: "), turned)
    return table(spark, d, "part").select("p_partkey", answers.cipher_trace(prompt, F.lit("")).alias("trace"))


def cipher_cases(spark: SparkSession, d: str) -> DataFrame:
    """Known pairs, unknown letters with and without an answer to fall back on, a clash, no pairs, another text."""
    key, seg = F.col("c_custkey"), F.lower("c_mktsegment")
    rule = "secret encryption rules\n"
    prompts = [
        F.concat(F.lit(rule + "- ab cd -> xy "), seg, F.lit("\ndecrypt the following text: cd ba.")), rule + "ab -> xy\ndecrypt the following text: ba zz",
        rule + "ab -> xy\nac -> zy\ndecrypt the following text: ab", rule + "decrypt the following text: ab", "ab -> xy\ndecrypt the following text: ab", rule + "ab -> xy\nab -> xyz\nDecrypt the following text: ab",
    ]
    prompt = F.lit(None).cast("string")
    for k, text in enumerate(prompts):
        prompt = F.when(key % 7 == k, F.lit(text) if isinstance(text, str) else text).otherwise(prompt)
    gold = F.when(key % 2 == 0, F.concat(F.lit("first "), seg))
    return table(spark, d, "customer").select("c_custkey", answers.cipher_trace(prompt, gold).alias("trace"))


def coerced_flags(spark: SparkSession, d: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, (" true", "Yes", "1", "no", "0", "NaN", " 2.50 ", "1e3", "x1", ""))), F.pmod("event_id", F.lit(11)).cast("int"))
    return table(spark, d, "events").select("event_id", answers.to_number(text).alias("number"), answers.to_boolean(text).alias("flag"))


QUERIES = {
    f.__name__: f
    for f in (
        cipher_cases, coerced_flags, inner_merge, group_size, distinct_values, dedupe_precedence, run_rates, run_points, run_latest, run_values_at_step, pivot_runs, metadata_explode,
        missing_names, masked_mae, dice_overlap, first_differences, percent_limit, custom_rank_sort, pad_truncate, argmax_onehot, weighted_centroid,
        sft_text, final_answers, coalesce_keys, cipher_trace,
    )
}

_EVALUATIONS = """e AS (SELECT event_id, 'r' || (user_id % 6) AS run, day(ts)::BIGINT AS step, event_type AS phase, event_id % 40 AS item, (floor(value)::BIGINT % 2 = 0)::BIGINT AS correct,
    CASE WHEN value > 100 THEN value END AS high, CASE WHEN value <= 100 THEN value END AS low FROM events)"""

ORACLES = {
    "cipher_cases": """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Trace: cd->' || lower(c_mktsegment) || '; ba->yx.'
        WHEN 1 THEN 'Trace: ba->yx; zz->' || CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE '??' END || '.' WHEN 5 THEN 'Trace: ab->xyz.' END AS trace FROM customer""",
    "coerced_flags": """SELECT event_id, [NULL, NULL, 1, NULL, 0, NULL, 2.5, 1000, NULL, NULL, NULL][event_id % 11 + 1]::DOUBLE AS number,
        [true, true, true, false, false, false, false, false, false, false, NULL][event_id % 11 + 1] AS flag FROM events""",
    "inner_merge": """WITH l AS (SELECT doc_id AS key, nullif(quality, 0) AS grade, toxic, quality FROM labels)
        SELECT a.key, a.grade, a.toxic, b.quality AS again FROM l a JOIN l b ON a.key IS NOT DISTINCT FROM b.key AND a.grade IS NOT DISTINCT FROM b.grade""",
    "group_size": "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3",
    "distinct_values": "SELECT o_orderpriority, min(o_orderkey) AS first_key FROM orders GROUP BY 1",
    "dedupe_precedence": f"""WITH {_EVALUATIONS} SELECT run, step, phase, event_id FROM e QUALIFY row_number() OVER (PARTITION BY run, step
        ORDER BY CASE phase WHEN 'view' THEN 0 WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 5 END, event_id) = 1""",
    "run_rates": f"WITH {_EVALUATIONS} SELECT run, phase, count(*) AS n, sum(correct)::BIGINT AS matches, round(100.0::DOUBLE * sum(correct) / count(*), 6) AS percent FROM e GROUP BY 1, 2",
    "run_points": f"""WITH {_EVALUATIONS}, f AS (SELECT run, CASE WHEN run = 'r0' THEN 1 ELSE step END AS step FROM e), n AS (SELECT run, count(DISTINCT step) AS n FROM f GROUP BY 1)
        SELECT DISTINCT run, CASE WHEN n > 1 THEN step END AS step, CASE WHEN n > 1 THEN run || '-step-' || step ELSE run END AS label FROM f JOIN n USING (run)""",
    "run_latest": f"""WITH {_EVALUATIONS}, u AS (SELECT run, step, event_id, 0 AS k, high AS v FROM e UNION ALL SELECT run, step, event_id, 1, low FROM e)
        SELECT run, arg_max(v, (step, event_id, k)) AS value FROM u WHERE v IS NOT NULL GROUP BY 1""",
    "run_values_at_step": f"""WITH {_EVALUATIONS} SELECT run, step, coalesce(arg_max(high, event_id) FILTER (WHERE high IS NOT NULL),
        arg_max(low, event_id) FILTER (WHERE low IS NOT NULL)) AS value FROM e GROUP BY 1, 2""",
    "pivot_runs": f"WITH {_EVALUATIONS} SELECT item, "
    + ", ".join(f"arg_max({c}, event_id) FILTER (WHERE run = '{r}') AS \"{r} {c}\"" for r in (f"r{k}" for k in range(6)) for c in ("phase", "correct"))
    + " FROM e GROUP BY 1",
    "metadata_explode": """SELECT event_id, 'all' AS family, value FROM events UNION ALL
        SELECT event_id, unnest(json_keys(props)), json_extract(props, '$.k')::DOUBLE FROM events""",
    "missing_names": "SELECT n_nationkey AS key FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000",
    "masked_mae": """SELECT l_linestatus, round(avg(abs(l_discount - l_tax)) FILTER (WHERE l_returnflag = 'R'), 8) AS inside,
        round(avg(abs(l_discount - l_tax)) FILTER (WHERE l_returnflag <> 'R'), 8) AS outside, round(avg((l_returnflag = 'R')::INT), 8) AS share, NULL::DOUBLE AS nothing FROM lineitem GROUP BY 1""",
    "dice_overlap": """SELECT l_linenumber, round(2 * sum(p * y) / (sum(p + y) + 1e-6), 8) AS dice, round(sum(abs(p - y) * l_quantity) / (sum(l_quantity) + 1e-6), 8) AS weighted_l1
        FROM (SELECT *, l_discount * 10 AS p, l_tax * 12.5::DOUBLE AS y FROM lineitem) GROUP BY 1""",
    "first_differences": f"""WITH {_EVALUATIONS}, g AS (SELECT run, event_id - lag(event_id) OVER (PARTITION BY run ORDER BY event_id) AS gap FROM e)
        SELECT run, quantile_cont(gap, 0.5)::DOUBLE AS median_gap FROM g GROUP BY 1""",
    "percent_limit": "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= floor(count(*) OVER () * 0.03::DOUBLE)",
    "custom_rank_sort": "SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 999 END::BIGINT AS rank FROM orders",
    "pad_truncate": """SELECT concat(vec_id, '_', i, '_II') AS id, CASE WHEN i < vec_id % 65 THEN embedding[i + 1]::DOUBLE ELSE 0 END AS value FROM embeddings, range(48) t(i)""",
    "argmax_onehot": "SELECT vec_id, " + ", ".join(f"(c = {k})::INT AS code_{k}" for k in range(64)) + " FROM (SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS c FROM embeddings)",
    "weighted_centroid": """SELECT event_type, x, CASE WHEN sum(p * p) > 0.05::DOUBLE THEN round(sum(p * p * y) / (sum(p * p) + 1e-8), 6) END AS y FROM (
        SELECT event_type, event_id % 32 AS x, user_id % 50 AS y, value / 500 AS p FROM events) GROUP BY 1, 2""",
    "sft_text": """SELECT conv_id, turn, md5(concat('System:', chr(10), 'Answer in a box.', chr(10), chr(10), 'User:', chr(10), text, chr(10), chr(10), 'Assistant:', chr(10), '\\boxed{', conv_id, '}')) AS digest,
        concat(role, '-step-', conv_id) AS label FROM conversations""",
    "final_answers": "SELECT conv_id, turn, concat(conv_id, '}') AS answer FROM conversations",
    "coalesce_keys": "SELECT o_orderkey, CASE WHEN o_totalprice > 2e5 THEN 'high' ELSE o_orderstatus END AS first FROM orders",
    "cipher_trace": f"""SELECT p_partkey, concat('Trace: ', list_aggregate(list_transform(str_split(lower(p_name), ' '), lambda w: concat(translate(w, '{LETTERS}', '{TURNED}'), '->', w)), 'string_agg', '; '), '.') AS trace FROM part""",
}
