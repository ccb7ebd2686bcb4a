"""Queries over the fixture tables, one or more for each operator family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import answers
from tessera.operators import ordered, signals, statistics, tables
from tessera.session import table

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def select_prefix(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").drop("p_type", "p_name")
    return tables.prefixed(part, "HOME_", ["p_partkey"])


def schema_reindex(spark: SparkSession, d: str) -> DataFrame:
    return tables.reindexed(table(spark, d, "supplier"), ["s_suppkey", "s_acctbal", "s_missing"])


def label_case_precedence(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    code = tables.ordered_case(
        [(F.col("o_totalprice") > 0, F.lit(1)), (F.col("o_orderstatus") == "F", F.lit(0)), (F.col("o_totalprice") > 200000, F.lit(2))]
    )
    return o.select("o_orderkey", code.alias("code")).select("o_orderkey", "code", *tables.one_hot("code", [0, 1, 2]))


def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id")
    sides = [docs.join(labels, "doc_id", how).groupBy("lang").agg(F.count("*").alias("n")).withColumn("side", F.lit(how)) for how in ("left_semi", "left_anti")]
    return sides[0].unionByName(sides[1])


def train_valid_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    valid = tables.top_per_group(docs.withColumn("part", F.pmod("doc_id", F.lit(8))), ["part"], [tables.hash_order("doc_id"), F.col("doc_id")], 10)
    return docs.join(valid.select("doc_id"), "doc_id", "left_anti").select("doc_id")


def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.hour("ts").cast("long").alias("hour"), "value")
    summed = lambda df, k: df.groupBy("event_type", "hour").agg(F.round(F.sum("value") * k, 4).alias("total"))
    return tables.upserted(summed(e, 1), summed(e.where("hour < 6"), 2), ["event_type", "hour"])


def group_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(*(F.round(F.sum(c), 4).alias(c) for c in MEASURES))


def group_named_agg(spark: SparkSession, d: str) -> DataFrame:
    late = F.count_if(F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(late.alias("matches"), F.count("*").alias("n"), F.round(late / F.count("*"), 6).alias("rate"))


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type IS NOT NULL").groupBy("event_type").agg(F.count("*").alias("n"))


def eval_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return tables.grouped_with_total(
        rows, "lang", [F.count("*").alias("n"), F.sum("toxic").cast("long").alias("matches"), F.round(F.avg("toxic"), 6).alias("rate"), F.round(F.avg("n_chars"), 4).alias("chars")]
    )


def first_per_group(spark: SparkSession, d: str) -> DataFrame:
    return tables.keep_first(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


def latest_value(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(tables.last_by("event_type", "ts", "event_id").alias("latest"))


def extremes_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    low, high = F.struct("l_quantity", -F.col("l_orderkey"), -F.col("l_linenumber")), F.struct("l_quantity", "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min_by("l_orderkey", low).alias("low"), F.max_by("l_orderkey", high).alias("high"))


def mode_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("n"))
    return counted.groupBy("l_suppkey").agg(F.max_by("l_quantity", F.struct("n", -F.col("l_quantity"))).alias("mode"))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return statistics.confusion(table(spark, d, "labels"), "quality", "toxic", [0, 1])


def mask_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").agg(*statistics.mask_scores(F.col("quality") == 1, F.col("toxic") == 0))


def accuracy_mse_r2(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_discount").alias("y"), F.col("l_tax").alias("p"))
    mean = li.agg(F.avg("y").alias("m"))
    error, spread = F.sum(F.pow(F.col("y") - F.col("p"), 2)), F.sum(F.pow(F.col("y") - F.col("m"), 2))
    return li.join(F.broadcast(mean)).agg(
        F.round(F.avg((F.col("y") == F.col("p")).cast("int")), 6).alias("accuracy"), F.round(error / F.count("*"), 8).alias("mse"), F.round(1 - error / spread, 6).alias("r2")
    )


def zscore_sample(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.scored(table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return statistics.min_max(out, "c_acctbal").select("c_custkey", F.round("c_acctbal_z", 6).alias("z"), F.round("c_acctbal_unit", 6).alias("unit"))


def ordinal_codes(spark: SparkSession, d: str) -> DataFrame:
    return statistics.ordinal_codes(table(spark, d, "orders"), "o_orderpriority").withColumn("code", F.col("code").cast("long"))


def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    return statistics.correlation_matrix(table(spark, d, "lineitem"), MEASURES).withColumn("r", F.round("r", 6))


def high_corr_columns(spark: SparkSession, d: str) -> DataFrame:
    return statistics.highly_correlated(statistics.correlation_matrix(table(spark, d, "lineitem"), MEASURES), 0.003)


def percentile_mad(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_linestatus", "l_quantity")
    high = ordered.quantiles(li, ["l_linestatus"], "l_quantity", {"p90": 0.9})
    return ordered.median_deviations(li, ["l_linestatus"], "l_quantity").join(high, "l_linestatus")


def hist_match(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("bin", F.least(F.floor("l_quantity"), F.lit(63)))
    sides = [statistics.histogram(li.where(c), "bin", 64) for c in ("l_linestatus = 'O'", "l_linestatus = 'F'")]
    return statistics.matching_levels(*sides)


def hist2d(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.floor(F.col("l_quantity") / 5).alias("bin_x"), F.floor(F.col("l_discount") * 50 + 1e-6).alias("bin_y"))
    counted = li.groupBy("bin_x", "bin_y").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(counted.agg(F.sum("n").alias("total")))).select("bin_x", "bin_y", "n", F.round(F.col("n") / F.col("total"), 8).alias("density"))


def block_topn(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("block", F.pmod("o_custkey", F.lit(16)))
    limits = o.groupBy("block").agg(F.count_if(F.col("o_orderstatus") == "P").alias("n_excess"))
    top = tables.top_per_group(o.join(F.broadcast(limits), "block"), ["block"], [F.desc("o_totalprice"), F.col("o_orderkey")], F.col("n_excess"))
    return top.select("block", "o_orderkey")


def topk_stable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def answer_functions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    raw = F.concat(F.lit("  `"), F.col("text"), F.lit("`. \\boxed{"), F.col("conv_id").cast("string"), F.lit("}"))
    return c.select(
        "conv_id",
        "turn",
        answers.final_answer(raw).alias("final"),
        answers.final_answer(F.col("text")).alias("plain"),
        F.md5(answers.normalize_answer(raw)).alias("normalized"),
        answers.infer_family(F.col("text"), (("a", (("einen",),)), ("b", (("the",),)), ("c", (("que",),)))).alias("family"),
        answers.run_slug(F.col("text")).alias("slug"),
    )


def coerce_values(spark: SparkSession, d: str) -> DataFrame:
    raw = F.get_json_object("props", "$.k")
    text = F.when(F.pmod("event_id", F.lit(3)) == 0, "n/a").otherwise(raw)
    return table(spark, d, "events").select("event_id", answers.to_number(text).alias("number"), answers.to_boolean(raw).alias("flag"))


def dft_magnitude(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", F.posexplode(signals.dft_magnitude(F.col("x"), 64)).alias("k", "m")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("m", 5).alias("magnitude"))


def _series_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    even = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("series"), F.col("x").alias("a"))
    return even.join(e.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("series"), F.col("x").alias("b")), "series")


def snr_gain(spark: SparkSession, d: str) -> DataFrame:
    rows = _series_pairs(spark, d).select("series", F.explode(F.arrays_zip("a", "b")).alias("p")).select("series", "p.a", "p.b")
    return rows.groupBy("series").agg(
        F.round(signals.signal_to_noise(F.col("a"), F.col("b")), 5).alias("snr_db"), F.round(F.regr_slope("a", "b"), 5).alias("gain"), F.round(F.regr_intercept("a", "b"), 5).alias("shift")
    )


def xcorr_align(spark: SparkSession, d: str) -> DataFrame:
    return _series_pairs(spark, d).select("series", signals.best_lag(F.col("a"), F.col("b"), 4).cast("long").alias("lag"))


def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", F.posexplode(signals.resampled(F.col("x"), 16)).alias("k", "v")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("v", 5).alias("v"))


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    return table(spark, d, "events").groupBy("event_type", hour.alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))


def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = _hourly(spark, d).withColumn("v", F.when(F.pmod("hour", F.lit(3)) != 0, F.col("v")))
    return signals.gaps_filled(rows, ["event_type"], "hour", "v").select("event_type", "hour", F.round("filled", 6).alias("filled"))


def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    return signals.local_maxima(_hourly(spark, d), ["event_type"], "hour", "n").select("event_type", "hour", "n")


def threshold_runs(spark: SparkSession, d: str) -> DataFrame:
    return signals.runs_over(_hourly(spark, d), ["event_type"], "hour", F.col("n") >= 2, 2)


def rolling_close(spark: SparkSession, d: str) -> DataFrame:
    rows = signals.moving(_hourly(spark, d), ["event_type"], "hour", F.col("v"), 1, F.max, "hi")
    return signals.moving(rows, ["event_type"], "hour", F.col("hi"), 1, F.min, "closed").select("event_type", "hour", "closed")


def spaced_peaks(spark: SparkSession, d: str) -> DataFrame:
    picks = signals.spaced_peaks(_hourly(spark, d), "event_type", "hour", "v", 6)
    return picks.select("event_type", F.posexplode("picks").alias("rank", "hour")).withColumn("rank", F.col("rank").cast("long"))


def spaced_users(spark: SparkSession, d: str) -> DataFrame:
    """Each type's best twelve users by value at least 5 apart, those of number 7 and 8 in any case, made up to twelve from the others."""
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.max("value").alias("v"))
    forced = e.where("user_id IN (7, 8)").select("event_type", "user_id")
    return ordered.spaced(e, ["event_type"], "user_id", "v", 5, count=12, refill=True, forced=forced)


def events_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each event of a user with the user's last event of the first type until then."""
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type").alias("t"))
    right = e.join(first, e["event_type"] == first["t"]).groupBy("user_id", "ts").agg(F.max("event_id").alias("seen"))
    return ordered.as_of(e.select("event_id", "user_id", "ts"), right, ["user_id"], "ts", ["seen"]).select("event_id", "user_id", "seen")


def hough(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "events").select(F.col("event_type").alias("image"), F.pmod("user_id", F.lit(64)).cast("double").alias("x"), F.pmod("event_id", F.lit(48)).cast("double").alias("y"))
    votes = signals.hough_votes(points, 12, 4.0)
    return tables.top_per_group(votes, ["image"], [F.desc("votes"), F.col("theta"), F.col("rho")], 5).select("image", F.col("theta").cast("long").alias("theta"), "rho", "votes")


QUERIES = {
    f.__name__: f
    for f in (
        select_prefix, schema_reindex, label_case_precedence, semi_anti, train_valid_split, upsert_replace, group_sum, group_named_agg, value_counts,
        eval_grouping_sets, first_per_group, latest_value, extremes_tiebreak, mode_tiebreak, confusion_matrix, mask_scores, accuracy_mse_r2, zscore_sample,
        ordinal_codes, corr_matrix, high_corr_columns, percentile_mad, hist_match, hist2d, block_topn, topk_stable, answer_functions, coerce_values,
        dft_magnitude, snr_gain, xcorr_align, resample_linear, gap_fill, local_maxima, threshold_runs, rolling_close, spaced_peaks, spaced_users, events_as_of, hough,
    )
}

_HOURLY = "h AS (SELECT event_type, epoch_us(ts) // 3600000000 AS hour, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2)"
_PAIRS = "s AS (SELECT a.vec_id AS series, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"
_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIR_ROWS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for k, a in enumerate(_CORR) for b in _CORR[k:]
)

ORACLES = {
    "select_prefix": "SELECT p_partkey, p_brand AS \"HOME_p_brand\", p_size AS \"HOME_p_size\", p_retailprice AS \"HOME_p_retailprice\" FROM part",
    "schema_reindex": "SELECT s_suppkey, s_acctbal, NULL::DOUBLE AS s_missing FROM supplier",
    "label_case_precedence": """SELECT o_orderkey, code, (code = 0)::INT AS code_0, (code = 1)::INT AS code_1, (code = 2)::INT AS code_2 FROM (
        SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 2 WHEN o_orderstatus = 'F' THEN 0 WHEN o_totalprice > 0 THEN 1 END AS code FROM orders)""",
    "semi_anti": """SELECT lang, count(*) AS n, side FROM (SELECT lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'left_semi' ELSE 'left_anti' END AS side
        FROM documents) GROUP BY lang, side""",
    "train_valid_split": """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY md5(concat(doc_id, '|42')), doc_id) AS rn FROM documents) WHERE rn > 10""",
    "upsert_replace": """WITH e AS (SELECT event_type, hour(ts)::BIGINT AS hour, sum(value) AS s FROM events GROUP BY 1, 2)
        SELECT event_type, hour, round(CASE WHEN hour < 6 THEN s * 2 ELSE s END, 4) AS total FROM e""",
    "group_sum": "SELECT l_suppkey, " + ", ".join(f"round(sum({c}), 4) AS {c}" for c in _CORR) + " FROM lineitem GROUP BY 1",
    "group_named_agg": """SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS matches, count(*) AS n,
        round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 6) AS rate FROM lineitem GROUP BY 1""",
    "value_counts": "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1",
    "eval_grouping_sets": """SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(*) AS n, sum(toxic)::BIGINT AS matches,
        round(avg(toxic), 6) AS rate, round(avg(n_chars), 4) AS chars FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang))""",
    "first_per_group": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    "latest_value": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY 1",
    "extremes_tiebreak": """SELECT l_suppkey, arg_min(l_orderkey, (l_quantity, -l_orderkey, -l_linenumber)) AS low,
        arg_max(l_orderkey, (l_quantity, l_orderkey, l_linenumber)) AS high FROM lineitem GROUP BY 1""",
    "mode_tiebreak": """SELECT l_suppkey, arg_max(l_quantity, (n, -l_quantity)) AS mode FROM (
        SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
    "confusion_matrix": "SELECT quality, count(*) FILTER (WHERE toxic = 0) AS p_0, count(*) FILTER (WHERE toxic = 1) AS p_1 FROM labels GROUP BY 1",
    "mask_scores": """SELECT tp, fp, fn, tp / greatest(tp + fp, 1) AS prec, tp / greatest(tp + fn, 1) AS rec, tp / greatest(tp + fp + fn, 1) AS iou FROM (
        SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality <> 1 AND toxic = 0) AS fp,
               count(*) FILTER (WHERE quality = 1 AND toxic <> 0) AS fn FROM labels)""",
    "accuracy_mse_r2": """SELECT round(avg((l_discount = l_tax)::INT), 6) AS accuracy, round(avg(pow(l_discount - l_tax, 2)), 8) AS mse,
        round(1 - sum(pow(l_discount - l_tax, 2)) / sum(pow(l_discount - m, 2)), 6) AS r2 FROM lineitem, (SELECT avg(l_discount) AS m FROM lineitem)""",
    "zscore_sample": """SELECT c_custkey, round((c_acctbal - m) / s, 6) AS z, round((c_acctbal - lo) / (hi - lo), 6) AS unit FROM customer,
        (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""",
    "ordinal_codes": "SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority IS NULL, upper(o_orderpriority), o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)",
    "corr_matrix": _PAIR_ROWS,
    "high_corr_columns": f"SELECT DISTINCT unnest([a, b]) AS column_name FROM ({_PAIR_ROWS}) WHERE a <> b AND abs(r) > 0.003",
    "percentile_mad": """WITH m AS (SELECT l_linestatus, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY 1)
        SELECT l_linestatus, median, p90, quantile_cont(abs(l_quantity - median), 0.5) AS mad FROM lineitem JOIN m USING (l_linestatus) GROUP BY ALL""",
    "hist_match": """WITH b AS (SELECT l_linestatus AS s, least(floor(l_quantity), 63)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
        g AS (SELECT s, bin FROM range(64) r(bin), (SELECT unnest(['O', 'F']) AS s)),
        c AS (SELECT s, bin, sum(coalesce(n, 0)) OVER (PARTITION BY s ORDER BY bin) / sum(coalesce(n, 0)) OVER (PARTITION BY s) AS cdf FROM g LEFT JOIN b USING (s, bin))
        SELECT o.bin, coalesce((SELECT min(f.bin) FROM c f WHERE f.s = 'F' AND f.cdf >= o.cdf - 1e-12), 63) AS level FROM c o WHERE o.s = 'O'""",
    "hist2d": """SELECT bin_x, bin_y, n, round(n / sum(n) OVER (), 8) AS density FROM (
        SELECT floor(l_quantity / 5)::BIGINT AS bin_x, floor(l_discount * 50 + 1e-6)::BIGINT AS bin_y, count(*) AS n FROM lineitem GROUP BY 1, 2)""",
    "block_topn": """SELECT block, o_orderkey FROM (SELECT o_custkey % 16 AS block, o_orderkey,
        row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_totalprice DESC, o_orderkey) AS rn,
        count(*) FILTER (WHERE o_orderstatus = 'P') OVER (PARTITION BY o_custkey % 16) AS k FROM orders) WHERE rn <= k""",
    "topk_stable": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "coerce_values": """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN try_cast(json_extract_string(props, '$.k') AS DOUBLE) END AS number,
        lower(json_extract_string(props, '$.k')) IN ('true', '1', 'yes') AS flag FROM events""",
    "dft_magnitude": """WITH r AS (SELECT vec_id, k, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) AS n
            FROM embeddings, range(64) t(k))
        SELECT vec_id, k, round(sqrt(pow(sum(v * cos(-2 * pi() * k * i / n)), 2) + pow(sum(v * sin(-2 * pi() * k * i / n)), 2)), 5) AS magnitude FROM r GROUP BY 1, 2""",
    "snr_gain": f"""WITH {_PAIRS}, r AS (SELECT series, unnest(a) AS a, unnest(b) AS b FROM s)
        SELECT series, round(10 * log10((sum(a * a) + 1e-12) / (sum((a - b) * (a - b)) + 1e-12)), 5) AS snr_db,
               round(regr_slope(a, b), 5) AS gain, round(regr_intercept(a, b), 5) AS shift FROM r GROUP BY 1""",
    "xcorr_align": f"""WITH {_PAIRS}, m AS (SELECT series, a, b, list_avg(a) AS ma, list_avg(b) AS mb, len(a) AS n FROM s),
        q AS (SELECT series, lag, list_sum(list_transform(range(greatest(1, 1 - lag), least(n, n - lag) + 1), lambda j: (a[j] - ma) * (b[j + lag] - mb))) AS score FROM m, range(-4, 5) t(lag))
        SELECT series, arg_max(lag, (score, -lag)) AS lag FROM q GROUP BY 1""",
    "resample_linear": """WITH r AS (SELECT vec_id, k, embedding::DOUBLE[] AS x, k * (len(embedding) - 1) / 15.0 AS p FROM embeddings, range(16) t(k))
        SELECT vec_id, k, round(x[floor(p)::INT + 1] + (x[least(floor(p)::INT + 2, len(x))] - x[floor(p)::INT + 1]) * (p - floor(p)), 5) AS v FROM r""",
    "gap_fill": f"""WITH {_HOURLY}, g AS (SELECT event_type, hour, CASE WHEN hour % 3 <> 0 THEN v END AS v FROM h),
        w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN hour END IGNORE NULLS) OVER p AS bh, last_value(v IGNORE NULLS) OVER p AS bv,
                     first_value(CASE WHEN v IS NOT NULL THEN hour END IGNORE NULLS) OVER q AS ah, first_value(v IGNORE NULLS) OVER q AS av
              FROM g WINDOW p AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                            q AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT event_type, hour, round(coalesce(v, bv + (av - bv) * ((hour - bh) / (ah - bh)), bv, av), 6) AS filled FROM w""",
    "local_maxima": f"""WITH {_HOURLY} SELECT event_type, hour, n FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour)
        QUALIFY n >= coalesce(lag(n) OVER w, n) AND n >= coalesce(lead(n) OVER w, n)""",
    "threshold_runs": f"""WITH {_HOURLY}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour) - row_number() OVER (PARTITION BY event_type, n >= 2 ORDER BY hour) AS g FROM h)
        SELECT event_type, min(hour) AS first, max(hour) AS last, count(*) AS n FROM r WHERE n >= 2 GROUP BY event_type, g HAVING count(*) >= 2""",
    "rolling_close": f"""WITH {_HOURLY}, m AS (SELECT event_type, hour, max(v) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS hi FROM h)
        SELECT event_type, hour, min(hi) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS closed FROM m""",
    "spaced_peaks": f"""WITH RECURSIVE {_HOURLY}, r AS (
            SELECT event_type, 0::BIGINT AS rank, arg_max(hour, (v, -hour)) AS hour, [arg_max(hour, (v, -hour))] AS done FROM h GROUP BY 1
            UNION ALL
            SELECT r.event_type, any_value(r.rank) + 1, arg_max(h.hour, (v, -h.hour)), list_append(any_value(done), arg_max(h.hour, (v, -h.hour)))
            FROM r JOIN h USING (event_type) WHERE len(list_filter(done, lambda x: abs(x - h.hour) < 6)) = 0 GROUP BY 1)
        SELECT event_type, rank, hour FROM r""",
    "spaced_users": """WITH RECURSIVE e AS (SELECT event_type, user_id, max(value) AS v FROM events GROUP BY 1, 2),
        f AS (SELECT event_type, list(user_id) AS done FROM e WHERE user_id IN (7, 8) GROUP BY 1),
        r AS (SELECT DISTINCT e.event_type, NULL::BIGINT AS user_id, 0 AS rank, coalesce(done, []) AS done FROM e LEFT JOIN f USING (event_type)
            UNION ALL
            SELECT r.event_type, arg_max(e.user_id, (v, -e.user_id)), any_value(r.rank) + 1, list_append(any_value(done), arg_max(e.user_id, (v, -e.user_id)))
            FROM r JOIN e USING (event_type) WHERE len(list_filter(done, lambda x: abs(x - e.user_id) < 5)) = 0 GROUP BY 1),
        t AS (SELECT e.*, CASE WHEN e.user_id IN (7, 8) THEN 0 WHEN r.user_id IS NOT NULL THEN 1 ELSE 2 END AS tier FROM e LEFT JOIN r USING (event_type, user_id))
        SELECT event_type, user_id, v FROM t QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY tier, v DESC, user_id) <= 12""",
    "events_as_of": """WITH r AS (SELECT user_id, ts, max(event_id) AS seen FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1, 2)
        SELECT e.event_id, e.user_id, r.seen FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts""",
    "hough": """WITH p AS (SELECT event_type AS image, (user_id % 64)::DOUBLE AS x, (event_id % 48)::DOUBLE AS y FROM events),
        v AS (SELECT image, theta, round((x * cos(theta * pi() / 12) + y * sin(theta * pi() / 12)) / 4 + 1e-7)::BIGINT AS rho, count(*) AS votes FROM p, range(12) t(theta) GROUP BY 1, 2, 3)
        SELECT image, theta, rho, votes FROM v QUALIFY row_number() OVER (PARTITION BY image ORDER BY votes DESC, theta, rho) <= 5""",
}
