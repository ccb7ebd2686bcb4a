"""Queries of text rules, projections, splits, scalar functions, spectra, alignment and line selection, with their twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import answers, values
from tessera.operators import lines, ordered, runs, signals, spectra, tables
from tessera.session import table


def _picked(key: str, texts: list[Column | str | None]) -> Column:
    """The text whose place is the key's remainder."""
    out = F.lit(None).cast("string")
    for k, text in enumerate(texts):
        out = F.when(F.pmod(F.col(key), F.lit(len(texts))) == k, F.lit(text) if not isinstance(text, Column) else text).otherwise(out)
    return out


# --- text rules ---------------------------------------------------------------------------------

_PROMPTS = (
    "Here is a Bit Manipulation rule", "turn this 8-bit binary", "a secret encryption", "please DECRYPT it", "the numeral system of old", "convert this unit",
    "a unit only", "convert only", "rabbit united", "the Gravitational Constant g", "a falling distance", "transformation rules is applied to equations", "determine the result for x",
    "decrypt in a numeral system", None, "",
)


def family_rules(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("prompt", _picked("c_custkey", list(_PROMPTS)))
    return c.select("c_custkey", answers.infer_family(F.col("prompt")).alias("family"))


def final_answer_cases(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("c_mktsegment")
    texts = [
        F.concat(F.lit("x \\boxed{"), name, F.lit("} y \\boxed{ }")), F.concat(F.lit("The Final Answer is: `"), name, F.lit(".`\n 7")),
        F.concat(F.lit("so "), F.col("c_custkey").cast("string"), F.lit(" and -4.5 it is")), "only words\n\n Answer: last ", F.concat(F.lit("\\boxed{open to "), name),
        "Answer:", None, "so final answer： eight\n9", F.concat(F.lit("\\boxed{a"), name, F.lit("}b} z")), "final answer - \r\nassistant: `done` \n \n",
    ]
    return table(spark, d, "customer").select("c_custkey", answers.final_answer(_picked("c_custkey", texts)).alias("answer"))


def training_answers(spark: SparkSession, d: str) -> DataFrame:
    prompt = F.when(F.col("c_custkey") % 2 == 0, "secret encryption rules\nab -> xy\ndecrypt the following text: ba zz")
    answer = F.concat(F.lit(" `"), F.col("c_mktsegment"), F.lit(".` "))
    return table(spark, d, "customer").select(
        "c_custkey", answers.training_answer(answer, "short_trace_boxed", prompt).alias("traced"), answers.training_answer(answer).alias("raw"),
        answers.shown_answer(F.when(F.col("c_custkey") % 3 == 0, "NaN").when(F.col("c_custkey") % 3 == 1, answer)).alias("shown"),
    )


def experiment_codes(spark: SparkSession, d: str) -> DataFrame:
    name = _picked("c_custkey", ["Run S4 x", "RAW_FULL", "my active_02", F.col("c_name"), "smol one", "--", None, "a long name of more than eighteen"])
    score = F.when(F.col("c_custkey") % 5 == 0, 0.62)
    return table(spark, d, "customer").select("c_custkey", answers.experiment_code(name, F.when(F.col("c_custkey") % 7 == 0, "attention_expand"), score).alias("code"))


def labels_of_values(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    path = F.concat(F.lit("runs/"), F.col("o_orderpriority"), F.lit("/part."), F.col("o_orderkey").cast("string"), _picked("o_orderkey", [".tar.gz", "", ".csv"]))
    return o.select(
        "o_orderkey", values.clock(F.col("o_totalprice") / 100).alias("clock"), values.html_escaped(F.concat(F.lit("<b>'"), "o_orderstatus", F.lit("' & \"x\"</b>"))).alias("escaped"),
        values.joined(F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderstatus", F.lit("z")))).alias("joined"), values.file_stem(path).alias("stem"),
        values.trailing_int(F.concat(F.lit("step-"), F.col("o_orderkey").cast("string"))).alias("step"), values.alias(F.upper(F.lit(" s ")), {"s": "score", "g": "global"}).alias("alias"),
        values.to_long(_picked("o_orderkey", ["12", "12.0", "12.5", "x", None])).alias("whole"),
    )


# --- projections, joins, splits -------------------------------------------------------------------


def positional(spark: SparkSession, d: str) -> DataFrame:
    """Columns by place, renamed by place, one of them strictly whole."""
    o = tables.at_positions(table(spark, d, "orders"), [0, 2, -1])
    rest = tables.at_positions(table(spark, d, "orders"), slice(3, 4))
    assert rest.columns == ["o_totalprice"]
    return tables.renamed(o, ["id", "status", "urgency"]).withColumn("id", tables.strict_int("id")).dropna(subset=["status", "urgency"])


def outer_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id % 3 > 0").select("doc_id", "n_chars")
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return tables.side_by_key([docs, marks], "doc_id")


def tail_rows(spark: SparkSession, d: str) -> DataFrame:
    return tables.last_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 25)


def described_columns(spark: SparkSession, d: str) -> DataFrame:
    found = ordered.described(table(spark, d, "part"), ["p_size", "p_retailprice"])
    return found.select("name", *(F.round(c, 4).alias(c) for c in ("mean", "std", "low", "high", "median")))


def group_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(tables.sorted_set("o_orderpriority").alias("urgencies"), tables.first_of_group("o_orderstatus", "o_orderdate", "o_orderkey").alias("status"))


def first_groups(spark: SparkSession, d: str) -> DataFrame:
    """The first order of each customer, and of these the first forty."""
    firsts = tables.keep_first(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderkey")]).select("o_orderkey", "o_custkey")
    return tables.first_rows(firsts, ["o_orderkey"], 40)


def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return tables.holdout(table(spark, d, "documents").select("doc_id"), "doc_id", 0.13, seed=7, least=20)


def category_draws(spark: SparkSession, d: str) -> DataFrame:
    weights = [("clean", 1.0), ("mobile", 3.0), ("stained", 2.0)]
    choices = F.array(*(tables.weighted_choice(tables.uniform(F.col("o_orderkey"), f"try{k}"), weights) for k in range(3)))
    there = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("stained"))).otherwise(F.array(F.lit("clean"), F.lit("stained")))
    return table(spark, d, "orders").select("o_orderkey", F.when(tables.uniform(F.col("o_orderkey"), "same") < 0.1, "identity").otherwise(tables.first_available(choices, there, "identity")).alias("drawn"))


def weighted_draw(spark: SparkSession, d: str) -> DataFrame:
    lines_ = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    u = lines_.select("l_orderkey").distinct().withColumn("u", tables.uniform(F.col("l_orderkey"), "crop"))
    return tables.drawn_by_weight(lines_, ["l_orderkey"], "l_quantity", u, "l_linenumber").select("l_orderkey", "l_linenumber")


def flattened_sections(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("s_suppkey").cast("string")
    sections = F.create_map(F.lit("hough"), F.create_map(F.lit("ratio"), n, F.lit("bins"), F.lit("9")), F.lit("energy"), F.create_map(F.lit("mode"), F.lit("sobel")))
    df = table(spark, d, "supplier").select("s_suppkey", sections.alias("sections"))
    return tables.flattened(df, "sections", {"hough": "hough_"}, {"hough_bins": "n_bins"})


def wide_array(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    wide = tables.widened(e, "embedding", 66, "e")
    return wide.select("vec_id", *(F.round(F.col(f"e{k}").cast("double"), 6).alias(f"e{k}") for k in range(66)))


# --- scalar functions -----------------------------------------------------------------------------


def intensity_functions(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("value") / 100 - 0.5).alias("x")
    e = table(spark, d, "events").select("event_id", x)
    r = lambda c, n: F.round(c, 6).alias(n)
    x = F.col("x")
    return e.select(
        "event_id", r(values.sigmoid(x), "sigmoid"), r(values.sharpened(values.sigmoid(x), 2.0), "sharp"), values.as_byte(x).cast("long").alias("byte"), r(values.gamma(x, 0.5), "gamma"),
        r(values.unsharp(x, F.lit(0.4), 1.5), "unsharp"), r(values.outside_window(x, 0.1, 0.6), "outside"), r(values.pixel_to_mv(x * 100, F.lit(20.0), F.lit(8.0)), "mv"),
        r(values.mv_to_pixel(x, F.lit(20.0), F.lit(8.0)), "pixel"), r(values.decibels(F.abs(x) + 1), "db"),
    )


def line_geometry(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.pmod("user_id", F.lit(120)).cast("double").alias("rho"), (F.pmod("event_id", F.lit(180)) - 90).cast("double").alias("degrees"))
    points = values.box_points(F.col("rho") - 40, F.radians("degrees"), F.lit(48), F.lit(64))
    bounds = values.projected_bounds(F.lit(48), F.lit(64), F.col("degrees"))
    canonical = values.canonical_line(F.col("rho"), F.radians(F.col("degrees") + 90))
    r = lambda c, n: F.round(c + 1e-9, 5).alias(n)
    return e.select(
        "event_id", r(points[0]["x"], "x0"), r(points[0]["y"], "y0"), r(points[1]["x"], "x1"), r(points[1]["y"], "y1"), r(bounds["low"], "low"), r(bounds["high"], "high"),
        r(canonical["rho"], "rho"), r(canonical["theta"], "theta"), r(lines.perpendicular_centre(F.col("degrees")), "across"),
    )


def planning_functions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    free, held, plan = values.axis_bounds(F.col("lo"), F.col("hi")), values.axis_bounds(F.col("lo"), F.col("hi"), fixed_low=0.0), values.steps(F.col("n") * 100, 2, 16, 4)
    return o.select("o_custkey", *(F.round(c, 4).alias(n) for c, n in ((free["low"], "low"), (free["high"], "high"), (held["low"], "held_low"), (held["high"], "held_high"))), plan["steps"].alias("steps"), plan["every"].cast("long").alias("every"))


def slices_of_arrays(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    part = F.posexplode(values.fraction_slice(F.col("x"), 0.25, 0.5)).alias("k", "v")
    grid = values.evenly(-1.0, 1.0, 16)
    return e.select("vec_id", part).select("vec_id", F.col("k").cast("long").alias("k"), F.round("v", 6).alias("v"), F.round(F.get(grid, F.col("k")), 6).alias("at"))


def page_regions(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles as regions of an image of 600 by 800, and colours in hue, saturation and value."""
    e = table(spark, d, "events").select("event_id", "user_id", *(c.cast("double").alias(n) for c, n in (
        (F.pmod("event_id", F.lit(60)), "x0"), (F.pmod("user_id", F.lit(50)), "y0"), (F.pmod("event_id", F.lit(9)) * 90, "w"), (F.pmod("user_id", F.lit(7)) * 85, "h"))))
    accepted = values.quad_accepted(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h"), F.col("w") * F.col("h"), F.lit(600.0), F.lit(800.0))
    red = values.hue_range(F.pmod("event_id", F.lit(181)), F.pmod("user_id", F.lit(256)), F.pmod(F.col("event_id") * 7, F.lit(256)), values.RED)
    return e.select("event_id", accepted.alias("page"), red.alias("red"))


# --- spectra and alignment ------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def spectrum_bins(spark: SparkSession, d: str) -> DataFrame:
    """The first thousand magnitudes, padding included."""
    m = _vectors(spark, d).select("vec_id", spectra.magnitudes(F.col("x")).alias("m"))
    return m.select("vec_id", F.size("m").alias("bins"), F.posexplode("m").alias("k", "v")).select("vec_id", F.col("bins").cast("long").alias("bins"), F.col("k").cast("long").alias("k"), F.round("v", 5).alias("magnitude"))


def positive_spectra(spark: SparkSession, d: str) -> DataFrame:
    x = _vectors(spark, d).select("vec_id", F.arrays_zip(spectra.positive_frequencies(F.size("x"), 500.0).alias("f"), spectra.positive_spectrum(F.col("x")).alias("m")).alias("z"))
    return x.select("vec_id", F.inline("z")).select("vec_id", F.round("f", 5).alias("frequency"), F.round("m", 5).alias("magnitude"))


def envelopes(spark: SparkSession, d: str) -> DataFrame:
    x = _vectors(spark, d).select("vec_id", F.posexplode(spectra.envelope(F.col("x"))).alias("i", "v"))
    return x.select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 5).alias("v"))


def low_pass(spark: SparkSession, d: str) -> DataFrame:
    x = _vectors(spark, d).select("vec_id", F.posexplode(spectra.low_passed(F.col("x"), 40.0, 500.0)).alias("i", "v"))
    return x.select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 5).alias("v"))


def spectrogram(spark: SparkSession, d: str) -> DataFrame:
    x = _vectors(spark, d).select("vec_id", F.posexplode(spectra.spectrogram_db(F.col("x"), 16, 8)).alias("frame", "db"))
    return x.select("vec_id", "frame", F.posexplode("db").alias("k", "db")).select("vec_id", F.col("frame").cast("long").alias("frame"), F.col("k").cast("long").alias("k"), (F.round("db", 3) + 0.0).alias("db"))


def wiener_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 8 by 8 under uneven ink; the filter of a clean and an inked picture is applied to the inked one turned upside down."""
    e = _vectors(spark, d).select("vec_id", F.transform("x", lambda v: values.clipped(v / 4 + 0.5, 0.0, 1.0)).alias("clean"))
    e = e.withColumn("inked", F.transform("clean", lambda v, i: v * (0.4 + F.pmod(i * 7, F.lit(5)) * 0.15)))
    x = e.select("vec_id", F.posexplode(spectra.wiener_restored(F.col("clean"), F.col("inked"), F.reverse("inked"), F.lit(8))).alias("i", "v"))
    return x.select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 4).alias("v"))


def lead_alignment(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    pairs = e.select(F.col("vec_id").alias("record"), F.col("x").alias("p")).join(e.select((F.col("vec_id") - 1).alias("record"), F.slice("x", F.lit(1), 64 - F.pmod("vec_id", F.lit(7))).alias("t")), "record")
    found = signals.lead_details(pairs.withColumn("lead", F.pmod("record", F.lit(4))).withColumn("record", F.floor(F.col("record") / 4)), ["record", "lead"], "p", "t", 25.0)
    return found.select("record", "lead", F.col("lag").cast("long").alias("lag"), F.col("n").cast("long").alias("n"), *((F.round(c, 5) + 0.0).alias(c) for c in ("dc", "rmse", "sig_power", "err_power")))


def record_noise(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    pairs = e.select(F.col("vec_id").alias("record"), F.col("x").alias("p")).join(e.select((F.col("vec_id") - 1).alias("record"), F.slice("x", F.lit(1), 64 - F.pmod("vec_id", F.lit(7))).alias("t")), "record")
    details = signals.lead_details(pairs.withColumn("lead", F.pmod("record", F.lit(4))).withColumn("record", F.floor(F.col("record") / 4)), ["record", "lead"], "p", "t", 25.0)
    return signals.signal_to_noise_over_leads(details, ["record"]).select("record", F.round("snr_db", 4).alias("snr_db"))


def decoded_leads(spark: SparkSession, d: str) -> DataFrame:
    x = _vectors(spark, d).select("vec_id", F.posexplode(signals.decoded_lead(F.col("x"), F.lit(0.5), 2.02, 4.0, 100.0)).alias("i", "v"))
    own = signals.expected_samples(F.when(F.col("vec_id") % 2 == 0, "II").otherwise("V1"), F.lit(51))
    return x.select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("mv"), own.alias("expected"))


# --- lines ----------------------------------------------------------------------------------------


def _votes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("image"), (F.pmod("user_id", F.lit(36)) * 5 - 90).alias("theta"), (F.pmod("event_id", F.lit(40)) - 20).alias("rho")).agg(F.count("*").alias("votes"))


def rho_slices(spark: SparkSession, d: str) -> DataFrame:
    return lines.rho_slice(_votes(spark, d), 10, 0.5).withColumn("log_votes", F.round("log_votes", 6))


def angle_histogram(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "events").select(F.col("event_type").alias("image"), F.pmod("user_id", F.lit(64)).cast("double").alias("x"), F.pmod("event_id", F.lit(48)).cast("double").alias("y"))
    return lines.angle_votes(points, 33.0, 4.123, 2.0, 24)


def smoothed_accumulator(spark: SparkSession, d: str) -> DataFrame:
    return lines.smoothed_votes(_votes(spark, d), 1.0, 0.0).select("image", "theta", "rho", F.round("smooth", 6).alias("smooth"))


def seed_entries(spark: SparkSession, d: str) -> DataFrame:
    return lines.nearest_entry(_votes(spark, d), 32.0, least=2, absolute=True)


def boundary_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.boundary_grid(_votes(spark, d), 0.6, 10.0)


def chosen_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """The boundary grid of each event type, each family by the selector whose lines are farther apart."""
    votes = _votes(spark, d)
    pictures = votes.select("image").distinct().withColumn("height", F.lit(48)).withColumn("width", F.lit(64))
    found = lines.chosen_grid(votes, pictures, 0.6, 10.0, 3, 12)
    return found.select("image", "label", F.col("theta").cast("long").alias("theta"), F.col("rho").cast("long").alias("rho"), "votes", "source")


def selector_table(spark: SparkSession, d: str) -> DataFrame:
    wide, narrow = (lines.boundary_grid(_votes(spark, d), 0.6, t).withColumn("selector", F.lit(s)) for t, s in ((10.0, "wide"), (0.0, "narrow")))
    return lines.bounds_side_by_side(wide.unionByName(narrow).where("label <> 'P_min' OR selector = 'wide'"), ["wide", "narrow"])


def window_entries(spark: SparkSession, d: str) -> DataFrame:
    votes = _votes(spark, d)
    return lines.window_candidates(votes, lines.strong_entries(votes, 0.8), 3.0, 4.0, 20.0, 12.0)


def family_choice(spark: SparkSession, d: str) -> DataFrame:
    """Two families of each event type; the one whose lines are farther apart is taken."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def of(key: str, theta: float) -> DataFrame:
        ends = table(spark, d, "events").groupBy(F.col("event_type").alias("image")).agg(F.min(F.pmod(key, F.lit(61))).alias("a"), F.max(F.pmod(F.col(key) * 3, F.lit(53))).alias("b"))
        zero, one = F.lit(0), F.lit(1)
        rows = ends.select("image", F.lit(48).alias("height"), F.lit(64).alias("width"), F.lit(theta).alias("reference"), F.array(point(F.col("a"), zero), point(F.col("a"), one)).alias("low"), F.array(point(F.col("b"), zero), point(F.col("b"), one)).alias("high"))
        return lines.family_separation(rows).select("image", "sep", "reference")

    return lines.hybrid_families(of("user_id", 0.0), of("event_id", 30.0)).withColumn("sep", F.round("sep", 6))


def pair_names(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("image"), F.col("n_nationkey").alias("rho"), F.col("n_name").alias("name"))
    pairs = n.select("image", F.col("rho").alias("rho_a"), (F.col("rho") + 1).alias("rho_b"))
    return lines.labelled_pairs(pairs, n)


# --- scores and runs ------------------------------------------------------------------------------


def mean_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.pmod("vec_id", F.lit(7)).alias("image"), F.pmod(F.col("label") * 5, F.lit(64)).alias("truth"), F.col("embedding").alias("logits"))
    return runs.mean_iou(e, ["image"], "truth", "logits", 64).withColumn("mean_iou", F.round("mean_iou", 8))


def picture_contrast(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    return i.groupBy("l_linenumber").agg(*(c.alias(n) for c, n in zip((F.round(x, 8) for x in runs.contrasts(F.col("l_discount"), F.col("l_returnflag") == "R")), ("inside", "outside", "ratio"), strict=True)), F.round(runs.photometric(F.col("l_discount"), F.col("l_tax")), 8).alias("photometric"))


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return runs.outcomes(table(spark, d, "orders"), F.col("o_orderstatus"), ["F", "O", "P", "missing"])


def guarded_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lang <> 'de'")
    found = table(spark, d, "labels").join(docs.select("doc_id", "lang"), "doc_id")
    groups = table(spark, d, "documents").select("lang")
    return runs.rates(found, ["lang"], "toxic", groups).withColumn("percent", F.round("percent", 6))


def discovered_runs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("run"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("name"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.max("o_totalprice").alias("score"), F.min("o_orderstatus").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("run"), F.col("s_acctbal").alias("score"))
    return runs.discovered([("zip", s), ("dir", c), ("metadata", o)], "run").select("run", F.array_join("sources", ",").alias("sources"), "name", F.round("score", 2).alias("score"))


def settings_table(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("e.event_id").cast("string")
    config = F.when(F.pmod("event_id", F.lit(2)) == 0, F.create_map(F.lit("r"), n)).otherwise(F.create_map(F.lit("lora_r"), n, F.lit("len"), F.lit("9")))
    return table(spark, d, "events").alias("e").select("event_id", *runs.summary_row(config, [("rank", ["lora_r", "r"]), ("length", ["len", "max_len"])]))


QUERIES = {
    f.__name__: f
    for f in (
        family_rules, final_answer_cases, training_answers, experiment_codes, labels_of_values, positional, outer_side_by_side, tail_rows, described_columns, group_texts, first_groups,
        holdout_split, category_draws, weighted_draw, flattened_sections, wide_array, intensity_functions, line_geometry, planning_functions, slices_of_arrays, page_regions,
        spectrum_bins, positive_spectra, envelopes, low_pass, spectrogram, wiener_pages, lead_alignment, record_noise, decoded_leads, rho_slices, angle_histogram, smoothed_accumulator,
        seed_entries, boundary_lines, chosen_boundaries, selector_table, window_entries, family_choice, pair_names, mean_overlap, picture_contrast, outcome_counts, guarded_rates, discovered_runs, settings_table,
    )
}

_GROUPED = """v AS (SELECT event_type AS image, user_id % 36 * 5 - 90 AS theta, event_id % 40 - 20 AS rho, count(*) AS votes FROM events GROUP BY 1, 2, 3)"""
_STRONG = """s AS (SELECT * FROM v QUALIFY votes >= {}::DOUBLE * max(votes) OVER (PARTITION BY image))"""
_BOUNDS = """c AS (SELECT image, theta, count(*) AS n FROM s GROUP BY 1, 2), d AS (SELECT image, arg_max(theta, (n, -theta)) AS dominant FROM c GROUP BY 1),
    f AS (SELECT s.*, l.letter, t.tol FROM s JOIN d USING (image), (VALUES ('D', 0), ('P', 90)) l(letter, turn), (VALUES (10.0::DOUBLE), (0.0::DOUBLE)) t(tol)
          WHERE abs((theta - dominant - turn + 90 + 720) % 180 - 90) <= tol),
    g AS (SELECT tol, image, letter || '_min' AS label, arg_min({'theta': theta, 'rho': rho, 'votes': votes}, (rho, -votes, theta)) AS e FROM f GROUP BY 1, 2, 3, letter
          UNION ALL SELECT tol, image, letter || '_max', arg_max({'theta': theta, 'rho': rho, 'votes': votes}, (rho, votes, -theta)) FROM f GROUP BY 1, 2, 3, letter)"""
_X = "x AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)"
_DFT = _X + """, r AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i, len(x) AS n FROM x),
    w AS (SELECT vec_id, k, any_value(n) AS n, sum(v * cos(2 * pi() * k * i / n)) AS re, -sum(v * sin(2 * pi() * k * i / n)) AS im FROM r, range(64) t(k) GROUP BY 1, 2)"""
_LEADS = _X + """, p AS (SELECT a.vec_id AS id, a.x[:64 - b.vec_id % 7] AS p, b.x[:64 - b.vec_id % 7] AS t FROM x a JOIN x b ON b.vec_id = a.vec_id + 1),
    m AS (SELECT id, p, t, list_avg(p) AS mp, list_avg(t) AS mt, len(p) AS n FROM p),
    l AS (SELECT id, lag, list_sum(list_transform(range(greatest(1, 1 - lag), least(n, n - lag) + 1), lambda j: (p[j] - mp) * (t[j + lag] - mt))) AS s FROM m, range(-5, 6) r(lag)),
    b AS (SELECT id, arg_max(lag, (s, -lag)) AS lag FROM l GROUP BY 1),
    q AS (SELECT id, lag, n - abs(lag) AS n, unnest(range(greatest(1, 1 - lag), least(n, n - lag) + 1)) AS j, p, t FROM m JOIN b USING (id)),
    o AS (SELECT id, lag, n, p[j] AS p, t[j + lag] AS t FROM q),
    e AS (SELECT id, any_value(lag) AS lag, any_value(n) AS n, avg(t - p) AS dc FROM o GROUP BY 1),
    g AS (SELECT id, any_value(e.lag) AS lag, any_value(e.n) AS n, any_value(dc) AS dc, sum(t * t) AS sig_power, sum((p + dc - t) * (p + dc - t)) AS err_power FROM o JOIN e USING (id) GROUP BY 1)"""
_U = "('0x' || substr(md5({} || '|{}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


def _case(key: str, texts: list[str]) -> str:
    return f"CASE {key} % {len(texts)} " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(texts)) + " END"


_FAMILIES = ("bit_manipulation", "bit_manipulation", "cipher", "cipher", "numeral", "unit_conversion", "unknown", "unknown", "unknown", "gravity", "gravity", "equation", "equation", "cipher", "unknown", "unknown")

ORACLES = {
    "family_rules": "SELECT c_custkey, " + _case("c_custkey", [f"'{f}'" for f in _FAMILIES]) + " AS family FROM customer",
    "final_answer_cases": "SELECT c_custkey, " + _case("c_custkey", ["c_mktsegment", "c_mktsegment", "'-4.5'", "'last'", "'open to ' || c_mktsegment", "'Answer:'", "''", "'eight'", "'a' || c_mktsegment || '}b'", "'done'"]) + " AS answer FROM customer",
    "training_answers": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Trace: ba->yx; zz->??.' || chr(10) || 'Final: ' ELSE '' END || '\\boxed{' || c_mktsegment || '}' AS traced,
        '`' || c_mktsegment || '.`' AS raw, CASE c_custkey % 3 WHEN 1 THEN '`' || lower(c_mktsegment) || '.`' ELSE '' END AS shown FROM customer""",
    "experiment_codes": """WITH n AS (SELECT c_custkey AS k, CASE c_custkey % 8 WHEN 0 THEN '04-s4' WHEN 1 THEN '02-raw-full' WHEN 2 THEN '02-raw-full' END AS code,
            CASE c_custkey % 8 WHEN 3 THEN left(lower(replace(c_name, '#', '-')), 18) WHEN 4 THEN 'smol' WHEN 7 THEN left('a-long-name-of-more-than-eighteen', 18) ELSE 'run' END AS rest FROM customer)
        SELECT k AS c_custkey, CASE WHEN k % 7 = 0 THEN '04-s4' WHEN code IS NOT NULL THEN code WHEN k % 5 = 0 THEN '00-raw-1024' ELSE rest END AS code FROM n""",
    "labels_of_values": """SELECT o_orderkey, format('{:02d}m{:02d}s', floor(o_totalprice / 100 / 60)::BIGINT, round_even(o_totalprice / 100 - 60 * floor(o_totalprice / 100 / 60), 0)::BIGINT) AS clock,
        '&lt;b&gt;&#x27;' || o_orderstatus || '&#x27; &amp; &quot;x&quot;&lt;/b&gt;' AS escaped, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '/z' ELSE '' END AS joined,
        CASE o_orderkey % 3 WHEN 0 THEN 'part.' || o_orderkey || '.tar' WHEN 1 THEN 'part' ELSE 'part.' || o_orderkey END AS stem, o_orderkey AS step, 'score' AS alias,
        CASE WHEN o_orderkey % 5 < 2 THEN 12::BIGINT END AS whole FROM orders""",
    "positional": "SELECT o_orderkey::INT AS id, o_orderstatus AS status, o_orderpriority AS urgency FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL",
    "outer_side_by_side": """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, n_chars, toxic FROM (SELECT * FROM documents WHERE doc_id % 3 > 0) a
        FULL JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) b ON a.doc_id = b.doc_id""",
    "tail_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25",
    "described_columns": " UNION ALL ".join(f"SELECT '{c}' AS name, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4)::DOUBLE AS low, round(max({c}), 4)::DOUBLE AS high, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median FROM part" for c in ("p_size", "p_retailprice")),
    "group_texts": """SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ', ') AS urgencies, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1""",
    "first_groups": "SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey ORDER BY 1 LIMIT 40",
    "holdout_split": """SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|7'), doc_id) <= least(greatest(ceil(0.13::DOUBLE * count(*) OVER ()), 20), count(*) OVER () - 1) AS held FROM documents""",
    "category_draws": "WITH u AS (SELECT o_orderkey, " + ", ".join(f"{_U.format('o_orderkey', s)} AS {s}" for s in ("try0", "try1", "try2", "same")) + """ FROM orders),
        c AS (SELECT *, list_transform([try0, try1, try2], lambda t: CASE WHEN t < 1.0::DOUBLE / 6 THEN 'clean' WHEN t < 4.0::DOUBLE / 6 THEN 'mobile' ELSE 'stained' END) AS c FROM u)
        SELECT o_orderkey, CASE WHEN same < 0.1::DOUBLE THEN 'identity' ELSE coalesce(list_filter(c, lambda x: x = 'stained' OR x = 'clean' AND o_orderkey % 4 > 0)[1], 'identity') END AS drawn FROM c""",
    "weighted_draw": f"""WITH r AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total,
            {_U.format('l_orderkey', 'crop')} AS u FROM lineitem)
        SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM r WHERE run > u * total GROUP BY 1""",
    "flattened_sections": """SELECT s_suppkey, unnest(['hough_ratio', 'n_bins', 'mode']) AS key, unnest([s_suppkey::VARCHAR, '9', 'sobel']) AS value FROM supplier""",
    "wide_array": "SELECT vec_id, " + ", ".join(f"round(embedding[{k + 1}]::DOUBLE, 6) AS e{k}" for k in range(66)) + " FROM embeddings",
    "intensity_functions": """WITH e AS (SELECT event_id, value / 100 - 0.5::DOUBLE AS x FROM events), p AS (SELECT *, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-x)))) AS p, greatest(0, least(1, x)) AS c FROM e)
        SELECT event_id, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(pow(p / (1 - p), 2) / (1 + pow(p / (1 - p), 2)), 6) AS sharp, greatest(0, least(255, round_even(x * 255, 0)))::BIGINT AS byte,
               round(pow(c, 0.5::DOUBLE), 6) AS gamma, round(greatest(0::DOUBLE, least(1::DOUBLE, x + 1.5::DOUBLE * (x - 0.4::DOUBLE))), 6) AS unsharp,
               round(CASE WHEN x < 0.1::DOUBLE THEN (0.1::DOUBLE - x) / 0.5::DOUBLE WHEN x > 0.6::DOUBLE THEN (x - 0.6::DOUBLE) / 0.5::DOUBLE ELSE 0 END, 6) AS outside,
               round((20 - x * 100) / 8 * 0.1::DOUBLE, 6) AS mv, round(20 - x / 0.1::DOUBLE * 8, 6) AS pixel, round(10 * log10(abs(x) + 1), 6) AS db FROM p""",
    "line_geometry": """WITH e AS (SELECT event_id, (user_id % 120)::DOUBLE AS r, (event_id % 180 - 90)::DOUBLE AS g FROM events), t AS (SELECT *, r - 40 AS rho, cos(radians(g)) AS c, sin(radians(g)) AS s FROM e),
        k AS (SELECT *, list_filter([CASE WHEN abs(s) > 1e-8 AND rho / s BETWEEN 0 AND 47 THEN {'x': 0::DOUBLE, 'y': rho / s} END, CASE WHEN abs(s) > 1e-8 AND (rho - 63 * c) / s BETWEEN 0 AND 47 THEN {'x': 63::DOUBLE, 'y': (rho - 63 * c) / s} END,
            CASE WHEN abs(c) > 1e-8 AND rho / c BETWEEN 0 AND 63 THEN {'x': rho / c, 'y': 0::DOUBLE} END, CASE WHEN abs(c) > 1e-8 AND (rho - 47 * s) / c BETWEEN 0 AND 63 THEN {'x': (rho - 47 * s) / c, 'y': 47::DOUBLE} END], lambda q: q IS NOT NULL) AS q FROM t),
        n AS (SELECT *, list_filter(q, lambda p, i: i = 1 OR len(list_filter(q[:i - 1], lambda o: sqrt(pow(o.x - p.x, 2) + pow(o.y - p.y, 2)) < 1e-6)) = 0) AS u FROM k)
        SELECT event_id, CASE WHEN len(u) > 1 THEN round(u[1].x + 1e-9, 5) END AS x0, CASE WHEN len(u) > 1 THEN round(u[1].y + 1e-9, 5) END AS y0, CASE WHEN len(u) > 1 THEN round(u[2].x + 1e-9, 5) END AS x1,
               CASE WHEN len(u) > 1 THEN round(u[2].y + 1e-9, 5) END AS y1, round(least(0, 63 * c, 47 * s, 63 * c + 47 * s) + 1e-9, 5) AS low, round(greatest(0, 63 * c, 47 * s, 63 * c + 47 * s) + 1e-9, 5) AS high,
               round(CASE WHEN g >= 0 THEN -r ELSE r END + 1e-9, 5) AS rho, round(CASE WHEN g >= 0 THEN radians(g + 90) - pi() ELSE radians(g + 90) END + 1e-9, 5) AS theta,
               round(CASE WHEN g >= 0 THEN g - 90 ELSE g + 90 END + 1e-9, 5) AS across FROM n""",
    "planning_functions": """WITH o AS (SELECT o_custkey, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1),
        p AS (SELECT *, CASE WHEN lo = hi THEN lo - greatest(abs(lo) * 0.05::DOUBLE, 0.05::DOUBLE) ELSE lo END AS a, CASE WHEN lo = hi THEN hi + greatest(abs(lo) * 0.05::DOUBLE, 0.05::DOUBLE) ELSE hi END AS b, ceil(n * 100 / 32)::BIGINT AS s FROM o)
        SELECT o_custkey, round(a - (b - a) * 0.1::DOUBLE, 4) AS low, round(b + (b - a) * 0.1::DOUBLE, 4) AS high, 0::DOUBLE AS held_low, round(hi * 1.1::DOUBLE, 4) AS held_high, s AS steps, greatest(1, s // 4) AS every FROM p""",
    "slices_of_arrays": f"WITH {_X} SELECT vec_id, k, round(x[17 + k], 6) AS v, round(-1 + k * (2 / 15.0::DOUBLE), 6) AS at FROM x, range(16) t(k)",
    "page_regions": """WITH e AS (SELECT event_id, user_id, event_id % 60 AS x0, user_id % 50 AS y0, event_id % 9 * 90 AS w, user_id % 7 * 85 AS h FROM events)
        SELECT event_id, x0 > 10 AND y0 > 10 AND x0 + w < 789 AND y0 + h < 589 AND greatest(1, w) / greatest(1, h) >= 1.1::DOUBLE AND w * h > 0.08::DOUBLE * 480000 AS page,
               (event_id % 181 <= 10 OR event_id % 181 BETWEEN 170 AND 180) AND user_id % 256 >= 50 AND event_id * 7 % 256 >= 50 AS red FROM e""",
    "spectrum_bins": f"WITH {_DFT} SELECT vec_id, 1000::BIGINT AS bins, k, round(sqrt(re * re + im * im), 5) AS magnitude FROM w UNION ALL SELECT vec_id, 1000, k, 0 FROM x, range(64, 1000) t(k)",
    "positive_spectra": f"WITH {_DFT} SELECT vec_id, round(k * 500.0::DOUBLE / n, 5) AS frequency, round(sqrt(re * re + im * im), 5) AS magnitude FROM w WHERE k < (n + 1) // 2",
    "envelopes": f"""WITH {_DFT}, h AS (SELECT vec_id, k, CASE WHEN k = 0 OR k = 32 THEN 1 WHEN k < 32 THEN 2 ELSE 0 END / n AS g, re, im FROM w),
        z AS (SELECT vec_id, i, sum(g * (re * cos(2 * pi() * k * i / 64) - im * sin(2 * pi() * k * i / 64))) AS a, sum(g * (re * sin(2 * pi() * k * i / 64) + im * cos(2 * pi() * k * i / 64))) AS b FROM h, range(64) t(i) GROUP BY 1, 2)
        SELECT vec_id, i, round(sqrt(a * a + b * b), 5) AS v FROM z""",
    "spectrogram": f"""WITH {_X}, f AS (SELECT vec_id, frame, j, k, CASE WHEN frame * 8 + j - 8 BETWEEN 0 AND 63 THEN x[frame * 8 + j - 7] ELSE 0 END * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 16)) AS v FROM x, range(9) a(frame), range(16) b(j), range(9) c(k)),
        m AS (SELECT vec_id, frame, k, sqrt(pow(sum(v * cos(2 * pi() * k * j / 16)), 2) + pow(sum(v * sin(2 * pi() * k * j / 16)), 2)) AS m FROM f GROUP BY 1, 2, 3),
        l AS (SELECT vec_id, frame, k, 20 * log10(greatest(m, 1e-5)) - 20 * log10(greatest(max(m) OVER (PARTITION BY vec_id), 1e-5)) AS db FROM m)
        SELECT vec_id, frame, k, round(greatest(db, -80), 3) + 0.0::DOUBLE AS db FROM l""",
    "lead_alignment": f"""WITH {_LEADS} SELECT id // 4 AS record, id % 4 AS lead, lag, n, round(dc, 5) + 0.0::DOUBLE AS dc, round(sqrt(err_power / n), 5) AS rmse, round(sig_power, 5) AS sig_power, round(err_power, 5) AS err_power FROM g""",
    "record_noise": f"WITH {_LEADS} SELECT id // 4 AS record, round(10 * log10((sum(sig_power) + 1e-12) / (sum(err_power) + 1e-12)), 4) AS snr_db FROM g GROUP BY 1",
    "decoded_leads": f"""WITH {_X}, m AS (SELECT vec_id, list_transform(x, lambda y: (0.5::DOUBLE - y) / 4 * 0.1::DOUBLE) AS v FROM x),
        p AS (SELECT vec_id, i, v, i * 50 / 100.0::DOUBLE AS pos FROM m, range(128) t(i)),
        q AS (SELECT *, least(floor(pos)::INT, 63) AS low FROM p)
        SELECT vec_id, i, round(v[low + 1] + (v[least(low + 2, 64)] - v[low + 1]) * (pos - low), 6) AS mv, CASE WHEN vec_id % 2 = 0 THEN 510 ELSE 127 END::BIGINT AS expected FROM q""",
    "rho_slices": f"WITH {_GROUPED} SELECT image, rho, votes, round(ln(1 + votes), 6) AS log_votes, votes >= 0.5::DOUBLE * top AS strong FROM (SELECT *, max(votes) OVER (PARTITION BY image) AS top FROM v) WHERE theta = 10",
    "angle_histogram": """SELECT event_type AS image, greatest(0, least(23, round_even(((user_id % 64) * cos(radians(33)) + (event_id % 48) * sin(radians(33)) - 4.123::DOUBLE) / 2, 0)))::BIGINT AS bin, count(*) AS votes FROM events GROUP BY 1, 2""",
    "smoothed_accumulator": f"""WITH {_GROUPED}, k AS (SELECT k, exp(-0.5::DOUBLE * k * k) AS w FROM range(-4, 5) t(k)), n AS (SELECT k, w / sum(w) OVER () AS w FROM k)
        SELECT image, theta, rho + k AS rho, round(sum(votes * w), 6) AS smooth FROM v, n GROUP BY 1, 2, 3""",
    "seed_entries": f"WITH {_GROUPED} SELECT image, theta, rho, votes FROM v WHERE votes >= 2 QUALIFY row_number() OVER (PARTITION BY image ORDER BY abs(abs(theta) - 32), votes DESC, rho, theta) = 1",
    "boundary_lines": f"WITH {_GROUPED}, {_STRONG.format(0.6)}, {_BOUNDS} SELECT image, label, e.theta AS theta, e.rho AS rho, e.votes AS votes FROM g WHERE tol = 10",
    "selector_table": f"""WITH {_GROUPED}, {_STRONG.format(0.6)}, {_BOUNDS}, i AS (SELECT DISTINCT image FROM g)
        SELECT image, label, coalesce(max(e.rho::VARCHAR) FILTER (WHERE tol = 10), '-') AS wide, coalesce(max(e.rho::VARCHAR) FILTER (WHERE tol = 0 AND label <> 'P_min'), '-') AS narrow
        FROM i CROSS JOIN (SELECT unnest(['D_min', 'D_max', 'P_min', 'P_max']) AS label) LEFT JOIN g USING (image, label) GROUP BY 1, 2""",
    "window_entries": f"WITH {_GROUPED} SELECT image, theta, rho, votes, votes >= 0.8::DOUBLE * top AS is_peak FROM (SELECT *, max(votes) OVER (PARTITION BY image) AS top FROM v) WHERE abs(rho - 3) <= 4 AND abs(theta - 20) <= 12",
    "family_choice": """WITH f AS (SELECT event_type AS image, 'global' AS source, 0.0::DOUBLE AS reference, abs(max(user_id * 3 % 53) - min(user_id % 61)) / 63.0::DOUBLE AS sep FROM events GROUP BY 1
            UNION ALL SELECT event_type, 'score', 30.0, abs(max(event_id * 3 % 53) - min(event_id % 61)) * cos(radians(30)) / (63 * cos(radians(30)) + 47 * sin(radians(30))) FROM events GROUP BY 1)
        SELECT image, arg_max(round(sep, 6), (sep, source = 'global')) AS sep, arg_max(reference, (sep, source = 'global')) AS reference, arg_max(source, (sep, source = 'global')) AS source FROM f GROUP BY 1""",
    "pair_names": """SELECT a.n_regionkey AS image, a.n_nationkey AS rho_a, a.n_nationkey + 1 AS rho_b, a.n_name AS name_a, b.n_name AS name_b FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 AND b.n_regionkey = a.n_regionkey""",
    "mean_overlap": """WITH e AS (SELECT vec_id % 7 AS image, label * 5 % 64 AS t, list_position(embedding, list_max(embedding)) - 1 AS g FROM embeddings),
        c AS (SELECT image, k, count(*) FILTER (WHERE t = k AND g = k) AS b, count(*) FILTER (WHERE t = k OR g = k) AS u FROM e, range(64) r(k) GROUP BY 1, 2)
        SELECT image, round(avg(b / u) FILTER (WHERE u > 0), 8) AS mean_iou FROM c GROUP BY 1""",
    "picture_contrast": """SELECT l_linenumber, round(i, 8) AS inside, round(o, 8) AS outside, round(i / greatest(o, 1e-8), 8) AS ratio, round(p, 8) AS photometric FROM (
        SELECT l_linenumber, avg(l_discount) FILTER (WHERE l_returnflag = 'R') AS i, avg(l_discount) FILTER (WHERE l_returnflag <> 'R') AS o, abs(avg(l_discount) - avg(l_tax)) + abs(stddev_pop(l_discount) - stddev_pop(l_tax)) AS p FROM lineitem GROUP BY 1)""",
    "outcome_counts": """SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P", 0::BIGINT AS missing FROM orders""",
    "guarded_rates": """WITH d AS (SELECT lang, toxic FROM documents JOIN labels USING (doc_id) WHERE lang <> 'de')
        SELECT lang, count(toxic) AS n, coalesce(sum(toxic), 0)::BIGINT AS matches, coalesce(round(100.0::DOUBLE * sum(toxic) / count(toxic), 6), 0) AS percent FROM (SELECT DISTINCT lang FROM documents) LEFT JOIN d USING (lang) GROUP BY 1""",
    "discovered_runs": """WITH c AS (SELECT c_custkey AS run, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name FROM customer), o AS (SELECT o_custkey AS run, max(o_totalprice) AS score, min(o_orderstatus) AS name FROM orders GROUP BY 1),
        s AS (SELECT s_suppkey AS run, s_acctbal AS score FROM supplier), r AS (SELECT run FROM c UNION SELECT run FROM o UNION SELECT run FROM s)
        SELECT r.run, concat_ws(',', CASE WHEN s.run IS NOT NULL THEN 'zip' END, CASE WHEN c.run IS NOT NULL THEN 'dir' END, CASE WHEN o.run IS NOT NULL THEN 'metadata' END) AS sources, coalesce(c.name, o.name) AS name, round(coalesce(s.score, o.score), 2) AS score
        FROM r LEFT JOIN c ON c.run = r.run LEFT JOIN o ON o.run = r.run LEFT JOIN s ON s.run = r.run""",
    "settings_table": "SELECT event_id, event_id::VARCHAR AS rank, CASE WHEN event_id % 2 = 1 THEN '9' END AS length FROM events",
    "wiener_pages": f"""WITH {_X}, c AS (SELECT vec_id, i, greatest(0::DOUBLE, least(1::DOUBLE, x[i + 1] / 4 + 0.5::DOUBLE)) AS c FROM x, range(64) t(i)),
        p AS (SELECT vec_id, i, c, c * (0.4::DOUBLE + i * 7 % 5 * 0.15::DOUBLE) AS k FROM c),
        q AS (SELECT p.*, lead(k, 63 - 2 * i::INT) OVER (PARTITION BY vec_id ORDER BY i) AS z FROM p),
        f AS (SELECT vec_id, u, v, sum(c * cos(a)) AS cr, -sum(c * sin(a)) AS ci, sum(k * cos(a)) AS kr, -sum(k * sin(a)) AS ki, sum(z * cos(a)) AS zr, -sum(z * sin(a)) AS zi
              FROM (SELECT *, 2 * pi() * (u * (i // 8) + v * (i % 8)) / 8 AS a FROM q, range(8) t(u), range(8) s(v)) GROUP BY 1, 2, 3),
        h AS (SELECT vec_id, u, v, zr, zi, (cr * kr + ci * ki) / (kr * kr + ki * ki + 1e-3) AS hr, (ci * kr - cr * ki) / (kr * kr + ki * ki + 1e-3) AS hi FROM f),
        g AS (SELECT vec_id, u, v, hr * zr - hi * zi AS gr, hr * zi + hi * zr AS gi FROM h)
        SELECT vec_id, i, round(greatest(0, least(1, sum(gr * cos(a) - gi * sin(a)) / 64)), 4) AS v
        FROM (SELECT *, 2 * pi() * (u * (i // 8) + v * (i % 8)) / 8 AS a FROM g, range(64) r(i)) GROUP BY 1, 2""",
}
