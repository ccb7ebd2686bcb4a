"""Finds the experiments below a folder of outputs: archives of submissions, run folders and run bundles (zip)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import tables
from tessera.sources.containers import base_name, picked_member, zip_members
from tessera.sources.files import listed_files

#: Where experiments lie below the root, as (source, pattern of a file's path with the experiment's own part in brackets).
PLACES = (
    ("submission archive", r"^(submissions/[^/]+)/.+$"),
    ("run folder", r"^((?:experiments|runs)/[^/]+)/.+$"),
    ("run bundle", r"^((?:run_bundles/)?[^/]*run_bundle\.zip)$"),
)
#: Names of the documents that hold settings, of the bundles in an archive (the first kind counts first), of the sections that hold
#: settings, and of the keys that name an experiment and its method.
CONFIG, METADATA = "run_config.json", "metadata.json"
BUNDLES = ("run_bundle.zip", "diagnostics.zip")
SECTIONS = ("run_config", "config_summary", "hyperparams")
NAMES, METHODS = ("experiment_name", "id"), ("method", "run_id", "source")


def _json_at(document: str, *keys: str):
    return F.coalesce(*(F.get_json_object(document, f"$.{k}") for k in keys))


def discovered_experiments(spark: SparkSession, root: str) -> DataFrame:
    """(place, source, name, method, config, metadata, files): a row per experiment below ``root``.

    ``place`` is its folder or bundle below the root; ``files`` are the names of its files and of those in its bundle, sorted. ``config`` is, as
    JSON text, its ``run_config.json``, else that of its bundle, else the first section of settings in its ``metadata.json``. A submission's
    bundle is its first ``*run_bundle.zip``, else its first ``*diagnostics.zip``. The name is that of the config, else the metadata's,
    else the place's own. What is missing is null; broken bundles count as empty. Contents are read of the named documents and of
    bundles alone, one file a task; all else is joins of listings.
    """
    below = F.substring_index("path", root.rstrip("/").removeprefix("file:") + "/", -1)
    listed = listed_files(spark, root).select("path", "name", below.alias("rel"))
    cases = [F.when(F.regexp_extract("rel", pattern, 1) != "", F.struct(F.lit(source).alias("source"), F.regexp_extract("rel", pattern, 1).alias("place"))) for source, pattern in PLACES]
    files = listed.withColumn("_e", F.coalesce(*cases)).where("_e IS NOT NULL").select("path", "name", "rel", "_e.*")
    files = files.withColumn("top", F.col("rel") == F.concat("place", F.lit("/"), "name"))

    wanted = F.col("top") & F.col("name").isin(CONFIG, METADATA)
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{CONFIG},{METADATA}}}").load(root)
    texts = files.where(wanted).join(texts.select("path", F.decode("content", "UTF-8").alias("text")), "path")
    settings = texts.groupBy("place").agg(*(F.max(F.when(F.col("name") == n, F.col("text"))).alias(a) for n, a in ((CONFIG, "own"), (METADATA, "metadata"))))

    kind = F.coalesce(*(F.when(F.endswith("name", F.lit(end)), F.lit(k)) for k, end in enumerate(BUNDLES)))
    bundles = files.where((F.col("source") == "run bundle") | ((F.col("source") == "submission archive") & F.col("top"))).withColumn("_k", kind).where("_k IS NOT NULL")
    bundles = tables.keep_first(bundles, ["place"], [F.col("_k"), F.col("name")]).select("path", "place")
    members = zip_members(spark, root, "*.zip", contents=True).where("member IS NOT NULL").withColumnRenamed("archive", "path").join(bundles, "path")
    inner = picked_member(members.withColumnRenamed("path", "archive"), CONFIG).select("place", F.decode("content", "UTF-8").alias("inner"))

    own_names = files.where("top OR source = 'run bundle'").select("place", "source", "name").where("source <> 'run bundle'")
    names = own_names.select("place", "name").union(members.select("place", base_name(F.col("member")).alias("name")))
    held = names.groupBy("place").agg(F.array_sort(F.collect_set("name")).alias("files"))

    found = files.select("place", "source").distinct()
    for other in (settings, inner, held):
        found = found.join(other, "place", "left")
    sections = (F.get_json_object("metadata", f"$.{k}") for k in SECTIONS)
    found = found.withColumn("config", F.coalesce("own", "inner", *(F.when(F.startswith(s, F.lit("{")), s) for s in sections)))
    last = F.regexp_replace(base_name(F.col("place")), r"(_run_bundle)?\.zip$", "")
    name = F.coalesce(_json_at("config", NAMES[0]), _json_at("metadata", *NAMES), last)
    method = F.when(F.col("source") == "submission archive", _json_at("metadata", *METHODS)).otherwise(_json_at("config", "prompt_experiment"))
    return found.select("place", "source", name.alias("name"), method.alias("method"), "config", "metadata", F.coalesce("files", F.array().cast("array<string>")).alias("files"))
