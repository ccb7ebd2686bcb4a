"""Session factory and the few settings the library relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

FIXTURES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture table. The path goes to Spark unread, so any store Spark can open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder of a local session that names none, as in tests: there, all of Spark is one process.
TEST_FOLDER = "/tmp/tessera-checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names, or else the checkpoint folder that
    the caller has set. A cluster must name one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    if not (context.master or "").startswith("local") or (context.master or "").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return TEST_FOLDER


def durable(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` as a table written to the shared folder and read again; the stored table ``replaces`` is then deleted.

    For what a loop carries along: unlike a checkpoint, a table has the size of its files, so that the sizes
    Spark reckons with don't multiply from round to round.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if replaces is not None:
        delete(spark, replaces.stored_at)
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark's file systems reach."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
