"""Session settings and durable staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. Duplicate JSON keys: last one wins. Partition values keep their
# spelling, so a version called "2024" stays a string. What a Python worker gets at a time is bounded by bytes, not by
# rows alone: 10,000 rows may be whole texts or wide vectors, and a worker holds two batches while it reads.
_BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
_SETTINGS = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    **_BATCH_BYTES,
}

_STAGED = "traincover-staged-"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the package needs to a running session."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Apply only the bound on Arrow batches, for jobs that otherwise run under the session's own settings."""
    for key, value in _BATCH_BYTES.items():
        spark.conf.set(key, value)


def build_session(master: str | None = None, app: str = "traincover", **conf: str) -> SparkSession:
    """A session with the package settings. Leave `master` out under spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def staging_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: the cluster's checkpoint folder, or an own one for local runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="traincover-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared staging folder and read it back.

    Cuts the lineage at a table that outlives lost executors, keeps column pruning for its readers, and
    freezes values that depend on the partitioning (row positions).
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{_STAGED}{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete the staged tables that these DataFrames read; nothing else they read is touched."""
    for table in tables:
        folders = {name.rsplit("/", 1)[0] for name in table.inputFiles()}
        context = table.sparkSession.sparkContext
        for folder in folders:
            if folder.rsplit("/", 1)[1].startswith(_STAGED):
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Redistribute a *file scan* that has fewer splits than cores; larger scans pass through unshuffled."""
    cores = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
