"""The versioned vector table: <root>/version=<v>/modality=<image|text>/*.parquet.

A version may have a cell index beside it: <root>/_cells/version=<v>/centres and .../vectors/modality=<m>/cell=<c>.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_VERSION = "default"
IMAGE, TEXT = "image", "text"

SCHEMA = T.StructType([
    T.StructField("index_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("image_path", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("annotation", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("global_id", T.LongType()),
    T.StructField("version", T.StringType()),
    T.StructField("modality", T.StringType()),
])

# Builds are written here first (hidden from the table's listing by the leading underscore), then moved into place.
BUILDING = "_building"

# Characters that partition folder names would have to escape.
_UNUSABLE = set("\"#%'*/:=?\\{}[]^\x7f") | {chr(c) for c in range(32)}


def version_folder(root: str, version: str | None) -> str:
    """Folder of one version. No name means the default version, which cannot be asked for by name."""
    if version == DEFAULT_VERSION:
        raise ValueError(f"version name {version!r} is reserved")
    if version and _UNUSABLE & set(version):
        raise ValueError(f"version name {version!r} holds characters a folder name cannot carry")
    return f"{root.rstrip('/')}/version={version or DEFAULT_VERSION}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def write_version(vectors: DataFrame, root: str, version: str | None = None) -> None:
    """Replace one version as a whole: a rebuild without texts leaves no old text vectors behind.

    The new rows are written to a hidden folder of their own first; only when that write has succeeded does it take the
    version's place, by two renames. A build that fails leaves the old version whole and readable.
    """
    spark = vectors.sparkSession
    target = version_folder(root, version)
    name = target.rsplit("/", 1)[1]
    token = uuid.uuid4().hex
    fresh = f"{root.rstrip('/')}/{BUILDING}/{token}/{name}"
    columns = [field.name for field in SCHEMA if field.name != "version"]
    vectors.select(*columns).write.mode("errorifexists").partitionBy("modality").parquet(fresh)
    fs, live = _fs(spark, target)
    _, written = _fs(spark, fresh)
    _, replaced = _fs(spark, f"{root.rstrip('/')}/{BUILDING}/{token}/replaced")
    if fs.exists(live) and not fs.rename(live, replaced):
        raise RuntimeError(f"could not move {target} aside")
    if not fs.rename(written, live):
        if fs.exists(replaced):
            fs.rename(replaced, live)
        raise RuntimeError(f"could not publish {fresh} as {target}")
    _, scratch = _fs(spark, f"{root.rstrip('/')}/{BUILDING}/{token}")
    fs.delete(scratch, True)


def read_vectors(spark: SparkSession, root: str) -> DataFrame:
    """All versions. Filters on version and modality prune folders; a missing folder gives an empty table."""
    try:
        return spark.read.schema(SCHEMA).option("basePath", root).parquet(root)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], SCHEMA)
        raise


def versions(vectors: DataFrame) -> DataFrame:
    """(version, n_image, n_text) of the versions that hold images, in search order."""
    modality = F.col("modality")
    return (
        vectors.groupBy("version")
        .agg(
            F.count_if(modality == IMAGE).alias("n_image"),
            F.count_if(modality == TEXT).alias("n_text"),
        )
        .where(F.col("n_image") > 0)
        .orderBy(F.col("version") != DEFAULT_VERSION, "version")
    )


def active_versions(vectors: DataFrame, selected: list[str] | None = None) -> list[str]:
    """Versions that take part in a search, in tie-breaking order.

    No selection, or an empty one, means all; unknown names are ignored.
    """
    # One row per version: names only, read from the partition folders.
    found = vectors.where(F.col("modality") == IMAGE).select("version").distinct()
    known = {row.version for row in found.collect()}
    if not selected:
        return sorted(known, key=lambda name: (name != DEFAULT_VERSION, name))
    return [name for name in dict.fromkeys(selected) if name in known]


# Cell indexes live beside the versions, in a folder the vector table's listing skips (leading underscore).
CELLS = "_cells"
CELL_SCHEMA = T.StructType([*(f for f in SCHEMA.fields if f.name not in ("version", "modality")),
                            T.StructField("modality", T.StringType()), T.StructField("cell", T.IntegerType())])
CENTRES = "cell int, centre array<double>, radius double"
# Rows of one cell per file; a cell that holds a third of all rows is written by many tasks.
CELL_FILE_ROWS = 1 << 20


def cells_folder(root: str, version: str | None) -> str:
    """Folder of the cell index of one version."""
    return f"{root.rstrip('/')}/{CELLS}/{version_folder(root, version).rsplit('/', 1)[1]}"


def write_cells(housed: DataFrame, centres: np.ndarray, root: str, version: str | None = None,
                radii: np.ndarray | None = None) -> None:
    """Store a version's cell index: its centres (with covering radii, if given), and its vectors (with `cell`)
    partitioned by modality and cell, so that a search reads the folders of the cells it probes only."""
    folder = cells_folder(root, version)
    spark = housed.sparkSession
    rows = [(i, [float(x) for x in c], None if radii is None else float(radii[i])) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, CENTRES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
    columns = [f.name for f in CELL_SCHEMA]
    sizes = housed.groupBy("modality", "cell").agg(F.ceil(F.count("*") / CELL_FILE_ROWS).cast("int").alias("_files"))
    spread = housed.join(F.broadcast(sizes), ["modality", "cell"]).withColumn(
        "_file", F.pmod(F.xxhash64("index_id", "global_id"), F.col("_files"))
    )
    spread.repartition("modality", "cell", "_file").select(*columns).write.mode("overwrite").partitionBy(
        "modality", "cell"
    ).parquet(f"{folder}/vectors")


def read_cells(spark: SparkSession, root: str, version: str | None = None) -> tuple[np.ndarray, np.ndarray | None, DataFrame]:
    """(centres, radii or None, vectors with `version` and `cell`) of a stored cell index. Filters on cell prune folders."""
    folder = cells_folder(root, version)
    centres = spark.read.schema(CENTRES).parquet(f"{folder}/centres").orderBy("cell").toArrow()  # one row per cell
    vectors = spark.read.schema(CELL_SCHEMA).option("basePath", f"{folder}/vectors").parquet(f"{folder}/vectors")
    named = vectors.withColumn("version", F.lit(version or DEFAULT_VERSION))
    radii = centres["radius"].to_pylist()
    known = None if any(r is None for r in radii) else np.array(radii, dtype=float)
    return np.array(centres["centre"].to_pylist(), dtype=float), known, named


def duplicate_ids(vectors: DataFrame) -> DataFrame:
    """Integrity check: ids must be unique inside a version and modality. Empty when all is well."""
    return vectors.groupBy("version", "modality", "index_id").count().where("count > 1")
