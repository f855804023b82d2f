"""Evaluation folders: <stem>.<image suffix> next to <stem>.json."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traincover.functions.paths import escape_glob, is_image, parent, plain_path, stem, suffix
from traincover.sources.annotations import list_files


def pair_stems(files: DataFrame, path: str = "path") -> DataFrame:
    """(dir, stem, image_path, json_path) of the images that have a JSON file of the same folder and stem.

    Two images sharing a stem both pair with its JSON file.
    """
    at = F.col(path)
    named = files.select(at, parent(at).alias("dir"), stem(at).alias("stem"), suffix(at).alias("suffix"))
    images = named.where(is_image(at)).select("dir", "stem", at.alias("image_path"))
    documents = named.where(F.col("suffix") == ".json").select("dir", "stem", at.alias("json_path"))
    return images.join(documents, ["dir", "stem"])


def scan_folder(spark: SparkSession, folder: str, dedupe: str | None = None) -> DataFrame:
    """(stem, image_path, json_path, json) of an evaluation folder, not its sub-folders.

    JSON that is broken or not UTF-8 drops its sample; a missing folder gives an empty table.
    `dedupe="last"` keeps only the last image of a stem, by path.
    """
    base = escape_glob(folder.rstrip("/"))
    pairs = pair_stems(list_files(spark, base, "*"))
    if dedupe == "last":
        pairs = pairs.groupBy("dir", "stem").agg(
            F.max("image_path").alias("image_path"), F.first("json_path").alias("json_path")
        )
    try:
        contents = (
            spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(base)
            .select(F.col("path").alias("json_path"), F.try_validate_utf8(F.col("content").cast("string")).alias("body"))
        )
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        contents = spark.createDataFrame([], "json_path string, body string")
    return (
        pairs.join(contents, "json_path")
        .withColumn("json", F.try_parse_json("body"))
        .where(F.col("json").isNotNull())
        .select(
            "stem",
            plain_path(F.col("image_path")).alias("image_path"),
            plain_path(F.col("json_path")).alias("json_path"),
            "json",
        )
    )
