"""Exports: overview CSV, detail JSON, bundle of agreed matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traincover.functions.text import bundle_file
from traincover.operators import coverage
from traincover.sources.tars import gather_by_archive, read_images
from traincover.sources.vectors import IMAGE, TEXT

# Column names of the exported files.
OVERVIEW_NAMES = {
    "stem": "样本", "text": "文物名称", "best_image": "最高图像相似度", "best_text": "最高文本相似度",
    "category": "覆盖状态",
}
DETAIL_NAMES = {
    "stem": "样本", "query_text": "检索文本", "category": "覆盖状态", "image_results": "图像检索结果",
    "text_results": "文本检索结果",
}


def category_label(category: Column, icon: bool = False) -> Column:
    """The display label of a category code."""
    label = F.lit(None).cast("string")
    for code, (mark, name) in coverage.LABELS.items():
        label = F.when(category == code, f"{mark} {name}" if icon else name).otherwise(label)
    return label


def write_overview(classified: DataFrame, path: str, text: str = "query_text", stem: str = "sample_id") -> None:
    """The overview table as CSV with a header, sorted over all part files."""
    table = coverage.overview(classified, text, stem).withColumn("category", category_label(F.col("category"), icon=True))
    table.withColumnsRenamed(OVERVIEW_NAMES).write.mode("overwrite").option("header", True).csv(path)


def detail(classified: DataFrame, matches: DataFrame, text: str = "query_text", stem: str = "sample_id") -> DataFrame:
    """One row per sample with its image and text results nested, by rank. A sample has at most 2 k matches."""
    entry = F.struct("rank", F.round("score", 4).alias("score"), "text", "source", "image_path")

    def results(channel: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("channel") == channel, entry)))

    nested = matches.groupBy("sample_id").agg(
        results(IMAGE).alias("image_results"), results(TEXT).alias("text_results")
    )
    none = F.array().cast(nested.schema["image_results"].dataType)
    return classified.join(nested, "sample_id", "left").select(
        F.col(stem).alias("stem"), F.coalesce(text, F.lit("")).alias("query_text"), "category",
        F.coalesce("image_results", none).alias("image_results"),
        F.coalesce("text_results", none).alias("text_results"),
    )


def write_detail(classified: DataFrame, matches: DataFrame, path: str, text: str = "query_text", stem: str = "sample_id") -> None:
    table = detail(classified, matches, text, stem).withColumn("category", category_label(F.col("category")))
    table.withColumnsRenamed(DETAIL_NAMES).write.mode("overwrite").json(path)


def agree_manifest(
    classified: DataFrame, matches: DataFrame, threshold: float, text: str = "query_text", stem: str = "sample_id"
) -> DataFrame:
    """One row per agreed image match: what the bundle lists, plus the path to read the image from."""
    agreed = coverage.agreed_matches(matches, classified, threshold)
    asked = classified.select(
        "sample_id", F.col(stem).cast("string").alias("query_sample"), F.coalesce(text, F.lit("")).alias("query_text")
    )
    return agreed.join(asked, "sample_id").select(
        "query_sample", "query_text", F.col("text").alias("matched_entity"),
        F.round("score", 4).alias("image_score"), "source", "annotation",
        bundle_file(F.col("query_sample"), F.col("text"), F.col("sequence")).alias("image_file"),
        "image_path",
    )


def write_bundle(manifest: DataFrame, path: str) -> None:
    """Image bytes as a Parquet table and the JSONL list of the images that could be read.

    Unreadable images leave a gap in the numbering, as their number was given before.
    """
    read = read_images(gather_by_archive(manifest)).where(F.octet_length("content") > 0)
    read.select("image_file", "content", *manifest.drop("image_file", "image_path").columns).write.mode(
        "overwrite"
    ).parquet(f"{path}/images")
    stored = manifest.sparkSession.read.parquet(f"{path}/images")
    listed = [c for c in manifest.columns if c != "image_path"]
    stored.select(*listed).write.mode("overwrite").json(f"{path}/matched_annotations")
