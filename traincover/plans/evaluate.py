"""Batch evaluation: search every sample of a benchmark in both channels. The matches are the durable result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traincover.functions.jsonpath import text_at
from traincover.operators import coverage, embed, search
from traincover.session import stage
from traincover.sources.benchmark import scan_folder
from traincover.sources.vectors import IMAGE


def evaluation_samples(spark: SparkSession, folder: str, text_path: str) -> DataFrame:
    """(sample_id, stem, image_path, query_text) of a benchmark folder; the text is '' where the path leads nowhere."""
    return scan_folder(spark, folder).select(
        F.col("image_path").alias("sample_id"), "stem", "image_path",
        F.coalesce(text_at(F.col("json"), text_path), F.lit("")).alias("query_text"),
    )


def match_samples(
    samples: DataFrame,
    vectors: DataFrame,
    image_encoder: embed.Encoder,
    text_encoder: embed.Encoder,
    k: int = 5,
    versions: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(samples, matches). `samples` gets `error`: the image could not be read, which counts as no image match.

    Query vectors are staged: encoders run once.
    """
    asked = embed.embed_images(samples, image_encoder, out="image_vector")
    asked = stage(embed.embed_texts(asked, text_encoder, "query_text", "text_vector"), "queries")
    found = search.search_images(
        asked.select("sample_id", F.col("image_vector").alias("embedding")), vectors, k=k, versions=versions
    ).unionByName(search.search_texts(
        asked.where(F.col("query_text") != "").select("sample_id", F.col("text_vector").alias("embedding")),
        vectors, k=k, versions=versions,
    ))
    kept = asked.withColumn("error", F.when(F.col("image_vector").isNull(), IMAGE)).drop("image_vector", "text_vector")
    return kept, stage(found, "matches")


def search_by_image(
    path: str, vectors: DataFrame, encoder: embed.Encoder, top_k: int = 5, versions: list[str] | None = None
) -> DataFrame:
    """Matches of one image (file or archive member); none when it cannot be read."""
    asked = vectors.sparkSession.createDataFrame([(path, path)], "sample_id string, image_path string")
    return search.search_images(embed.embed_images(asked, encoder), vectors, k=top_k, versions=versions)


def search_by_text(
    text: str, vectors: DataFrame, encoder: embed.Encoder, top_k: int = 5, versions: list[str] | None = None
) -> DataFrame:
    """Matches of one text; none when it is empty."""
    asked = vectors.sparkSession.createDataFrame([(text, text)], "sample_id string, text string")
    return search.search_texts(embed.embed_texts(asked, encoder), vectors, k=top_k, versions=versions)


def drill_down(classified: DataFrame, matches: DataFrame, threshold: float, choice: str = "all") -> DataFrame:
    """Samples under a filter with their position (from 1) and how many matches are shown and hidden per channel."""
    from traincover.operators.ids import positions

    shown = positions(coverage.filtered(classified, choice), "sample_id")
    return shown.join(coverage.shown_hidden(matches, threshold), "sample_id", "left")
